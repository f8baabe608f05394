"""Pairs of items that keep changing together, with recency-decayed support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sweep cap, support and the decay constant (an e-folding time in days).
MAX_ITEMS = 25
MIN_SUPPORT = 3
DECAY_DAYS = 180.0
# Items of a group that meet in one row, about; a larger group is dealt out in pairs of such blocks.
BLOCK_ITEMS = 256


def decay(age_days: Column, known: Column) -> Column:
    """Weight of one commit; an undated one counts half."""
    return F.when(known, F.exp(-F.greatest(age_days, F.lit(0.0)) / F.lit(DECAY_DAYS))).otherwise(F.lit(0.5))


def co_change(changes: DataFrame, scope: list[str], group: str, item: str, max_items: int | None = MAX_ITEMS,
              min_support: int = MIN_SUPPORT) -> DataFrame:
    """Co-change pairs from rows (scope..., group, item, weight, stamp).

    weight and stamp belong to the group; a stamp of fixed width, such as a date, keeps all groupings hashed, where strings would
    have every pair sorted. A sweeping group says nothing about coupling, and unbounded it would
    emit quadratically many pairs, so groups above the cap are identified by a plain count before anything is
    gathered; at most `max_items` values per group ever meet in one row. With `max_items` None every group counts, in whole.
    """
    keys = [*scope, group]
    each = changes.select(*keys, item, "weight", "stamp").dropDuplicates([*keys, item])
    if max_items is None:
        return _supported(_pairs_by_block(each, scope, keys, item), scope, min_support)
    sizes = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_items)).select(*keys)
    gathered = each.join(sizes, keys, "left_semi").groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.max("weight").alias("weight"), F.max("stamp").alias("stamp"))
    pairs = gathered.select(*scope, "weight", "stamp", F.posexplode("items").alias("i", "src"), "items").select(
        *scope, "weight", "stamp", "src", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("dst"))
    return _supported(pairs, scope, min_support)


def _pairs_by_block(each: DataFrame, scope: list[str], keys: list[str], item: str) -> DataFrame:
    """All pairs of all groups. A group's items are dealt by their hash into blocks, and each pair of blocks, a block with itself
    included, meets in a row of its own: no row grows with the group, and the rows of one group go to all tasks. Most groups
    are one block."""
    sizes = each.groupBy(*keys).agg(F.count(item).alias("n"), F.max("weight").alias("weight"), F.max("stamp").alias("stamp")).where("n > 1")
    blocks, own = F.ceil(F.col("n") / BLOCK_ITEMS), F.pmod(F.xxhash64(item), F.col("blocks"))
    blocked = each.where(F.col(item).isNotNull()).select(*keys, item).join(sizes, keys).withColumn("blocks", blocks).groupBy(
        *keys, "blocks", own.alias("own")).agg(
        F.collect_list(item).alias("items"), F.max("weight").alias("weight"), F.max("stamp").alias("stamp"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = blocked.withColumn("other", others).select(
        *keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "items", "weight", "stamp",
    ).repartition(*keys, "low", "high").groupBy(*keys, "low", "high").agg(
        F.array_sort(F.flatten(F.collect_list(F.transform("items", lambda x: F.struct(x.alias("item"), F.col("own")))))).alias("items"),
        F.max("weight").alias("weight"), F.max("stamp").alias("stamp"))
    pairs = met.select(*scope, "low", "high", "weight", "stamp", F.posexplode("items").alias("i", "a"), "items").select(
        *scope, "low", "high", "weight", "stamp", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    return pairs.where((F.col("low") == F.col("high")) | (F.col("a.own") != F.col("b.own"))).select(
        *scope, "weight", "stamp", F.col("a.item").alias("src"), F.col("b.item").alias("dst"))


def _supported(pairs: DataFrame, scope: list[str], min_support: int) -> DataFrame:
    return pairs.groupBy(*scope, "src", "dst").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.sum("weight"), 4).alias("weight"), F.max("stamp").alias("last_seen"),
    ).where(F.col("count") >= min_support)


def mine_history(commits: DataFrame, tracked: DataFrame, as_of: Column) -> DataFrame:
    """Co-changed files. `commits`: repo, sha, ts, tz_offset_minutes, files; `tracked`: repo, path."""
    dated = F.col("ts").isNotNull()
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("ts")) / F.lit(86_400_000_000.0)
    # The committer's own calendar day, whatever the session's time zone.
    local = F.unix_micros("ts") + F.coalesce("tz_offset_minutes", F.lit(0)).cast("long") * 60_000_000
    day = F.when(dated, F.date_from_unix_date(F.floor(local / 86_400_000_000).cast("int")))
    touched = commits.select(
        "repo", "sha", decay(age, dated).alias("weight"),
        day.alias("stamp"), F.explode("files").alias("path"),
    ).join(tracked.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    pairs = co_change(touched, ["repo"], "sha", "path")
    return pairs.withColumn("last_seen", F.coalesce(F.col("last_seen").cast("string"), F.lit("")))

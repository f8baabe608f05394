"""Postings in blocks with bounds, and an exact top k that leaves most blocks unread.

Documents are dealt by hash into stretches of about SPAN; a block holds one term's postings of one stretch, with how many they are and the peak of
their saturated term frequencies. Summed over the query's terms, weighted by rarity, the peaks bound what a document of the stretch can score. The
stretches with the highest bounds are read first; their k-th best score is a threshold, and only stretches whose bound reaches it are read besides.

A peak is taken at the average length of its day. With an average r times as long no saturated frequency grows by more than the factor r, and with a
shorter one none grows, so blocks of unchanged documents keep valid bounds when the corpus changes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranking import idf, saturated

SPAN, FIRST, LISTED = 128, 64, 10_000
TASK_DOCS = 8192  # documents that a task cuts into postings, about


def stretch_of(key: Column, docs: int, span: int = SPAN) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(docs / span))))


def by_stretch(documents: DataFrame, key: str, docs: int, span: int = SPAN) -> DataFrame:
    """Documents with their stretch, whole stretches together: cutting into words and grouping then need no further exchange. A task gets a
    bounded number of documents, however many there are."""
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs / TASK_DOCS))
    return documents.withColumn("stretch", stretch_of(F.col(key), docs, span)).repartition(tasks, "stretch")


def posting_blocks(post: DataFrame, key: str, docs: int, average: float, span: int = SPAN) -> DataFrame:
    """(term, stretch, n, peak, base, rows) from postings (key, term, tf, dl), which may carry their stretch. A stretch bounds the size of a block.
    Postings of documents that `by_stretch` has dealt stay where they are. Store the blocks in this order: a reader of some terms and stretches
    then skips the rest by the statistics of row groups and pages."""
    dealt = post if "stretch" in post.columns else post.withColumn("stretch", stretch_of(F.col(key), docs, span))
    blocks = dealt.groupBy("stretch", "term").agg(
        F.count(F.lit(1)).alias("n"), F.max(saturated(F.col("tf").cast("double"), F.col("dl").cast("double"), F.lit(float(average or 1.0)))).alias("peak"), F.lit(float(average or 1.0)).alias("base"),
        F.collect_list(F.struct(F.col(key).alias("key"), "tf", "dl")).alias("rows"))
    return blocks.select("term", "stretch", "n", "peak", "base", "rows").sortWithinPartitions("term", "stretch")


def blocks_topk(blocks: DataFrame, terms: list[str], total: float, average: float, k: int, first: int = FIRST) -> tuple[DataFrame, dict[str, int]]:
    """The k best (key, score) of BM25 over the terms, ties by key, and how many of the terms' blocks were read. What reaches the driver: a row
    for each term, `first` stretches, k scores, and the numbers of the stretches that remain if they are LISTED at most; more are joined."""
    wanted = sorted({t.lower() for t in terms})
    mine = blocks.where(F.col("term").isin(wanted))
    counts = {r["term"]: (r["df"], r["blocks"]) for r in mine.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks")).collect()}
    if not counts:
        return mine.select(F.lit(None).alias("key"), F.lit(0.0).alias("score")).where(F.lit(False)), {"blocks": 0, "read": 0}
    weight = F.element_at(F.create_map(*(F.lit(x) for t, (df, _) in counts.items() for x in (t, float(df)))), F.col("term"))
    rarity = idf(F.lit(float(total)), weight)

    def part(tf: Column, dl: Column) -> Column:
        return rarity * saturated(tf.cast("double"), dl.cast("double"), F.lit(float(average or 1.0)))

    grown = F.greatest(F.lit(1.0), F.lit(float(average or 1.0)) / F.col("base"))
    bounds = mine.groupBy("stretch").agg(F.sum(rarity * F.col("peak") * grown).alias("bound"), F.count(F.lit(1)).alias("blocks"))

    def scored(some: DataFrame) -> DataFrame:
        rows = some.select("term", F.explode("rows").alias("r"))
        return rows.groupBy(F.col("r.key").alias("key")).agg(F.sum(part(F.col("r.tf"), F.col("r.dl"))).alias("score"))

    seeds = [r["stretch"] for r in bounds.orderBy(F.desc("bound"), "stretch").limit(first).collect()]
    best = [r["score"] for r in scored(mine.where(F.col("stretch").isin(seeds))).orderBy(F.desc("score")).limit(k).collect()]
    least = best[-1] * (1 - 1e-9) if len(best) == k else 0.0
    reach = bounds.where(F.col("bound") >= least)
    listed = reach.limit(LISTED + 1).collect()
    if len(listed) <= LISTED:  # numbers are pushed down to the scan
        rest, read = mine.where(F.col("stretch").isin([r["stretch"] for r in listed])), sum(r["blocks"] for r in listed)
    else:
        rest, read = mine.join(reach, "stretch", "left_semi"), reach.agg(F.sum("blocks")).first()[0]
    return scored(rest).orderBy(F.desc("score"), "key").limit(k), {"blocks": sum(b for _, b in counts.values()), "read": read}

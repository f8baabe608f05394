"""Scoring retrieval: recall, hit@k, reciprocal rank, token saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def recall(expected: DataFrame, returned: DataFrame, question: str, item: str) -> DataFrame:
    """Share of the expected items that came back, per question; nothing expected counts as complete."""
    hits = expected.join(returned.select(question, item).distinct().withColumn("_hit", F.lit(1.0)), [question, item], "left")
    return hits.groupBy(question).agg(
        F.count(F.lit(1)).alias("n_expected"), F.sum(F.coalesce("_hit", F.lit(0.0))).cast("long").alias("n_found"),
        F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))


def rank_metrics(ranked: DataFrame, question: str, rank: str, relevant: Column) -> DataFrame:
    """hit@1, hit@5 and MRR over questions, from the rank of each question's first relevant answer."""
    first = ranked.groupBy(question).agg(F.min(F.when(relevant, F.col(rank))).alias("first"))
    hit = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return first.agg(F.count(F.lit(1)).alias("n_questions"), hit(1).alias("hit_at_1"), hit(5).alias("hit_at_5"),
                     F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"))


def median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median; the mean of the middle two for an even count. Equal values are folded before they travel."""
    return df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))


def grep_cost(files: DataFrame, pattern: str, read_files: int) -> DataFrame:
    """Tokens of a plain search plus reading the first matching files: what the tools are measured against.

    `files`: path, text. Output lines are priced as `path:line:text`, joined by newlines.
    """
    lines = files.select("path", F.posexplode(T.split_lines(F.col("text"))).alias("p", "line")).where(F.col("line").rlike(pattern))
    printed = lines.agg(F.sum(
        F.length("path") + F.length((F.col("p") + 1).cast("string")) + F.length("line") + 3).alias("chars"))
    shown = lines.select("path").distinct().orderBy("path").limit(read_files)
    opened = files.join(shown, "path", "left_semi").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("t"))
    chars = F.greatest(F.coalesce("chars", F.lit(0)) - 1, F.lit(0))
    found = F.ceil(chars / F.lit(T.CHARS_PER_TOKEN) * F.lit(T.SAFETY_MARGIN))
    return printed.select((found + F.coalesce(opened.scalar(), F.lit(0))).cast("long").alias("tokens"))


def grep_costs(files: DataFrame, patterns: dict[str, str], read_files: int) -> DataFrame:
    """`grep_cost` of a set of named patterns, in one pass over the files: id, tokens."""
    asked = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("pattern")) for i, p in patterns.items()))
    each = files.select("path", T.estimate_tokens(F.col("text")).alias("whole"), T.split_lines(F.col("text")).alias("lines"), F.explode(asked).alias("q"))
    chars = F.length("path") + F.length((F.col("h.p") + 1).cast("string")) + F.length("h.line") + 3
    numbered = F.transform("lines", lambda line, i: F.struct(i.alias("p"), line.alias("line")))
    hits = each.select("q", "path", "whole", F.explode(numbered).alias("h")).where(F.expr("h.line rlike q.pattern"))
    by_file = hits.groupBy(F.col("q.id").alias("id"), "path").agg(F.sum(chars).alias("chars"), F.first("whole").alias("whole"))
    ranked = by_file.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("path")))
    sums = ranked.groupBy("id").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("rank") <= read_files, F.col("whole"))).alias("opened"))
    return sums.select("id", (F.ceil((F.col("chars") - 1) / F.lit(T.CHARS_PER_TOKEN) * F.lit(T.SAFETY_MARGIN)) + F.coalesce("opened", F.lit(0))).cast("long").alias("tokens"))

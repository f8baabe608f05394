"""Scoring, fusion and selection of search candidates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry.functions import text as T

# Fusion damping, pool size, score multipliers, BM25 parameters.
RRF_K = 60
SEED_POOL = 20
NO_SYMBOL, TEST_CODE, CONNECTED, STANDALONE, HOP_DECAY = 0.55, 0.35, 1.35, 0.55, 0.45
EXPAND_SEEDS, EXPAND_LIMIT = 5, 6
BM25_K1, BM25_B = 1.2, 0.75
# Query vectors travel with the tasks, so a block of them has a fixed byte bound.
QUERY_BLOCK_BYTES = 8 << 20


# ---------------------------------------------------------------- vector arm
def knn(df: DataFrame, vector: str, queries: Iterable[tuple[object, list[float]]], k: int, ties: str,
        query_column: str = "query_id") -> DataFrame:
    """Exact cosine top-k for each query vector: (query, all columns but the vector, score, rank).

    Every task multiplies Arrow batches with the query block and keeps only its own best k per query, so the
    merge sees k rows per query and partition whatever the table holds. More queries than a block holds are
    handled by further passes.
    """
    queries = list(queries)
    dim = max((len(v) for _, v in queries), default=1)
    size = max(1, QUERY_BLOCK_BYTES // (8 * dim))
    blocks = [queries[i: i + size] for i in range(0, len(queries), size)]
    kept = [f for f in df.schema.fields if f.name != vector]
    query_type = "string" if queries and isinstance(queries[0][0], str) else "long"
    schema = ST.StructType([*kept, ST.StructField(query_column, ST.StringType() if query_type == "string" else ST.LongType()),
                            ST.StructField("score", ST.DoubleType())])
    parts = [df.mapInArrow(_block_scorer(block, vector, [f.name for f in kept], k, ties, query_column), schema)
             for block in blocks]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    best = Window.partitionBy(query_column).orderBy(F.desc("score"), F.col(ties))
    return union.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block_scorer(block, vector: str, kept: list[str], k: int, ties: str, query_column: str):
    names = pa.array([q for q, _ in block])
    matrix = np.array([v for _, v in block], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: pa.Table | None = None
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(vector)))
            if batch.num_rows == 0:
                continue
            flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(batch.num_rows, -1)
            lengths = np.linalg.norm(rows, axis=1)
            cosine = (rows @ unit.T) / np.where(lengths > 0, lengths, 1.0)[:, None]
            row, query = _top(cosine, batch.column(ties), k)
            found = pa.Table.from_batches([batch]).select(kept).take(pa.array(row))
            found = found.append_column(query_column, names.take(pa.array(query))).append_column("score", pa.array(cosine[row, query]))
            pool = _best(found if pool is None else pa.concat_tables([pool, found]), k, ties, query_column)
        if pool is not None:
            yield from pool.combine_chunks().to_batches()

    return score


def _top(scores: np.ndarray, ties: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of every column, ties to the smaller tie value: at most k rows for each query."""
    if len(scores) <= k:
        return np.repeat(np.arange(len(scores)), scores.shape[1]), np.tile(np.arange(scores.shape[1]), len(scores))
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    column, row = np.nonzero((scores >= least).T)
    if len(row) > k * scores.shape[1]:
        place = np.empty(len(scores), np.int64)
        place[pa.compute.sort_indices(ties).to_numpy()] = np.arange(len(scores))
        order = np.lexsort((place[row], -scores[row, column], column))
        row, column = row[order], column[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(column) > 0]))
        kept = np.arange(len(column)) - np.repeat(first, np.diff(np.append(first, len(column)))) < k
        row, column = row[kept], column[kept]
    return row, column


def _best(table: pa.Table, k: int, ties: str, query_column: str) -> pa.Table:
    """First k rows of each query by score, then by the tie column."""
    ordered = table.sort_by([(query_column, "ascending"), ("score", "descending"), (ties, "ascending")])
    codes = ordered.column(query_column).combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
    position = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    return ordered.filter(pa.array(position < k))


# ---------------------------------------------------------------- lexical arm
def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0))


def _occurrences(array: str, word: str) -> Column:
    return F.size(F.filter(array, lambda w: w == word)).cast("double")


def idf(n: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def saturated(tf: Column, length: Column, average: Column) -> Column:
    return tf / (tf + F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * length / average))


def bm25_scan(df: DataFrame, key: str, text: str, terms: list[str], stage=lambda df: df) -> DataFrame:
    """BM25 of a few terms straight off the text: (key, score) of matching rows.

    Term counts are taken inside the row, so nothing is exploded or shuffled; corpus statistics are one row,
    read back as a scalar subquery. `stage` can store the counts, a few numbers per row, so that statistics and
    scores read the texts once between them.
    """
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        return df.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    tokens = df.select(key, words(F.col(text)).alias("w"))
    counted = tokens.select(
        key, F.size("w").cast("double").alias("dl"),
        *[_occurrences("w", t).alias(f"tf{i}") for i, t in enumerate(wanted)])
    counted = stage(counted)
    stats = counted.agg(F.struct(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"),
        *[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(wanted))]).alias("s")).scalar()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        score = score + idf(stats["n"], stats[f"df{i}"]) * saturated(F.col(f"tf{i}"), F.col("dl"), stats["avgdl"])
    matches = F.lit(False)
    for i in range(len(wanted)):
        matches = matches | (F.col(f"tf{i}") > 0)
    return counted.where(matches).select(key, score.alias("score"))


def postings(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., term, tf, dl): the stored form of the full-text index."""
    # The words are taken in a step of their own: beside the explode they would be taken again for every word.
    cut = df.select(*keys, words(F.col(text)).alias("w"))
    each = cut.select(*keys, F.size("w").cast("int").alias("dl"), F.explode("w").alias("term"))
    return each.groupBy(*keys, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))


def bm25_postings(post: DataFrame, keys: list[str], terms: list[str], total: float, average: float) -> DataFrame:
    """BM25 from stored postings: only the rows of the wanted terms are read."""
    wanted = sorted({t.lower() for t in terms})
    mine = post.where(F.col("term").isin(wanted))
    frequency = mine.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    part = idf(F.lit(float(total)), F.col("df")) * saturated(
        F.col("tf").cast("double"), F.col("dl").cast("double"), F.lit(float(average or 1.0)))
    return mine.join(frequency, "term").groupBy(*keys).agg(F.sum(part).alias("score"))


# ---------------------------------------------------------------- fusion
def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows with their rank; sorted by a bounded heap per task."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(arms: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """Weighted reciprocal-rank fusion of small ranked arms (key, rank): adds score and the order of discovery."""
    live = [(i, arm, w) for i, (arm, w) in enumerate(arms) if w > 0]
    rows = None
    for i, arm, weight in live:
        part = arm.select(key, (F.lit(float(weight)) / (F.lit(float(RRF_K)) + F.col("rank"))).alias("s"),
                          F.struct(F.lit(i).alias("arm"), F.col("rank").alias("rank")).alias("seen"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.sum("s").alias("score"), F.min("seen").alias("seen"))


def adjust(df: DataFrame, include_tests: bool = False, scope: str | None = None) -> DataFrame:
    """Demote anonymous module code and tests, restrict to a path prefix."""
    score = F.col("score") * F.when(F.col("symbol_qname").isNull(), NO_SYMBOL).otherwise(1.0)
    if not include_tests:
        score = score * F.when(F.col("is_test"), TEST_CODE).otherwise(1.0)
    out = df.withColumn("score", score)
    return out.where(F.startswith("path", F.lit(scope))) if scope else out


def graph_pass(pool: DataFrame, pairs: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Boost candidates related to another candidate; drop weak unrelated ones.

    `pool` is a bounded candidate list with `score` and `reasons`; `pairs` are undirected-as-stored relations
    (src, dst). `order` is the fused order: its first row sets the bar. Without any relation nothing changes,
    not even the order, which `turn` (then the old order) spells out.
    """
    names = pool.where(F.col(name).isNotNull()).select(F.col(name).alias("n")).distinct()
    related = (
        pairs.join(names.select(F.col("n").alias("src")), "src", "left_semi")
        .join(names.select(F.col("n").alias("dst")), "dst", "left_semi")
        .select(F.explode(F.array("src", "dst")).alias(name)).distinct().withColumn("connected", F.lit(True))
    )
    everyone = Window.partitionBy()
    marked = pool.join(related, name, "left").withColumn("connected", F.coalesce("connected", F.lit(False)))
    marked = marked.withColumn("_any", F.max("connected").over(everyone)).withColumn(
        "_best", F.first("score").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = marked.where(~F.col("_any") | F.col("connected") | (F.col("score") >= F.col("_best") * STANDALONE))
    return kept.withColumn("score", F.when(F.col("connected"), F.col("score") * CONNECTED).otherwise(F.col("score"))).withColumn(
        "reasons", F.when(F.col("connected"), F.concat("reasons", F.array(F.lit("structurally connected")))).otherwise(F.col("reasons"))
    ).withColumn("turn", F.when(F.col("_any"), -F.col("score")).otherwise(0.0)).drop("_any", "_best", "connected")


def expand(pool: DataFrame, calls: DataFrame, name: str, order: list[Column], seeds: int = EXPAND_SEEDS,
           limit: int = EXPAND_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
    """Neighbours of the strongest candidates: (name, seed, score), at most `limit`, none already in the pool.

    `calls` are directed (src, dst) pairs, followed both ways; `allowed` restricts what may be added.
    """
    top = pool.orderBy(*order).limit(seeds).where(F.col(name).isNotNull()).groupBy(F.col(name).alias("seed")).agg(
        F.min("score").alias("seed_score"))
    known = pool.where(F.col(name).isNotNull()).select(name).distinct()
    both = calls.select(F.explode(F.array(F.struct(F.col("src").alias("seed"), F.col("dst").alias(name)),
                                          F.struct(F.col("dst").alias("seed"), F.col("src").alias(name)))).alias("e")).select("e.*")
    reached = both.join(top, "seed").join(known, name, "left_anti").groupBy(name).agg(
        F.max(F.struct(F.col("seed_score").alias("score"), F.col("seed").alias("seed"))).alias("b"))
    if allowed is not None:
        reached = reached.join(allowed, name, "left_semi")
    scored = reached.select(name, F.col("b.seed").alias("seed"), (F.col("b.score") * HOP_DECAY).alias("score"))
    return scored.orderBy(F.desc("score"), name).limit(limit)


# ---------------------------------------------------------------- selection
def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. The rank filter is pushed below the exchange, one row per key and task moves."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col("_rn") == 1).drop("_rn")


def normalise(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores relative to the best one; an all-zero list stays zero."""
    top = df.agg(F.max(score).alias("top")).scalar()
    return df.withColumn(score, F.col(score) / F.when(top == 0, F.lit(1.0)).otherwise(top))


def module_rollup(df: DataFrame, path: str = "path", limit: int | None = None) -> DataFrame:
    """Matches per module, most first."""
    counted = df.groupBy(T.module_of(F.col(path)).alias("module")).agg(F.count(F.lit(1)).alias("n_matches"))
    return counted.orderBy(F.desc("n_matches"), "module").limit(limit) if limit else counted


def collapse(df: DataFrame, keys: list[str], line: str, order: list[Column], extra: int = 2) -> DataFrame:
    """Fold a group into its best row, the next lines and a count of the hidden rest.

    Hot groups never meet in one task: the head and the smallest lines are rank filters that run below the
    exchange, the count is a partial aggregate.
    """
    head = best_per_key(df, keys, order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(line), *order))
    low = df.withColumn("_r", rank).where(F.col("_r") <= extra + 1).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.col(line))).alias("_low"))
    # The head is one of the rows: take it out of the low list once if it is there.
    at = F.array_position("_low", F.col(line))
    rest = F.when(at > 0, F.concat(F.slice("_low", F.lit(1), (at - 1).cast("int")),
                                   F.slice("_low", (at + 1).cast("int"), F.size("_low")))).otherwise(F.col("_low"))
    return head.join(sizes, keys).join(low, keys).withColumn("extra_lines", F.slice(rest, 1, extra)).withColumn(
        "hidden_count", F.greatest(F.col("_n") - 1 - extra, F.lit(0)).cast("long")).drop("_n", "_low")

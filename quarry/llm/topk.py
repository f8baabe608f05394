"""Exact top-k inner products over norm buckets.

Vectors become integers, floor(SCALE * x), and are dealt into buckets of about BUCKET rows in descending order of length; queries
into blocks in the same way. Each block first meets the buckets of the longest vectors, whose k-th best score is a threshold for
the query. Then a block meets only buckets whose longest vector can still reach a threshold: |q| * |v| >= t. In a bucket each query
has a local cosine threshold, t / (|q| * longest). Above 1 the bucket is skipped; from COSINE on, candidates come from sorted
lists of the query's FOCUS largest coordinates, each of which must lie in the range that the cosine leaves; below, they are the
bucket's vectors of sufficient length. All candidates are verified by their exact products.

Vectors that are null, or hold null, NaN or infinite components, and rows with a null id take no part. Vectors of different
dimensions are compared as if the shorter ended in zeros; an empty vector has length 0. Rows that carry the query's id are its own;
a query id counts once, by the smallest of its vectors. Ties go to the smaller id. Products are exact at any size: blocks hold four
bytes a component where that is enough, eight otherwise, and sums that could pass 64 bits are taken over Python's integers. A
component or a score that doesn't fit in 64 bits raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import staged

SCALE, BUCKET, BLOCK, SEEDS, COSINE, FOCUS = 64, 2048, 512, 2, 0.75, 4
_PACKED = "part int, seq int, longest double, size int, width int, ids binary, matrix binary"


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        sizes = np.diff(column.offsets.to_numpy())
        edges = np.concatenate([[0], np.cumsum(sizes)])
        scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if len(scaled) and not np.abs(scaled).max() < 2.0**63:
            raise OverflowError("a scaled component doesn't fit in 64 bits")
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), scaled * scaled, len(sizes)))
        values = scaled.astype("<i8")
        vectors = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norms), pa.array(vectors, pa.binary())], names=["id", "norm", "vector"])


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows: the first is the longest."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            vectors = [v.as_py() for v in piece.column(2)]
            width = max(len(v) for v in vectors)
            values = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in vectors), "<i8")
            small = len(values) == 0 or (values.min() >= -(1 << 31) and values.max() < 1 << 31)
            matrix = values.astype("<i4").tobytes() if small else values.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([piece.column(1)[0].as_py()]), pa.array([len(vectors)], pa.int32()),
                pa.array([width // 8], pa.int32()), pa.array([piece.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([matrix], pa.binary()),
            ], names=["part", "seq", "longest", "size", "width", "ids", "matrix"])
            seq += 1


def _matrix(data: bytes, n: int, width: int, wide: int) -> np.ndarray:
    """n rows of `wide` integers from a block's rows of `width`, of four or eight bytes each."""
    out = np.zeros((n, wide), np.int64)
    if width:
        out[:, :width] = np.frombuffer(data, "<i4" if len(data) == 4 * n * width else "<i8").reshape(n, width)
    return out


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(1))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    largest = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(v.astype(np.float64)).max()) * q.shape[1] if q.size and v.size else 0.0
    if largest < 2**52:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if largest < 2**62:
        return q @ v.T
    return (q.astype(object) @ v.T.astype(object)).astype(np.int64)  # raises where a score passes 64 bits


def search_bucket(q: np.ndarray, q_ids: np.ndarray, thresholds: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best in a bucket in descending order of length that reach its threshold."""
    q_norm, v_norm = _norms(q), _norms(v)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(thresholds > 0, thresholds / (q_norm * v_norm[0]), -1.0)
        length = np.where(thresholds > 0, thresholds / q_norm, 0.0) * (1 - 1e-9)
    found = []
    by_length = np.flatnonzero(local < COSINE)
    if len(by_length):
        reach = len(v_norm) - int(np.searchsorted(v_norm[::-1], length[by_length].min(), "left"))
        scores = _products(q[by_length], v[:reach])
        for i, row in zip(by_length, scores, strict=True):
            found.append((i, np.arange(reach), row))
    close = np.flatnonzero((local >= COSINE) & (local <= 1 + 1e-9))
    if len(close):
        unit = v / np.maximum(v_norm, 1e-300)[:, None]
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in close:
            direction, least = q[i] / q_norm[i], min(1.0, local[i])
            keep = None
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                if f not in lists:
                    order = np.argsort(unit[:, f], kind="stable")
                    lists[f] = order, unit[order, f]
                order, values = lists[f]
                middle, spread = direction[f] * least, np.sqrt(max(0.0, (1 - least * least) * (1 - direction[f] ** 2))) + 1e-9
                # a cosine above the threshold moves the range towards the query's own coordinate, never past it
                low = -1.0 if direction[f] < 0 and -direction[f] >= least else middle - spread
                high = 1.0 if direction[f] > 0 and direction[f] >= least else middle + spread
                some = order[np.searchsorted(values, low): np.searchsorted(values, high, "right")]
                keep = some if keep is None else np.intersect1d(keep, some, assume_unique=True)
                if len(keep) <= k:
                    break
            found.append((i, keep, _products(q[i: i + 1], v[keep])[0]))
    rows, columns, scores = [], [], []
    for i, at, score in found:
        fits = (score >= thresholds[i]) & (v_ids[at] != q_ids[i])
        at, score = at[fits], score[fits]
        if len(at) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[keep], score[keep]
            order = np.lexsort((v_ids[at], -score))[:k]
            at, score = at[order], score[order]
        rows.append(np.full(len(at), i))
        columns.append(at)
        scores.append(score)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k largest integer inner products of each query with all other vectors."""

    def taking_part(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & ~odd)

    def blocks(part: DataFrame, rows: int) -> DataFrame:
        whole = part.mapInArrow(lambda it: _integers(it, scale), "id long, norm double, vector binary")
        dealt = whole.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
        return staged(spark, dealt.mapInArrow(lambda it: _pack(it, rows), _PACKED))

    buckets, asked = blocks(taking_part(vectors), BUCKET), blocks(taking_part(queries).groupBy("id").agg(F.min("vector").alias("vector")), BLOCK)
    index = sorted((-r.longest, r.part, r.seq) for r in buckets.select("longest", "part", "seq").collect())  # a row for each BUCKET vectors
    reach = np.array([x[0] for x in index])
    seeds = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(s).alias("seq")) for _, p, s in index[:SEEDS])) if index else None
    empty = "query_id long, vec long, score long"
    if seeds is None:
        return spark.createDataFrame([], empty).select("query_id", F.lit(1).alias("rank"), F.col("vec").alias(id_col), "score").limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, v_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                wide = max(r["q_width"], r["width"], 1)
                q, v = _matrix(r["q_matrix"], len(q_ids), r["q_width"], wide), _matrix(r["matrix"], len(v_ids), r["width"], wide)
                least = np.frombuffer(r["least"], "<f8") if r["least"] else np.full(len(q_ids), -np.inf)
                rows, columns, scores = search_bucket(q, q_ids, least, v, v_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(v_ids[columns]), pa.array(scores)], names=["query_id", "vec", "score"])

    def meet(pairs: DataFrame) -> DataFrame:
        met = pairs.join(buckets, ["part", "seq"]).select("q_width", "q_ids", "q_matrix", "least", "width", "ids", "matrix")
        return met.mapInArrow(run, empty)

    def best(df: DataFrame) -> DataFrame:
        ahead = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
        return df.withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= k)

    block = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("part", "seq", "width", "ids", "matrix")))
    first = staged(spark, best(meet(block.withColumn("least", F.lit(None).cast("binary")).withColumn("to", F.explode(seeds)).select("*", "to.*"))).select("query_id", "vec", "score", "rank"))
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    owners = asked.select("part", "seq", "ids").mapInArrow(_owners, "id long, part int, seq int, place int")
    per_block = owners.join(bounds, F.col("id") == F.col("query_id"), "left").groupBy("part", "seq").agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("bounds"))
    ready = block.join(per_block.select(F.col("part").alias("q_part"), F.col("seq").alias("q_seq"), F.transform("bounds", lambda b: F.coalesce(b["least"].cast("double"), F.lit(float("-inf")))).alias("bounds")), ["q_part", "q_seq"])

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bounds = np.array(r["bounds"])
                norms = _norms(_matrix(r["q_matrix"], len(bounds), r["q_width"], r["q_width"]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    needed = np.where(bounds > 0, bounds / norms, 0.0).min() * (1 - 1e-9)
                upto = int(np.searchsorted(reach, -needed, "right"))
                for _, part, seq in index[SEEDS:upto]:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((r["q_part"], pa.int32()), (r["q_seq"], pa.int32()), (part, pa.int32()), (seq, pa.int32()), (bounds.tobytes(), pa.binary()))],
                                                     names=["q_part", "q_seq", "part", "seq", "least"])

    pairs = staged(spark, ready.mapInArrow(open_pairs, "q_part int, q_seq int, part int, seq int, least binary"))
    rest = meet(pairs.join(block, ["q_part", "q_seq"]))
    return best(first.select("query_id", "vec", "score").unionByName(rest)).select("query_id", "rank", F.col("vec").alias(id_col), "score")


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), part, np.int32)), pa.array(np.full(len(found), seq, np.int32)),
                                              pa.array(np.arange(len(found), dtype=np.int32))], names=["id", "part", "seq", "place"])

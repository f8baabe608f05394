"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's shingles are put in one order for all documents: those that are frequent somewhere in the corpus last. With a
similarity of t, a document of n shingles shares at least a = ceil(t * n) with any partner, so two partners share at least k of
their first n - a + k shingles, for every k up to a. Each document takes the k of lowest estimated cost, from the lengths of the
lists that its prefix meets: a longer prefix reads more lists, but asks for k common shingles before a pair is verified. A pair
needs the smaller k of the two. Equal sets are folded into one class first; the links between classes are found by
`linking.groups` and verified on the whole sets.

The order only affects cost, so the counts behind it may be lower bounds: a task reports the shingles that it sees in at least
LOCAL documents of a block of texts, and the ORDERED most frequent of the sums are put last. With them go the ORDERED keys of the
longest lists, of more than SHORT entries, that prefixes in this first order would make; those counts are exact.

Nulls and texts without words have an empty set and link with nothing (component: their own id). A null id takes no part
(component null). Repeated rows fall into one class; an id that occurs with several texts links through any of them. An empty
table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import linking
from quarry.llm import words as W
from quarry.session import discard, staged

LOCAL, ORDERED, BLOCK, MOST = 2, 1 << 19, 1 << 19, 4
#: Bytes of text whose shingles a task holds at once; what stays allocated between chunks follows from it.
CHUNK = 3 << 17
SHORT = 8
#: Cost of verifying a pair, in entries of a list; a chance partner shares one more shingle with this probability.
VERIFY, CHANCE = 60, 0.25
_U = np.uint64


def _shingles(chunk: W.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = W.spans(chunk, W.BLANKS)
    return W.distinct(*W.shingles(W.span_hashes(chunk.buf, starts, ends), first, width))


def _frequent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def report() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= LOCAL
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["key", "n"])

    for batch in batches:
        for chunk in W.chunks(batch.column(0), CHUNK):
            held.append(_shingles(chunk, width)[1])
            if sum(map(len, held)) >= BLOCK:
                yield report()
    if held:
        yield report()


class Order:
    """Places of the frequent shingles; all others come before them, by hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys.view(np.uint64))
        self.keys, self.counts = keys.view(np.uint64)[order], counts[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> _U(42)] = True

    def weights(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        maybe = np.flatnonzero(self.seen[values >> _U(42)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == values[maybe], self.counts[at], 0)
        return out


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, order: Order) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch.column(1), CHUNK):
            n = chunk.last - chunk.first
            doc, values = _shingles(chunk, width)
            sizes = np.bincount(doc, minlength=n).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.concatenate([[_U(0)], np.cumsum(W.mix(values ^ _U(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            ranked = values[np.argsort(doc * (1 << 40) + np.minimum(order.weights(values), (1 << 40) - 1), kind="stable")]
            least = -(-sizes * percent // 100)
            length = np.minimum(sizes, sizes - least + np.minimum(MOST, least))
            prefix = ranked[W.ragged(first[:-1], length)].view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(chunk.first, n), pa.array(sizes), *(pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in sums),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(prefix)),
            ], names=["id", "size", "k1", "k2", "prefix"])


def _sets(batches: Iterator[pa.RecordBatch], width: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.filter(pa.array(linking.in_bloom(wanted, batch.column(0).to_numpy(zero_copy_only=False))))
        for chunk in W.chunks(kept.column(1), CHUNK):
            n = chunk.last - chunk.first
            doc, values = _shingles(chunk, width)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n)) * 8]).astype(np.int32)
            items = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([kept.column(0).slice(chunk.first, n), items], names=["node", "item"])


def jaccard_join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id that links reach)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = texts.where("id is not null")
    often = (known.select("text").mapInArrow(lambda it: _frequent(it, width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "key").limit(ORDERED).toArrow())
    first = spark.sparkContext.broadcast(Order(often["key"].to_numpy(), often["n"].to_numpy()))
    schema = "id long, size long, k1 long, k2 long, prefix array<long>"
    # the lists that prefixes in this order would make show, by exact counts, which further keys had better come last
    lists = (texts.mapInArrow(lambda it: _prefixes(it, width, percent, first.value), schema).select(F.explode("prefix").alias("key"))
             .groupBy("key").agg(F.count("*").alias("n")).where(f"n > {SHORT}").orderBy(F.desc("n"), "key").limit(ORDERED).toArrow())
    keys, counts = np.concatenate([often["key"].to_numpy(), lists["key"].to_numpy()]), np.concatenate([often["n"].to_numpy(), lists["n"].to_numpy()])
    best = np.lexsort((-counts, keys))
    best = best[np.concatenate([[True], keys[best][1:] != keys[best][:-1]])[: len(best)]]
    first.destroy()
    order = spark.sparkContext.broadcast(Order(keys[best], counts[best]))
    del often, lists, keys, counts
    rows = staged(spark, texts.mapInArrow(lambda it: _prefixes(it, width, percent, order.value), schema))
    sets = rows.where("size > 0 and id is not null")
    copies = staged(spark, sets.groupBy("k1", "k2", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    nodes = sets.join(copies, ["k1", "k2", "size"], "left").select("id", "size", F.coalesce("first", "id").alias("node"), "prefix")
    nodes = staged(spark, nodes.select("id", "size", "node", F.when(F.col("id") == F.col("node"), F.col("prefix")).alias("prefix")))
    found = linking.groups(spark, _postings(spark, nodes, percent), percent, lambda wanted: known.mapInArrow(lambda it: _sets(it, width, wanted), "node long, item binary"),
                           _stored)
    members = nodes.select("id", "node").distinct().join(found, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    members = staged(spark, members)
    out = rows.select("id", "size").join(members, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _stored(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    edges = np.frombuffer(items.buffers()[1], np.int32)[items.offset: items.offset + len(items) + 1].astype(np.int64)
    data = np.frombuffer(items.buffers()[2], np.uint8)[edges[0]: edges[-1]].view(np.uint64)
    return np.repeat(np.arange(len(items)), np.diff(edges) // 8), data


def _postings(spark: SparkSession, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node, hub, of, of_hub) of each node's chosen prefix; hub: the smallest node that has the key."""
    every = nodes.where("prefix is not null").dropDuplicates(["node", "size", "prefix"]).select("node", "size", F.posexplode("prefix").alias("place", "key"))
    lists = staged(spark, every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size", "place")).alias("hub")).where("n > 1"))
    met = staged(spark, every.join(lists, "key"))
    least = f"((size * {percent} + 99) div 100)"
    sums = [F.sum(F.when(F.expr(f"place < size - {least} + {k}"), F.col("n") - 1).otherwise(0)).alias(f"s{k}") for k in range(1, MOST + 1)]
    costs = [F.struct((F.col(f"s{k}") * (1 + VERIFY * CHANCE ** (k - 1))).alias("cost"), F.lit(k).cast("long").alias("need")) for k in range(1, MOST + 1)]
    choice = staged(spark, met.groupBy("node", "size").agg(*sums).select("node", "size", F.least(F.array_min(F.array(*costs))["need"], F.expr(least)).alias("need")))
    ahead = Window.partitionBy("node", "size").orderBy("place")  # a node's prefix
    chosen = met.join(choice, ["node", "size"]).where(f"place < size - {least} + need").withColumn("before", F.row_number().over(ahead) - 1)
    # a hub's need isn't known here; its partner's stands in for it, as the pairs that this leaves out are met later
    of_hub = F.struct(F.col("hub.size").alias("size"), F.col("need"), F.col("hub.place").alias("place"), F.col("before"))
    return chosen.select("key", "node", F.col("hub.node").alias("hub"), F.struct("size", "need", "place", "before").alias("of"), of_hub.alias("of_hub")).distinct()


def brute(rows: list[tuple[int, str | None]], width: int = 3, percent: int = 90) -> list[tuple[int, int, int]]:
    """Plain version for tests: (id, n_shingles, component_id)."""
    import re

    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(i, len(s), root(i)) for i, s in sets]

"""Groups of near-equal items without all pairs of a group: candidates by shared keys, verified links, union-find.

`groups` takes postings (key, node): two nodes are candidates when they share a key, or as many keys as both ask for. First
every node of a key is verified against the key's smallest node only, which is linear in the postings. What that links is merged
by union-find; afterwards only pairs of nodes that share keys and still stand in different groups matter, and all of those are
verified. So no link between different groups is lost, while a large group of near copies costs a star, not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.session import discard, staged

BLOOM_BITS = 1 << 26
_PAGE = 1 << 15
SLOT_BITS, PACKED = 11, "slot int, own binary, local binary"
SKETCH_BITS = 2048


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, component), the component named by its smallest node.

    Large-star and small-star steps in turn until every node hangs on the root of its star. Each step reads a written table.
    """
    now = staged(spark, edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    while True:
        roots = now.select(F.col("u").alias("v")).distinct()
        crossed = now.join(roots, "v", "left_semi").select("v").limit(1)
        twice = now.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v").limit(1)
        if crossed.unionByName(twice).isEmpty():
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(spark, both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = staged(spark, both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").distinct())
        least = staged(spark, large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
        following = staged(spark, small)
        discard(spark, now, low, large, least)
        now = following


def bloom(spark: SparkSession, ids: DataFrame) -> np.ndarray:
    """Bitmap of BLOOM_BITS bits (its size never grows) that holds the first column's values; further values may seem held."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            places = bloom_places(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        table = bits.reshape(-1, _PAGE // 8)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([table[i].tobytes() for i in used], pa.binary())], names=["page", "bits"])

    def merged(pdf):
        return pdf.iloc[:1].assign(bits=[np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()])

    found = ids.mapInArrow(pages, "page long, bits binary").groupBy("page").applyInPandas(merged, "page long, bits binary").collect()
    out = np.zeros((BLOOM_BITS // _PAGE, _PAGE // 8), np.uint8)
    for page, bits in found:
        out[page] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def bloom_places(values: np.ndarray) -> np.ndarray:
    return (W.mix(values.astype(np.int64).view(np.uint64)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def in_bloom(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    places = bloom_places(values)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def jaccard_links(pairs: DataFrame, items: DataFrame, percent: int, sets: Sets) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union. items: (node, item); `sets` turns a column of items into
    (row, value), each distinct value of a row once."""

    def side(nodes: np.ndarray, items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the set of each row's item begins, its size, and the values: of equal nodes, once."""
        _, first, back = np.unique(nodes, return_index=True, return_inverse=True)
        rows, values = sets(items.take(pa.array(first)))
        size = np.bincount(rows, minlength=len(first))
        return (np.cumsum(size) - size)[back], size[back], values

    def common(left: tuple, right: tuple, n: int) -> np.ndarray:
        salt, row = np.uint64(0x9E3779B97F4A7C15), np.arange(n, dtype=np.uint64)
        one, two = (values[W.ragged(start, size)] + np.repeat(row * salt, size) for start, size, values in (left, right))
        one = np.sort(one)
        place = np.minimum(np.searchsorted(one, two), max(0, len(one) - 1))
        return np.bincount(np.repeat(row.view(np.int64), right[1])[one[place] == two], minlength=n) if len(one) else np.zeros(n, np.int64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in W.chunks(batch.column(2), W.CHUNK // 2):
                n = chunk.last - at
                ids = [batch.column(i).slice(at, n) for i in (0, 1)]
                left, right = (side(ids[i].to_numpy(), batch.column(2 + i).slice(at, n)) for i in (0, 1))
                size, other = left[1], right[1]
                fits = np.flatnonzero(100 * np.minimum(size, other) >= percent * np.maximum(size, other))
                size, other = size[fits], other[fits]
                both = common((left[0][fits], size, left[2]), (right[0][fits], other, right[2]), len(fits))
                keep = pa.array(fits[100 * both >= percent * (size + other - both)])
                yield pa.RecordBatch.from_arrays([i.take(keep) for i in ids], names=["a", "b"])
                at = chunk.last

    one = pairs.join(items.select(F.col("node").alias("b"), F.col("item").alias("of_b")), "b")
    two = one.join(items.select(F.col("node").alias("a"), F.col("item").alias("of_a")), "a")
    return two.select("a", "b", "of_a", "of_b").mapInArrow(judge, "a long, b long").distinct()


def _blobs(slot: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The rows of a table of numbers by slot: the slots, and the bytes of the rows of each."""
    order = np.argsort(slot, kind="stable")
    slots, first = np.unique(slot[order], return_index=True)
    edges = np.concatenate([first, [len(slot)]]).astype(np.int32) * np.int32(8 * numbers.shape[1])
    return slots, pa.Array.from_buffers(pa.binary(), len(slots), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(numbers[order]))])


def packed(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """Postings of a chunk as PACKED: (key, node) of the smallest node of each key in the chunk go to the slot of the key, (key, node,
    hub) of the others, whose hub that is, to a slot of key and node. A row for each slot, as Spark's cost is by row."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    hubs = np.minimum.reduceat(nodes, starts) if len(keys) else nodes
    low = hubs[np.cumsum(new) - 1]
    far = nodes != low
    to = lambda x: (W.mix(x.view(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int16)
    slots, own = _blobs(to(keys[starts]), np.stack([keys[starts], hubs], 1))
    others, local = _blobs(to(keys[far] ^ nodes[far]), np.stack([keys[far], nodes[far], low[far]], 1))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([slots, others]).astype(np.int32)), pa.chunked_array([own, pa.nulls(len(others), pa.binary())]).combine_chunks(),
                                       pa.chunked_array([pa.nulls(len(slots), pa.binary()), local]).combine_chunks()], names=["slot", "own", "local"])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    blobs = column.drop_null()
    if not len(blobs):
        return np.zeros((0, width), np.int64)
    edges = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset: blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2], np.uint8)[edges[0]: edges[-1]].copy().view(np.int64).reshape(-1, width)


def with_hubs(postings: DataFrame) -> DataFrame:
    """(key, node, hub) with node > hub, of the keys that several nodes have, in one exchange. Hubs lead to the key's smallest node.

    postings come as `packed` made them, with the smallest node of their key in their chunk as hub. Only these meet by key, one for each
    chunk at most, however many nodes share the key; the others are dealt by key and node, and keep their hub.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by slot. The last slot of a batch may go on in the next."""
        held = None

        def found(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, node = _unpacked(batch.column(1), 2).T
            order = np.argsort(key)
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            low = np.minimum.reduceat(node, np.flatnonzero(new))[np.cumsum(new) - 1] if len(key) else node
            far = node != low
            local = _unpacked(batch.column(2), 3)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip((key[far], node[far], low[far]), local.T, strict=True)], names=["key", "node", "hub"])

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            slot = batch.column(0).to_numpy()
            whole = int(np.searchsorted(slot, slot[-1])) if len(slot) else 0
            held = batch.slice(whole)
            if whole:
                yield found(batch.slice(0, whole))
        if held is not None and held.num_rows:
            yield found(held)

    return postings.repartition("slot").sortWithinPartitions("slot").mapInArrow(met, "key long, node long, hub long")


def sketches(items: DataFrame, sets: Sets) -> DataFrame:
    """(node, size, slack, s0, s1, ...): SKETCH_BITS bits in words of 64, of which each value of the node's set sets one, and by how many
    the set is larger than the bits it set. Two sets have no more values in common than bits in common and the smaller slack."""
    words = SKETCH_BITS // 64

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                n = chunk.last - chunk.first
                rows, values = sets(batch.column(1).slice(chunk.first, n))
                bits = np.zeros((n, SKETCH_BITS), bool)
                bits[rows, (W.mix(values) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)] = True
                size = np.bincount(rows, minlength=n)
                table = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, n), pa.array(size), pa.array(size - bits.sum(axis=1)), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(words))],
                                                 names=["node", "size", "slack", *(f"s{k}" for k in range(words))])

    return items.mapInArrow(drawn, "node long, size long, slack long, " + ", ".join(f"s{k} long" for k in range(words)))


def sketches_allow(percent: int) -> Column:
    """Whether the sketches _a and _b of a pair leave a similarity of `percent` possible."""
    both = F.least("slack_a", "slack_b")
    for k in range(SKETCH_BITS // 64):
        both += F.bit_count(F.col(f"s{k}_a").bitwiseAND(F.col(f"s{k}_b"))).cast("long")
    return (100 + percent) * both >= percent * (F.col("size_a") + F.col("size_b"))


def groups(spark: SparkSession, met: DataFrame, percent: int, items_of: Callable[[np.ndarray], DataFrame],
           sets: Sets) -> DataFrame:
    """(node, component) of the nodes that are linked with any other.

    met: (key, node, hub) with node != hub, as of `with_hubs`; every node that shares a key stands in one of the two. Or it carries
    `of` and `of_hub`, structs of size, need and the key's place in the node's set: partners must share at least the smaller of
    their needs, sizes must allow the similarity, and so must places: what two sets share begins with their first common key, and
    the rest of either set is as long as that, so each of the first `need` common keys leaves enough. items_of(bitmap) gives (node, item) for the nodes in the bitmap, at least.
    """
    if "of" not in met.columns:
        return _groups_by_sketch(spark, met, percent, items_of, sets)

    need = F.least("of_a.need", "of_b.need")
    ahead = F.least(F.col("of_a.size") - F.col("of_a.place"), F.col("of_b.size") - F.col("of_b.place"))
    sizes = F.col("of_a.size") + F.col("of_b.size")
    possible = ((100 * F.least("of_a.size", "of_b.size") >= percent * F.greatest("of_a.size", "of_b.size"))
                & ((100 + percent) * (ahead + F.least(need - 1, "of_a.before", "of_b.before")) >= percent * sizes))

    def candidates(shared: DataFrame) -> DataFrame:
        """Pairs from rows (a, b, of_a, of_b), one for each key that the two share."""
        fits = (F.count("*") >= F.min(need)) & ((100 + percent) * F.max(ahead) >= percent * F.min(sizes))
        return shared.where(possible).groupBy("a", "b").agg(fits.alias("fits")).where("fits").select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        return staged(spark, jaccard_links(pairs, staged(spark, items_of(bloom(spark, ids))), percent, sets))

    live = staged(spark, met)
    star = staged(spark, candidates(live.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("of_hub").alias("of_a"), F.col("of").alias("of_b"))))
    links = verified(star)
    found = staged(spark, components(spark, links))
    labelled = staged(spark, live.select("key", "node", "of").join(found, "node", "left").select("key", "node", "of", F.coalesce("component", "node").alias("label")))
    still_open = staged(spark, labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
    rest = staged(spark, labelled.join(still_open, "key", "left_semi"))
    one, two = (rest.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "of", "label"))) for side in ("a", "b"))
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
    crossing = one.join(two.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & apart & possible).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "of_a", "of_b")
    pairs = staged(spark, candidates(crossing).join(star, ["a", "b"], "left_anti"))
    discard(spark, live, labelled, still_open, rest)
    further = None if pairs.isEmpty() else verified(pairs)
    if further is None or further.isEmpty():
        return found
    return staged(spark, components(spark, links.unionByName(further)))


def _groups_by_sketch(spark: SparkSession, met: DataFrame, percent: int, items_of: Callable[[np.ndarray], DataFrame], sets: Sets) -> DataFrame:
    """`groups` of postings that tell nothing of their sets: sketches keep pairs that can't be alike from being verified."""
    live = staged(spark, met)
    star = staged(spark, live.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    nodes = star.select(F.explode(F.array("a", "b")).alias("node"))
    items = staged(spark, items_of(bloom(spark, nodes)))
    links = staged(spark, jaccard_links(star, items, percent, sets))
    found = staged(spark, components(spark, links))
    every = live.select("key", F.explode(F.array("node", "hub")).alias("node")).distinct()
    labelled = staged(spark, every.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")))
    still_open = staged(spark, labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
    rest = staged(spark, labelled.join(still_open, "key", "left_semi"))
    drawn = staged(spark, sketches(items.join(rest.select("node").distinct(), "node", "left_semi"), sets))
    told = staged(spark, rest.join(drawn, "node"))
    one, two = (told.select(*(F.col(c).alias(f"{c}_{side}") for c in told.columns)) for side in ("a", "b"))
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
    crossing = one.join(two, (F.col("key_a") == F.col("key_b")) & apart & sketches_allow(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    pairs = staged(spark, crossing.distinct().join(star, ["a", "b"], "left_anti"))
    discard(spark, live, labelled, still_open, rest, drawn, told)
    further = None if pairs.isEmpty() else staged(spark, jaccard_links(pairs, items, percent, sets))
    if further is None or further.isEmpty():
        return found
    return staged(spark, components(spark, links.unionByName(further)))

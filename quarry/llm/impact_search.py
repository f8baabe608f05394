"""Ranked lexical search by the Best Position Algorithm over impact lists.

Terms are maximal runs of letters beyond ASCII, digits and a-z; only A-Z are lower-cased. A task turns its documents into shards: for every
query term the postings of the shard's documents, as term, document and occurrences. They are stored once, with each document's length; the
corpus's counts (documents with terms, terms, documents of each query term) come from the stored shards. Then, shard by shard, each query term gets
an impact list in descending order of impact, and each item is searched by the Best Position Algorithm: sorted accesses read all
lists of the item side by side, direct accesses fetch a new document's other impacts and mark its positions in their lists as seen,
and the threshold is the sum of the impacts at the best positions, the ends of the prefixes that have been seen without a gap, which
are never before the positions last read. The search stops when the threshold lies strictly below the k-th best score, so documents
that tie with it are all seen. Scores found in a task's earlier shards count from the beginning. A task puts out k rows for an
item at most; a window ranks them over all tasks.

Words are compared as bytes. Items travel with the tasks in blocks of at most BLOCK_BYTES of text; more items take further passes.

Nulls: null and empty texts have no terms and are never found; they count in neither N nor L. Null ids of documents rank behind others of the same
score. Rows are documents: repeated ids are ranked each. Rows of items that share an id, a null one too, are one item, whose terms are those of its
distinct texts; items without terms have no rows. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.session import staged

BLOCK_BYTES, SHARD_WORDS, STEP = 8 << 20, 1 << 22, 16
#: Fixed values of the score.
SCALE, ONE, K1_TF, K1_LEN, FLAT, SLOPE = 1000, 1_000_000_000, 1000, 8, 25, 75
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHARD = "docs long, words long, ids binary, nulls binary, sizes binary, firsts binary, terms binary, times binary"


def lowered(chunk: W.Chunk) -> tuple[W.Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk in lower case; start and end of its terms; first term of each text."""
    low = W.Chunk(chunk.first, chunk.last, _LOWER[chunk.buf], chunk.offsets)
    return low, *W.spans(low, W.NOT_ALPHANUMERIC)


def term_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Terms at even places, what lies between them at odd ones."""
    if not len(starts):
        return pa.array([], pa.large_binary())
    edges = np.stack([starts, ends], axis=1).reshape(-1)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(buf)])


class Items:
    """A block of items: the distinct terms of all, and the terms of each with repeats."""

    def __init__(self, items: list[tuple]):
        by_id: dict = {}
        for name, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            by_id.setdefault(name, []).append(text)
        self.names = list(by_id)
        held: dict[bytes, int] = {}
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []
        for texts in by_id.values():
            own: list[int] = []
            for chunk in W.chunks(pa.array(texts, pa.large_string())):
                low, starts, ends, _ = lowered(chunk)
                own += [held.setdefault(low.buf[a:b].tobytes(), len(held)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            self.terms.append(np.unique(np.array(own, np.int64), return_counts=True))
        self.vocabulary = pa.array(list(held), pa.large_binary())


class Shard:
    """Postings of documents as they come, for a block of items."""

    def __init__(self):
        self.parts, self.words, self.docs = [], 0, 0

    def add(self, ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        some = sizes > 0
        place = np.cumsum(some) - 1
        self.parts.append((ids[some], nulls[some], sizes[some], np.bincount(place[doc], minlength=int(some.sum())), term, times))
        self.words += int(sizes.sum())
        self.docs += int(some.sum())

    def packed(self) -> pa.RecordBatch:
        ids, nulls, sizes, counts, term, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        firsts = np.concatenate([[0], np.cumsum(counts)])
        data = [(ids, "<i8"), (nulls, "u1"), (sizes, "<i8"), (firsts, "<i8"), (term, "<i4"), (times, "<i4")]
        columns = [pa.array([self.docs]), pa.array([self.words]), *(pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in data)]
        return pa.RecordBatch.from_arrays(columns, names=["docs", "words", "ids", "nulls", "sizes", "firsts", "terms", "times"])


def _postings(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    kinds, shard = max(1, len(items.vocabulary)), Shard()
    for batch in batches:
        for chunk in W.chunks(batch.column(1)):
            low, starts, ends, first = lowered(chunk)
            found = pc.fill_null(pc.index_in(term_array(low.buf, starts, ends), items.vocabulary), -1).to_numpy()[::2].astype(np.int64)
            doc = W.owners(first)
            own, times = np.unique(doc[found >= 0] * kinds + found[found >= 0], return_counts=True)
            column = batch.column(0).slice(chunk.first, chunk.last - chunk.first)
            shard.add(pc.fill_null(column, 0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False), np.diff(first), own // kinds, own % kinds, times)
            if shard.words >= SHARD_WORDS:
                yield shard.packed()
                shard = Shard()
    if shard.docs:
        yield shard.packed()


class Impacts:
    """Impact lists of a shard, with direct access by document."""

    def __init__(self, row: dict, weights: np.ndarray, documents: int, words: int):
        self.ids, self.sizes, self.firsts = (np.frombuffer(row[c], "<i8") for c in ("ids", "sizes", "firsts"))
        self.nulls, self.terms, times = np.frombuffer(row["nulls"], "u1"), np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["times"], "<i4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.firsts))
        m = FLAT + np.array([SLOPE * n * documents // words for n in self.sizes.tolist()], np.int64)
        self.impact = weights[self.terms] * (ONE * times // (K1_TF * times + K1_LEN * m[self.doc]))
        order = np.lexsort((-self.impact, self.terms))
        self.lists = order  # postings by term, in each from the greatest impact
        self.bounds = np.searchsorted(self.terms[order], np.arange(len(weights) + 1))
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order))

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the k best, and their scores; held: the k best scores so far, ascending."""
        begin, end = self.bounds[terms], self.bounds[terms + 1]
        factor = np.zeros(len(self.bounds), np.int64)
        factor[terms] = repeats
        known = np.zeros(len(self.ids), bool)
        seen = np.zeros(len(self.lists), bool)
        at, best, step = begin.copy(), begin.copy(), STEP
        docs, scores = [], []
        while (at < end).any():
            # sorted accesses: the next rows of every list
            many = np.minimum(step, end - at)
            rows = W.ragged(at, many)
            at, step = at + many, 2 * step
            new = np.unique(self.doc[self.lists[rows]])
            new = new[~known[new]]
            known[new] = True
            # direct accesses: what else the new documents hold, and where that stands in the other lists
            counts = self.firsts[new + 1] - self.firsts[new]
            own = W.ragged(self.firsts[new], counts)
            times = factor[self.terms[own]]
            seen[self.position[own[times > 0]]] = True
            if len(new):
                docs.append(new)
                scores.append(np.add.reduceat(times * self.impact[own], np.cumsum(counts) - counts))
                found = scores[-1]
                held = np.sort(np.concatenate([held, np.partition(found, len(found) - k)[len(found) - k:] if len(found) > k else found]))[-k:]
            # best positions: where the seen prefix of each list ends
            for i in np.flatnonzero(best < end):
                low, high = int(max(best[i], at[i])), int(end[i])
                width = 64
                while low < high:
                    gap = np.flatnonzero(~seen[low: min(high, low + width)])
                    if len(gap):
                        low += int(gap[0])
                        break
                    low, width = min(high, low + width), 4 * width
                best[i] = low
            last = np.maximum(best - 1, begin)
            ahead = np.where(best < end, repeats * self.impact[self.lists[np.minimum(last, len(self.lists) - 1)]], 0)
            if len(held) == k and ahead.sum() < held[0]:
                break
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = scores >= max(1, held[0] if len(held) == k else 1)
        return docs[keep], scores[keep]


def _best(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, documents: int, words: int, k: int) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    top = [(none, none, none) for _ in items.names]  # scores, null ids, ids
    for batch in batches:
        for row in batch.to_pylist():
            shard = Impacts(row, weights, documents, words)
            for i, (terms, repeats) in enumerate(items.terms):
                if not len(terms):
                    continue
                score, null, ids = top[i]
                docs, found = shard.search(terms, repeats, k, np.sort(score)[-k:])
                score, null, ids = np.concatenate([score, found]), np.concatenate([null, shard.nulls[docs]]), np.concatenate([ids, shard.ids[docs]])
                order = np.lexsort((ids, null, -score))[:k]
                top[i] = score[order], null[order], ids[order]
    for i, (score, null, ids) in enumerate(top):
        if len(score):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(ids, mask=null.astype(bool)), pa.array(score)], names=["item", "id", "score"])


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Items in order of id; rows of one id stay together."""
    block, held = [], 0
    for row in items.orderBy("item", "words").toLocalIterator():
        if held >= size and row[0] != block[-1][0]:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    if block:
        yield block


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_col, rank (from 1), id_col, score: the k best documents of each item with a score above 0; ties by ascending id."""
    kind = items.schema[item_col].dataType
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("words")).where(F.col("words").isNotNull()).distinct()
    found = []
    for block in _blocks(asked, block_bytes):
        told = Items(block)
        sent = spark.sparkContext.broadcast(told)
        shards = staged(spark, texts.mapInArrow(lambda it, sent=sent: _postings(it, sent.value), _SHARD))
        documents, words = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        df = np.zeros(len(told.vocabulary), np.int64)
        for term, n in shards.select("terms").mapInArrow(_held, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each term of the block at most
            df[term] = n
        weights = np.array([math.floor(SCALE * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        best = shards.mapInArrow(lambda it, sent=sent, weights=weights, documents=documents, words=words: _best(it, sent.value, weights, documents, words, k),
                                 "item int, id long, score long")
        ahead = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = best.withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, n) for i, n in enumerate(told.names)], f"item int, name {kind.simpleString()}")
        found.append(ranked.join(names, "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not found:
        return spark.createDataFrame([], f"{item_col} {kind.simpleString()}, rank int, {id_col} long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term in a shard: a document has one posting for it."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            term, n = np.unique(np.frombuffer(data, "<i4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])


def brute(rows: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """Plain version for tests: (item, rank, id, score)."""
    import re
    from collections import Counter

    def split(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    docs = [(i, Counter(split(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, words = len(docs), sum(s for *_, s in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked: dict = {}
    for name, text in sorted({x for x in items if x[1] is not None}, key=str):
        asked.setdefault(name, Counter()).update(split(text))
    out = []
    for name, terms in asked.items():
        scores = []
        for i, c, size in docs:
            m = 100 - 75 + 75 * size * n // words
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in terms.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(name, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out

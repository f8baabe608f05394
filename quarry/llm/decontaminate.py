"""Benchmark decontamination with an FM-index per training shard.

A task cuts its documents into shards. Words that no benchmark item holds become separators, and runs of words between
separators that are shorter than the shortest window are left out, since no window fits into them. Over the rest of the shard it
builds a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All windows of all items
are searched backwards at once; the rows that remain are located by walking to a sampled position, and their spans merged.

The items travel with the tasks in blocks of at most BLOCK_BYTES of text; more items take further passes over the documents, in
which spans and items found so far ride along. Nothing is shuffled.

Nulls: a null text has no words; items with a null id are left out. Repeated rows of documents are each judged; items that share
an id count as one. Empty tables give no rows, or rows without hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.session import staged

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 3 << 20
SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling. Each separator (0) is smaller than any word and unique, ordered by position."""
    n = len(symbols)
    key = symbols.astype(np.int64)
    gaps = np.flatnonzero(key == 0)
    key[gaps] = np.arange(len(gaps)) - len(gaps)
    step = 0
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n - 1:
            return order
        step = max(1, 2 * step)
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1


class FMIndex:
    """Backward search and locating over an array of symbols in which 0 separates runs."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_array(symbols)
        last = symbols[order - 1]
        last[order == 0] = 0
        self.size = len(symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        column = last.astype(np.int64)
        for bit in range(max(1, int(n_symbols).bit_length()) - 1, -1, -1):
            ones = (column >> bit) & 1
            before = np.zeros(self.size + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = self.size - int(before[-1])
            self.levels.append((bit, before, zeros))
            column = np.concatenate([column[ones == 0], column[ones == 1]])
        self.last = last
        sampled = np.zeros(self.size, bool)
        sampled[::SAMPLE] = True
        sampled[0] = True
        sampled[1:] |= symbols[:-1] == 0
        self.marked = sampled[order]
        self.marks_before = np.concatenate([[0], np.cumsum(self.marked)])
        self.positions = order[self.marked]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before a row, down the wavelet matrix."""
        low = np.zeros(len(symbol), np.int64)
        high = upto.astype(np.int64)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            high = np.where(one, zeros + before[high], high - before[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of one length (rows of symbols): those that occur, and their rows from and to."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low = self.below[symbol] + self.rank(symbol, low)
            high = self.below[symbol] + self.rank(symbol, high)
            some = high > low
            live, low, high = live[some], low[some], high[some]
            if not len(live):
                break
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row: steps back to a sampled one. Run starts are sampled, so no step crosses a separator."""
        out, steps = np.zeros(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            found = self.marked[at]
            out[todo[found]] = self.positions[self.marks_before[at[found]]] + steps
            todo, at, steps = todo[~found], at[~found], steps + 1
            if len(todo):
                symbol = self.last[at].astype(np.int64)
                at = self.below[symbol] + self.rank(symbol, at)
        return out


class Phrases:
    """All windows of a block of items as symbols, by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        items = sorted((i, t) for i, t in items if t)
        column = pa.array([t for _, t in items], pa.large_string())
        found: dict[bytes, set[int]] = {}
        hashes = [np.zeros(0, np.uint64)]
        texts: list[tuple[int, np.ndarray]] = []
        for chunk in W.chunks(column):
            starts, ends, first = W.spans(chunk, W.NOT_ALPHANUMERIC)
            h = W.span_hashes(chunk.buf, starts, ends)
            hashes.append(h)
            texts += [(chunk.first + i, h[first[i]: first[i + 1]]) for i in range(chunk.last - chunk.first)]
        self.names = [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate(hashes))
        for item, h in texts:
            ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
            for at in range(max(1, len(ids) - window + 1) if len(ids) else 0):
                found.setdefault(ids[at: at + window].tobytes(), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for length in sorted({len(k) // 4 for k in found}):
            keys = [k for k in found if len(k) == 4 * length]
            self.by_length[length] = (np.frombuffer(b"".join(keys), np.int32).reshape(-1, length).astype(np.int64),
                                      [np.array(sorted(found[k])) for k in keys])
        self.shortest = min(self.by_length, default=0)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.vocabulary >> np.uint64(48)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word from 1, or 0 where no item holds it."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def shard_hits(phrases: Phrases, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a shard (symbol and text of each): spans found (first word, length) and distinct (text, item)."""
    none = np.zeros(0, np.int64)
    known = symbols > 0
    broken = np.ones(len(symbols) + 1, bool)
    broken[1:-1] = ~known[1:] | ~known[:-1] | (doc[1:] != doc[:-1])
    edges = np.flatnonzero(broken)
    length = np.diff(edges)
    keep = known[edges[:-1]] & (length >= phrases.shortest) if len(symbols) else np.zeros(0, bool)
    begin, length = edges[:-1][keep], length[keep]
    if not len(begin) or not phrases.by_length:
        return none, none, none, none
    word = W.ragged(begin, length)
    place = np.arange(len(word)) + np.repeat(np.arange(len(begin)), length)
    text, origin = np.zeros(len(word) + len(begin), np.int64), np.zeros(len(word) + len(begin), np.int64)
    text[place], origin[place] = symbols[word], word
    index = FMIndex(text, len(phrases.vocabulary))
    starts, sizes, pairs = [], [], []
    for size, (table, items) in phrases.by_length.items():
        live, low, high = index.search(table)
        if not len(live):
            continue
        at = origin[index.locate(W.ragged(low, high - low))]
        starts.append(at)
        sizes.append(np.full(len(at), size))
        which = np.repeat(live, high - low)
        counts = np.array([len(x) for x in items])[which]
        pairs.append(np.stack([np.repeat(doc[at], counts), np.concatenate([items[i] for i in which])]))
    if not starts:
        return none, none, none, none
    both = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return np.concatenate(starts), np.concatenate(sizes), both[0], both[1]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def _judge(batches: Iterator[pa.RecordBatch], phrases: Phrases, more: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        earlier = "items" in batch.schema.names
        for chunk in W.chunks(batch.column(1), SHARD_BYTES):
            n = chunk.last - chunk.first
            part = batch.slice(chunk.first, n)
            starts, ends, first = W.spans(chunk, W.NOT_ALPHANUMERIC)
            doc = W.owners(first)
            symbols = phrases.symbols(W.span_hashes(chunk.buf, starts, ends)) if len(phrases.vocabulary) else np.zeros(len(starts), np.int64)
            at, size, docs, items = shard_hits(phrases, symbols, doc)
            depth = np.bincount(at, minlength=len(starts) + 1)[: len(starts) + 1] - np.bincount(at + size, minlength=len(starts) + 1)[: len(starts) + 1]
            hit = np.cumsum(depth)[:-1] > 0
            names: list[list[str]] = [[] for _ in range(n)]
            for d, i in zip(docs.tolist(), items.tolist(), strict=True):
                names[d].append(phrases.names[i])
            if earlier:
                for d, (old_names, old_spans) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    names[d] += old_names
                    for s in old_spans:
                        hit[first[d] + s["start"]: first[d] + s["end"]] = True
            before = np.concatenate([[0], np.cumsum(hit)])
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            cut = np.union1d(edge, first[1:-1][hit[np.minimum(first[1:-1], max(len(hit) - 1, 0))] & hit[first[1:-1] - 1]] if len(hit) else edge)
            merged: list[list[dict]] = [[] for _ in range(n)]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hit[a]:
                    merged[doc[a]].append({"start": a - int(first[doc[a]]), "end": b - int(first[doc[a]])})
            columns = [part.column(0)] + ([part.column(1)] if more else []) + [
                pa.array(np.diff(first)), pa.array(before[first[1:]] - before[first[:-1]]),
                pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())), pa.array(merged, SPANS)]
            if more:
                columns = columns[:2] + columns[4:]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "items", "spans"] if more else ["id", "n_words", "n_hit", "items", "spans"])


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[str, str]]]:
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted names), spans (merged, in words), contaminated (a twentieth hit or more)."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("words")).dropna()
    blocks = _blocks(named, block_bytes)
    block = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        sent, more = spark.sparkContext.broadcast(Phrases(block, window)), following is not None
        schema = f"id {kind}, text string, items array<string>, spans array<struct<start: long, end: long>>" if more else f"id {kind}, {FIELDS}"
        out = out.mapInArrow(lambda it, sent=sent, more=more: _judge(it, sent.value, more), schema)
        block = following
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("id", id_col)


def flagged(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", mark: str = "_contaminated", **options) -> DataFrame:
    """All rows and columns of docs, and `mark`, which must not be one of them: judged where they are, each row's text under its hash for the join back."""
    key = W.fresh("key")
    told = docs.withColumn(key, F.struct(F.xxhash64(text_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("string"))
    judged = contamination(spark, told.select(key, F.col(text_col).alias("text")), items, id_col=key, **options)
    goes = staged(spark, judged.where("contaminated").select(key).distinct())
    kept = told.join(goes.withColumn(mark, F.lit(True)), key, "left")
    return kept.withColumn(mark, F.coalesce(F.col(mark), F.lit(False))).drop(key)


def digest(column: str = "items"):
    return F.sha2(F.concat_ws(",", F.col(column)).cast("binary"), 256)


def brute(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """Plain version for tests: (n_words, n_hit, items)."""
    import re

    def split(s):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    mine, hit, names = split(text), set(), set()
    for name, other in items:
        theirs = split(other)
        for i in range(max(1, len(theirs) - window + 1) if theirs else 0):
            phrase = theirs[i: i + window]
            for j in range(len(mine) - len(phrase) + 1):
                if mine[j: j + len(phrase)] == phrase:
                    hit.update(range(j, j + len(phrase)))
                    names.add(name)
    return len(mine), len(hit), sorted(names)

"""Fuzzy line deduplication: MinHash signatures, banding, exact verification, union-find; one line of each group stays.

A line's set is its distinct shingles of SHINGLE characters (a shorter line is one shingle). One-permutation hashing gives a
signature of BANDS * ROWS bins in one pass over the characters, with empty bins filled from others by a fixed rule. Lines that
agree in all rows of a band are candidates; candidates are verified on their whole sets, two lines linking at a Jaccard similarity
of PERCENT or more. Equal lines are one node (by 64-bit digest) before any of this. With 18 bands of 8 rows a pair is a candidate
with probability 0.96 at a similarity of 0.8, 0.997 at 0.85 and over 0.9999 at 0.9.

Of each group the occurrence with the smallest (id, line number) stays. Lines without a visible character never count as
duplicates. Nulls and empty texts have no lines; lines of a document with a null id are never dropped; rows that share an id count
as one document. Other columns are not read, and pass through `without_lines` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import linking
from quarry.llm import words as W
from quarry.session import staged

SHINGLE, BANDS, ROWS, PERCENT, TABLES = 5, 18, 8, 80, 4
SLICE = 1 << 17
_U = np.uint64
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_MANY = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_DRAWS = np.random.default_rng(11).integers(0, 1 << 31, 1 << 13)
_EMPTY = np.uint32(0xFFFFFFFF)


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the number of characters that begin before each byte (one more than bytes)."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    padded = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.uint32)
    b = padded[at]
    out = b.copy()
    for least, keep, extra in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        wide = np.flatnonzero(b >= least)
        value = b[wide] & keep
        for k in range(1, extra + 1):
            value = (value << 6) | (padded[at[wide] + k] & 0x3F)
        out[wide] = value
    return out, np.concatenate([[0], np.cumsum(lead)])


def _windows(points: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle of the lines first..last (in characters); a short line is one shingle."""
    length = last - first
    total, wide = np.zeros(len(points), np.uint64), points.astype(np.uint64)
    for k in range(min(width, len(points))):
        total[: len(points) - k] += wide[k:] * _MANY[k]
    long = np.flatnonzero(length >= width)
    counts = length[long] - width + 1
    line, values = np.repeat(long, counts), total[W.ragged(first[long], counts)]
    short = np.flatnonzero((length < width) & (length > 0))
    if len(short):
        extra = length[short].astype(np.uint64) * _MANY[62]
        for k in range(width - 1):
            has = length[short] > k
            extra[has] += points[first[short[has]] + k].astype(np.uint64) * _MANY[k]
        line, values = np.concatenate([line, short]), np.concatenate([values, extra])
    return line, W.mix(values)


def signatures(line: np.ndarray, values: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One-permutation MinHash in TABLES tables: per line and bin the smallest value; an empty bin takes that of a bin of its table
    drawn by a fixed rule."""
    each = bins // TABLES
    out = np.empty((n, TABLES, each), np.uint32)
    base, v, where = line * each, np.empty_like(values), np.empty_like(values)
    for t in range(TABLES):
        np.multiply(values, _MANY[50 + t], out=v)
        np.right_shift(v, _U(40), out=where)
        where *= _U(each)
        where >>= _U(24)
        place = where.view(np.int64)
        place += base
        v >>= _U(8)
        least = v.astype(np.uint32)
        np.minimum(least, _EMPTY - np.uint32(1), out=least)
        table = np.full(n * each, _EMPTY, np.uint32)
        np.minimum.at(table, place, least)
        full = table != _EMPTY
        bare = np.flatnonzero(~full)
        column, row, turn = bare % each, bare - bare % each, 0
        while len(bare):
            turn += 1
            drawn = _DRAWS[(column * 64 + turn) % len(_DRAWS)] % each if turn <= 64 else (column + turn - 64) % each
            done = full[row + drawn]
            table[bare[done]] = table[(row + drawn)[done]]
            bare, column, row = bare[~done], column[~done], row[~done]
        out[:, t] = table.reshape(n, each)
    return out.reshape(n, bins)


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(table), bands), np.uint64)
    parts = table.reshape(len(table), bands, rows)
    for k in range(rows):
        keys += W.mix(parts[:, :, k].astype(np.uint64) * _MANY[20 + k])
    return W.mix(keys + np.arange(bands, dtype=np.uint64) * _MANY[40])


class Lines:
    """Lines with a visible character of a chunk: text, number within it, digest, and bounds in bytes."""

    def __init__(self, chunk: W.Chunk):
        gaps = np.flatnonzero(chunk.buf == 10)
        doc_of_gap = np.searchsorted(chunk.offsets, gaps, "right") - 1
        edges = np.concatenate([chunk.offsets[:-1], gaps + 1])
        doc = np.concatenate([np.arange(len(chunk.offsets) - 1), doc_of_gap])
        order = np.lexsort((edges, doc))
        self.doc, start = doc[order], edges[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        same = np.zeros(len(start), bool)
        same[:-1] = self.doc[1:] == self.doc[:-1]
        end = np.where(same, end, chunk.offsets[self.doc + 1])
        self.start, self.end = start, end
        first = np.searchsorted(self.doc, np.arange(len(chunk.offsets) - 1))
        self.number = np.arange(len(start)) - first[self.doc]
        visible = np.concatenate([[0], np.cumsum(~W.BLANKS[chunk.buf])])
        self.visible = visible[self.end] > visible[self.start]
        self.digest = W.span_hashes(chunk.buf, self.start, self.end, fold=False)
        self.empty = np.diff(chunk.offsets) == 0


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch.column(1)):
            lines = Lines(chunk)
            node = pa.array(lines.digest.view(np.int64), mask=~lines.visible)
            number = np.where(lines.empty[lines.doc], -1, lines.number)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.last - chunk.first).take(pa.array(lines.doc)), pa.array(number, pa.int64()), node],
                                             names=["id", "line", "node"])


def _slices(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of lines of about SLICE characters: their arrays stay in the processor's cache."""
    ends, at = np.cumsum(length), 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + SLICE, "right")))
        yield at, to
        at = to


def _keys(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(key, node, hub) of all lines, packed for `linking.with_hubs`; hub: the smallest node that has the key in this chunk of texts."""
    for batch in batches:
        for chunk in W.chunks(batch.column(0)):
            lines = Lines(chunk)
            _, pick = np.unique(lines.digest[lines.visible], return_index=True)
            pick = np.sort(np.flatnonzero(lines.visible)[pick])
            points, before = characters(chunk.buf)
            first, last = before[lines.start[pick]], before[lines.end[pick]]
            keys = np.empty((len(pick), bands), np.uint64)
            for at, to in _slices(last - first):
                low, high = first[at], last[to - 1]
                line, values = _windows(points[low: high], first[at: to] - low, last[at: to] - low, shingle)
                keys[at: to] = band_keys(signatures(line, values, to - at, bands * rows), bands, rows)
            yield linking.packed(keys.reshape(-1).view(np.int64), np.repeat(lines.digest[pick].view(np.int64), bands))


def _texts(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch.column(0)):
            lines = Lines(chunk)
            pick = np.flatnonzero(lines.visible)
            pick = pick[linking.in_bloom(wanted, lines.digest[pick].view(np.int64))]
            _, once = np.unique(lines.digest[pick], return_index=True)
            pick = pick[once]
            size = lines.end[pick] - lines.start[pick]
            data = chunk.buf[W.ragged(lines.start[pick], size)]
            item = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(lines.digest[pick].view(np.int64)), item], names=["node", "item"])


def line_sets(items: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    chunk = next(W.chunks(items, 1 << 40))
    points, before = characters(chunk.buf)
    return W.distinct(*_windows(points, before[chunk.offsets[:-1]], before[chunk.offsets[1:]], shingle))


def fuzzy_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """Per distinct id: id, n_lines, dropped (sorted numbers of the lines that go, from 0)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    only = texts.select("text").where("text is not null")
    seen = staged(spark, texts.mapInArrow(_occurrences, f"id {docs.schema[id_col].dataType.simpleString()}, line long, node long"))
    postings = only.mapInArrow(lambda it: _keys(it, shingle, bands, rows), linking.PACKED)
    found = linking.groups(spark, linking.with_hubs(postings), percent, lambda wanted: only.mapInArrow(lambda it: _texts(it, wanted), "node long, item binary").dropDuplicates(["node"]),
                           lambda items: line_sets(items, shingle))
    named = staged(spark, seen.join(found, "node", "left").select("id", "line", F.coalesce("component", "node").alias("group")))
    stays = staged(spark, named.where("group is not null and id is not null").groupBy("group").agg(F.min(F.struct("id", "line")).alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = named.join(stays, "group", "left")
    goes = F.when(F.struct("id", "line") != F.col("stays"), F.col("line"))
    return marked.groupBy("id").agg((F.max("line") + 1).alias("n_lines"), F.array_sort(F.collect_set(goes)).alias("dropped")).withColumnRenamed("id", id_col)


def without_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the text left after the lines in `dropped` go; all rows and columns stay."""
    own, numbers = W.fresh("id"), W.fresh("dropped")
    goes = drops.where(F.size("dropped") > 0).select(F.col(id_col).alias(own), F.col("dropped").alias(numbers))
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))), lambda s: ~F.array_contains(numbers, s["i"]))
    text = F.when(F.col(numbers).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return docs.join(goes, F.col(id_col) == F.col(own), "left").withColumn(text_col, text).select(*docs.columns)


def brute(rows: list[tuple[int, str | None]], shingle: int = SHINGLE, percent: int = PERCENT) -> dict[int, list[int]]:
    """Plain version for tests: lines that go, for each id."""
    seen = sorted((i, n, line) for i, t in rows if t for n, line in enumerate(t.split("\n")) if line.strip(" \t\n\v\f\r"))
    sets = [{line[k: k + shingle] for k in range(max(1, len(line) - shingle + 1))} for _, _, line in seen]
    up = list(range(len(seen)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in range(len(seen)):
        for j in range(k):
            if 100 * len(sets[j] & sets[k]) >= percent * len(sets[j] | sets[k]):
                a, b = sorted((root(j), root(k)))
                up[b] = a
    out: dict[int, list[int]] = {i: [] for i, _ in rows}
    for k, (i, n, _) in enumerate(seen):
        if root(k) != k:
            out[i].append(n)
    return out

"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes cuts each text where its low bits are zero, at least LEAST and at most MOST bytes apart, so
cuts follow the content and an insertion moves only the chunks around it. Chunks are compared by a 128-bit digest. A run of
consecutive chunks that all occur elsewhere counts once it holds RUN words; of each chunk in a counted run the first occurrence, by id
and place, stays and the others are removed. With chunks of about 35 bytes a
passage of more than 50 words holds such a run but for rare draws of its cuts.

Nulls and empty texts have no chunks. Documents with a null id keep all their text and count as no occurrence. Rows that share an id
are one document. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.session import staged

LEAST, MOST, MASK, RUN = 8, 96, 31, 14
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)
SPANS = "array<struct<start: long, end: long>>"


def gear(buf: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + G[b[i]] in 32 bits for all places, by doubling the window; the top bits reach 32 bytes back."""
    h, width = _GEAR[buf], 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every chunk of every text."""
    marks = np.flatnonzero((gear(buf) >> np.uint32(27)) & np.uint32(MASK) == 0) + 1
    ends: list[int] = []
    of_text = np.searchsorted(marks, offsets).tolist()
    places, bounds = marks.tolist(), offsets.tolist()
    for t in range(len(bounds) - 1):
        last, stop = bounds[t], bounds[t + 1]
        for at in [*places[of_text[t]: of_text[t + 1]], stop]:
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST or (at == stop and at > last):
                ends.append(at)
                last = at
    out = np.array(ends, np.int64)
    begins = np.concatenate([[0], out[:-1]]) if len(out) else out
    return begins, out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch.column(1)):
            starts, ends = cuts(chunk.buf, chunk.offsets)
            doc = np.searchsorted(chunk.offsets, starts, "right") - 1
            blank = W.BLANKS[chunk.buf]
            begins = ~blank
            begins[1:] &= blank[:-1]
            words = np.concatenate([[0], np.cumsum(begins)])
            base = chunk.offsets[doc]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(chunk.first, chunk.last - chunk.first).take(pa.array(doc)), pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)),
                pa.array((words[ends] - words[starts]).astype(np.int32)), pa.array(W.span_hashes(chunk.buf, starts, ends, fold=False).view(np.int64)),
                pa.array(W.span_hashes(chunk.buf, starts, ends, fold=False, second=True).view(np.int64))], names=["id", "start", "end", "words", "d1", "d2"])


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counted runs of a document's repeated chunks, and what of them is removed."""
    for batch in batches:
        repeated, removed = [], []
        for chunks in batch.column(1).to_pylist():
            found, gone = [], []
            run: list[dict] = []
            for c in [*chunks, None]:
                if run and (c is None or c["start"] != run[-1]["end"]):
                    if sum(x["words"] for x in run) >= least:
                        found.append({"start": run[0]["start"], "end": run[-1]["end"]})
                        for x in run:
                            if x["kept"]:
                                continue
                            if gone and gone[-1]["end"] == x["start"]:
                                gone[-1]["end"] = x["end"]
                            else:
                                gone.append({"start": x["start"], "end": x["end"]})
                    run = []
                if c is not None:
                    run.append(c)
            repeated.append(found)
            removed.append(gone)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(repeated, kind), pa.array(removed, kind)], names=["id", "repeated", "removed"])


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """Per document: id, n_bytes, repeated and removed (spans in bytes of the UTF-8 text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunks = texts.where("id is not null").mapInArrow(_chunks, f"id {kind}, start int, end int, words int, d1 long, d2 long")
    shared = staged(spark, chunks.groupBy("d1", "d2").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    met = chunks.join(shared, ["d1", "d2"]).select("id", F.struct("start", "end", "words", (F.struct("id", "start") == F.col("first")).alias("kept")).alias("c"))
    by_doc = met.groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("chunks"))  # a document's own chunks
    found = staged(spark, by_doc.mapInArrow(lambda it: _runs(it, run), f"id {kind}, repeated {SPANS}, removed {SPANS}"))
    none = F.array().cast(SPANS)
    sizes = texts.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sizes.join(found, "id", "left").select(F.col("id").alias(id_col), "n_bytes", F.coalesce("repeated", none).alias("repeated"), F.coalesce("removed", none).alias("removed"))


def without_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the bytes in `removed`; a span gives up a character that it only holds a part of."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        def left(text, removed):
            if text is None or removed is None or not len(removed):
                return text
            data, at, parts = text.encode(), 0, []
            for s in removed:
                start, end = s["start"], s["end"]
                while start < len(data) and data[start] & 0xC0 == 0x80:
                    start += 1
                while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
                    end -= 1
                parts.append(data[at:start])
                at = max(end, start)
            return b"".join([*parts, data[at:]]).decode()

        return pd.Series([left(t, s) for t, s in zip(texts, spans, strict=True)])

    own, spans = W.fresh("id"), W.fresh("removed")
    goes = found.where("size(removed) > 0").select(F.col(id_col).alias(own), F.col("removed").alias(spans)).dropDuplicates([own])
    return docs.join(goes, F.col(id_col) == F.col(own), "left").withColumn(text_col, cut(F.col(text_col), F.col(spans))).select(*docs.columns)

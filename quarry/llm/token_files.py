"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending id order, cut into frames of about FRAME bytes, each compressed by itself. After them
come a skippable frame with the document index (ids and token counts, compressed) and the seek table of the public seekable format
(skippable frame 0x184D2A5E: compressed size, size and the low half of xxHash64 of each frame; then the number of frames, the flags,
and 0x8F92EAB1). A reader fetches the tail, then decompresses and verifies only the frames of the documents it was asked for.

The writer deals documents by id range, so files follow one another in id order. A task writes under a name of its own; the
manifest, written as a table once all tasks are through, names the files that count, so a lost executor leaves nothing but a file
that nobody reads. Files go to the shared folder through pyarrow's file systems.

Nulls: a null text is an empty document; null ids come first. Repeated ids are documents of their own, ordered by text. An empty
table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm import words as W
from quarry.session import staged, staging_path

FRAME, LEVEL = 1 << 18, 3
#: Fixed values of the seekable format: skippable frames of the index and the seek table, and the magic at the end.
INDEX_FRAME, SEEK_FRAME, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_MANIFEST = "part int, path string, docs long, tokens long, bytes long"


class Writer:
    """Frames to a binary stream; `close` writes index and seek table."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.packer = stream, width, zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.ids, self.counts, self.held, self.size, self.written = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids.astype(f"<u{self.width}").tobytes())
        self.size += len(self.held[-1])
        if self.size >= FRAME:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def _flush(self) -> None:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self._put(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        null = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        index = self.packer.compress(struct.pack("<QB", len(ids), self.width) + null.tobytes() + ids.tobytes() + np.array(self.counts, "<u4").tobytes())
        self._put(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        self.entries.append((len(index) + 8, 0, 0))
        table = np.array(self.entries, _ENTRY).tobytes()
        self._put(struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE))


class Reader:
    """Documents of a file by place; only the frames asked for are read and decompressed."""

    def __init__(self, file):
        self.file, size = file, file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        self.entries = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.sizes = np.concatenate([[0], np.cumsum(self.entries["size"], dtype=np.int64)])
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[-2]), int(self.entries["packed"][-1]))[8:])
        n, self.width = struct.unpack("<QB", index[:9])
        self.null = np.frombuffer(index, np.uint8, n, 9).astype(bool)
        self.ids = np.frombuffer(index, "<i8", n, 9 + n)
        self.counts = np.frombuffer(index, "<u4", n, 9 + 9 * n).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.entries["packed"][k])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return data

    def documents(self, places: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of the documents at ascending places."""
        held, data = -1, b""
        for place in places:
            begin, size = int(self.offsets[place]) * self.width, int(self.counts[place]) * self.width
            if size == 0:
                yield place, np.zeros(0, np.uint32)
                continue
            k = int(np.searchsorted(self.sizes, begin, "right")) - 1
            if k != held:
                held, data = k, self.frame(k)
            at = begin - int(self.sizes[k])
            yield place, np.frombuffer(data[at: at + size], f"<u{self.width}").astype(np.uint32)


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 0) -> DataFrame:
    """Encode, append `end_id` to each document and write the files: the manifest (part, path, docs, tokens, bytes)."""
    folder = folder or staging_path(spark, "tokens")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = texts.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, tokens = TaskContext.get().partitionId(), None, 0
        store, root = FileSystem.from_uri(folder)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        encoder = bpe.encoder(tokenizer)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for chunk in W.chunks(batch.column(1)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(path, compression=None)
                    out = Writer(stream, 2 if len(encoder.vocab.names) <= 1 << 16 else 4)
                ids, edges = encoder.encode(chunk)
                for i in range(chunk.last - chunk.first):
                    mine = np.append(ids[edges[i]: edges[i + 1]], end_id)
                    out.add(ids_of[chunk.first + i], mine)
                    tokens += len(mine)
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(out.ids)]), pa.array([tokens]), pa.array([out.written])],
                                             names=["part", "path", "docs", "tokens", "bytes"])

    return staged(spark, dealt.mapInArrow(run, _MANIFEST)).withColumn("store", F.lit(folder))


def read(spark: SparkSession, manifest: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (array<long>), ids_crc32.

    wanted: ids to return, a set that travels with the tasks; other documents' frames are not read.
    """
    files = sorted(manifest.collect(), key=lambda r: r.part)  # a row for each file
    starts = np.concatenate([[0], np.cumsum([r.tokens for r in files])]).tolist()
    rows = [(r.path, r.store, s) for r, s in zip(files, starts, strict=False)]
    only = None if wanted is None else np.unique(np.fromiter(wanted, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, store, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with FileSystem.from_uri(store)[0].open_input_file(path) as file:
                    reader = Reader(file)
                    places = np.arange(len(reader.ids)) if only is None else np.flatnonzero(np.isin(reader.ids, only) & ~reader.null)
                    for lot in np.array_split(places, max(1, int(reader.counts[places].sum()) >> 20)):
                        found = list(reader.documents(lot.tolist()))
                        ids = [x for _, x in found]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.ids[lot], pa.int64(), mask=reader.null[lot]), pa.array(base + reader.offsets[lot]), pa.array(reader.counts[lot]),
                            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)),
                                                     pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64))),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        ], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids array<long>, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    listing = spark.createDataFrame(rows, "path string, store string, start long").repartition(len(rows))
    return listing.mapInArrow(run, schema)

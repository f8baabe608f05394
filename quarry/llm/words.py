"""Words of Arrow text columns as numpy arrays: spans, hashes and shingles without a Python loop per word.

A batch is cut into chunks of whole texts of about CHUNK bytes; a longer text is a chunk of its own, so memory follows the
longest text. Null texts count as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 3 << 19
#: Separators of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (texts lower-cased in A-Z first).
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALPHANUMERIC = np.zeros(256, bool)
NOT_ALPHANUMERIC[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_U = np.uint64
_BASE, _BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_random = np.random.default_rng(20240229)
_EXACT = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, min(CHUNK + (CHUNK >> 2), 1 << n.bit_length()))  # small inputs, as on the driver, get small tables
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Final scrambling, one to one on 64 bits."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, second: bool = False) -> np.ndarray:
    """64-bit hash of each span of bytes; fold: A-Z as a-z; second: an independent one."""
    up, down = _tables(_BASE_2 if second else _BASE, len(buf) + 1)
    running = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _EXACT)[buf] * up[: len(buf)], out=running[1:])
    h = (running[ends] - running[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0x8EBC6AF09C88C6E3))


@dataclass
class Chunk:
    """Whole texts: rows first..last of the batch, their bytes, and the offset of each text (one more than texts)."""

    first: int
    last: int
    buf: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i]: self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield Chunk(at, to, data[bounds[at]: bounds[to]], bounds[at: to + 1] - bounds[at])
        at = to


def spans(chunk: Chunk, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of other bytes within a text; and for each text its first run (one more than texts)."""
    n = len(chunk.buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[chunk.buf]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = chunk.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inside[1:-1][edges]
    end[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, chunk.offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """Number of the text of each word, from the first word of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all runs of `width` words in a text; a text of fewer words, but some, is one shingle."""
    counts = np.diff(first)
    doc = owners(first)
    mixed = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        mixed = mix(mixed + hashes[k: k + len(mixed)]) if len(mixed) else mixed
    whole = np.flatnonzero(doc[: len(mixed)] == doc[width - 1:]) if len(mixed) else np.zeros(0, np.int64)
    docs, out = doc[whole], mixed[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width):
            has = counts[short] > k
            extra[has] = mix(extra[has] + hashes[first[short[has]] + k])
        docs, out = np.concatenate([docs, short]), np.concatenate([out, mix(extra + counts[short].astype(np.uint64))])
    return docs, out


def distinct(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value), sorted by text and value."""
    order = np.argsort(values)
    few = len(docs) == 0 or docs.max() < 1 << 16  # numpy sorts 16 bits by radix
    order = order[np.argsort(docs[order].astype(np.uint16) if few else docs[order], kind="stable")]
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... counts[i] of them, for every i in turn."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(counts) - counts
    return np.repeat(starts - ahead, counts) + np.arange(total)


def crc_remainder(column, modulus: int):
    """crc32 of an id as text, modulo `modulus`; a null id as the empty text."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"

"""Cross-tokenizer alignment by interval coalescing.

Each text, with a blank before it, is encoded by two public tokenizers, A (a byte-level BPE file) and B (a sentencepiece model that adds
the blank itself). Tokens are byte intervals. All tokens of a chunk of texts, of A and B together, are sorted by start (lexsort), and
the running maximum of their ends (maximum.accumulate) shows where groups break: where a start reaches the maximum of all ends
before it. Within the groups, every A token expands to the run of B tokens whose bytes overlap its own.

`encode` gives the ids of both, which are stored once; `groups` the aligned groups as rows of ids and byte offsets; `statistics` how well
each text's links agree with the whole corpus. How many texts hold a pair of ids linked is counted over all texts by a grouping with
partial sums. The LISTED most frequent pairs, a bound that doesn't grow, and the best count of each id of A, bounded by its vocabulary,
travel with the tasks; rarer pairs are joined by pair, so no link goes uncounted.

B merges only inside runs of blanks and what follows them when none of its pieces holds a blank behind another character. Such models
(it is checked) encode each distinct run of a chunk once, which also bounds what the library holds at a time; others encode whole texts.

Nulls: a null or empty text has no tokens: zeros, no groups, an empty digest. So has a text of which the joined bytes of A's or B's tokens are
not the text's (a text that holds U+2581, for instance). Names of special tokens inside texts are plain text. Rows are documents: repeated
rows and ids, null ids too, are kept, and each counts. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm import words as W
from quarry.session import staged, staging_path

LISTED = 1 << 20
#: Fixed value: the character that stands for a blank in sentencepiece vocabularies.
BLANK = "▁"


class Names:
    """Bytes of every id of a vocabulary, end to end, and the ids in decimal with a place for a separator behind each."""

    def __init__(self, tokens: list[bytes]):
        self.data, self.sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        digits = [f"{i} ".encode() for i in range(len(tokens))]
        self.digits, self.widths = np.frombuffer(b"".join(digits), np.uint8), np.array([len(d) for d in digits], np.int64)
        self.digits_at = np.cumsum(self.widths) - self.widths
        self.packed = "<u2" if len(tokens) <= 1 << 16 else "<u4"

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[W.ragged(self.starts[ids], self.sizes[ids])]


class Small(bpe.Encoder):
    """Remembers less: two tokenizers share a worker here."""

    SLOTS, POOL = 1 << 18, 1 << 21


class Bytewise:
    """A: a byte-level BPE file; its special tokens are plain text here."""

    def __init__(self, path: str):
        vocab = bpe.Vocabulary(path)
        vocab.special, vocab.library.encode_special_tokens = [], True
        self.encoder = Small(vocab)
        byte = {name: b for b, name in enumerate(bpe.byte_names())}
        self.names = Names([bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode() for name in vocab.names])

    def encode(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(chunk)


class Pieces:
    """B: a sentencepiece model that puts a blank before each text. Remembers what it has encoded, up to a bound."""

    KNOWN = 1 << 17

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.names = Names([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.alone = [self.model.piece_to_id(BLANK)]  # a blank with nothing behind it
        self.known: dict[bytes, bytes] = {}
        self.splits = not any(BLANK in p.lstrip(BLANK) for p in pieces)

    def encode(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Texts with the blank in front, which the model itself adds."""
        n = len(chunk.offsets) - 1
        if self.splits:
            blank = chunk.buf == 0x20
            head = np.zeros(len(chunk.buf), bool)
            head[1:] = blank[1:] & ~blank[:-1]
            head[chunk.offsets[:-1][np.diff(chunk.offsets) > 0]] = True
            starts = np.flatnonzero(head)
        else:
            starts = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        edges = np.append(starts, len(chunk.buf))
        runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(chunk.buf)]).dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        new = [r for r in distinct if r not in self.known]
        if len(self.known) > self.KNOWN:
            self.known, new = {}, distinct
        for r, ids in zip(new, self.model.encode([r[1:].decode() for r in new], num_threads=1), strict=True):
            self.known[r] = array("i", ids or self.alone).tobytes()
        each = [self.known[r] for r in distinct]
        sizes = np.array([len(x) for x in each]) // 4
        which = runs.indices.to_numpy()
        ids = np.frombuffer(b"".join(each), np.int32)[W.ragged((np.cumsum(sizes) - sizes)[which], sizes[which])]
        return ids, np.concatenate([[0], np.cumsum(sizes[which])])[np.searchsorted(starts, chunk.offsets)]


@cache
def tokenizers_of(path_a: str, path_b: str) -> tuple[Bytewise, Pieces]:
    return Bytewise(path_a), Pieces(path_b)


def with_blanks(chunk: W.Chunk) -> W.Chunk:
    """The texts with a blank before each that isn't empty."""
    sizes = np.diff(chunk.offsets)
    some = chunk.offsets[:-1][sizes > 0]
    return W.Chunk(chunk.first, chunk.last, np.insert(chunk.buf, some, 0x20), np.concatenate([[0], np.cumsum(sizes + (sizes > 0))]))


def _agree(names: Names, ids: np.ndarray, edges: np.ndarray, chunk: W.Chunk) -> np.ndarray:
    """Which texts are what their tokens spell."""
    size = np.concatenate([[0], np.cumsum(names.sizes[ids])])[edges]
    same = np.diff(size) == np.diff(chunk.offsets)
    spelled = names.joined(ids)
    if len(spelled) != len(chunk.buf) or not same.all():
        return np.array([ok and spelled[size[i]: size[i + 1]].tobytes() == chunk.text(i) for i, ok in enumerate(same)], bool)
    wrong = np.flatnonzero(spelled != chunk.buf)
    same[np.searchsorted(chunk.offsets, wrong, "right") - 1] = False
    return same


def _pack(names: Names, ids: np.ndarray, edges: np.ndarray, keep: np.ndarray) -> pa.Array:
    packed = ids.astype(names.packed)
    return pa.array([packed[x:y].tobytes() if ok else b"" for x, y, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), keep.tolist(), strict=True)], pa.binary())


def _unpack(column: pa.Array, names: Names) -> tuple[np.ndarray, np.ndarray]:
    """All ids in turn, and where those of each text begin (one more than texts)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    kind = np.dtype(names.packed)
    ids = np.frombuffer(data, np.uint8)[at[0]: at[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return ids.astype(np.int64), (at - at[0]) // kind.itemsize


def encode(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table: row (a number of its own), id, a and b (ids of both, little-endian; empty where the text has no tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers_of(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in W.chunks(batch.column(1), W.CHUNK // 2):
                told = with_blanks(chunk)
                (a, of_a), (b, of_b) = one.encode(told), two.encode(told)
                keep = _agree(one.names, a, of_a, told) & _agree(two.names, b, of_b, told)
                n = chunk.last - chunk.first
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column(0).slice(chunk.first, n), _pack(one.names, a, of_a, keep), _pack(two.names, b, of_b, keep)],
                                                 names=["row", "id", "a", "b"])
                row += n

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"row long, id {kind}, a binary, b binary")
    folder = staging_path(spark, "alignment")
    out.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)


class Aligned:
    """Groups and links of a batch of encoded texts. Texts stand end to end, so their tokens never overlap."""

    def __init__(self, a: pa.Array, b: pa.Array, of_a: Names, of_b: Names):
        self.names = of_a, of_b
        self.ids, self.edges = zip(_unpack(a, of_a), _unpack(b, of_b), strict=True)
        self.n = len(a)
        self.ends = [np.cumsum(names.sizes[ids]) for names, ids in zip(self.names, self.ids, strict=True)]
        self.starts = [ends - names.sizes[ids] for names, ids, ends in zip(self.names, self.ids, self.ends, strict=True)]
        start, end = np.concatenate(self.starts), np.concatenate(self.ends)
        side = np.repeat([0, 1], [len(x) for x in self.ids])
        order = np.lexsort((side, start))
        start, end = start[order], end[order]
        reached = np.maximum.accumulate(end) if len(end) else end
        opens = np.ones(len(start), bool)
        opens[1:] = start[1:] >= reached[:-1]
        group = np.cumsum(opens) - 1
        self.cuts = start[opens]  # first byte of each group
        in_order = np.empty(len(order), np.int64)
        in_order[order] = group
        self.group = in_order[: len(self.ids[0])], in_order[len(self.ids[0]):]

    def n_groups(self) -> np.ndarray:
        at = np.concatenate([[0], self.ends[0]])[self.edges[0]]
        return np.diff(np.searchsorted(self.cuts, at))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the A token, place of the B token) of all overlaps: in its group, an A token meets a run of B tokens."""
        low = np.searchsorted(self.ends[1], self.starts[0], "right")
        many = np.searchsorted(self.starts[1], self.ends[0], "left") - low
        left = np.repeat(np.arange(len(many)), many)
        return np.searchsorted(self.edges[0], left, "right") - 1, left, W.ragged(low, many)

    def pairs(self, texts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of the distinct id pairs that a text holds linked, in order of text."""
        pair = self.ids[0][left] * len(self.names[1].sizes) + self.ids[1][right]
        order = np.argsort(pair, kind="stable")
        order = order[np.argsort(texts[order], kind="stable")]
        texts, pair = texts[order], pair[order]
        new = np.ones(len(pair), bool)
        new[1:] = (texts[1:] != texts[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        return texts[at], pair[at], np.diff(np.append(at, len(pair)))

    def digests(self) -> list[str]:
        """Of each text `a1,a2|b1;a3|b2,b3` as SHA-256 in hex; of one without tokens the empty string."""
        text = np.concatenate([np.repeat(np.arange(self.n), np.diff(e)) for e in self.edges])
        side = np.repeat([0, 1], [len(x) for x in self.ids])
        group = np.concatenate(self.group)
        order = np.lexsort((side, group))
        text, side, group = text[order], side[order], group[order]
        flat = np.concatenate([self.names[0].digits, self.names[1].digits])
        begin = np.concatenate([self.names[0].digits_at[self.ids[0]], len(self.names[0].digits) + self.names[1].digits_at[self.ids[1]]])[order]
        width = np.concatenate([names.widths[ids] for names, ids in zip(self.names, self.ids, strict=True)])[order]
        out, ends = flat[W.ragged(begin, width)], np.cumsum(width)
        if len(ends):
            out[ends[:-1] - 1] = np.where(group[1:] != group[:-1], ord(";"), np.where(side[1:] != side[:-1], ord("|"), ord(",")))
        edges = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(self.n + 1))]
        return [hashlib.sha256(out[x: y - 1].tobytes()).hexdigest() if y > x else "" for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def groups(encoded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """id and groups: byte range in the text with its blank, and the ids of A and B that tile it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers_of(path_a, path_b)
        for batch in (part for whole in batches for part in _parts(whole)):
            x = Aligned(batch.column(1), batch.column(2), one.names, two.names)
            total = int(x.ends[0][-1]) if len(x.ends[0]) else 0
            at = np.concatenate([[0], x.ends[0]])[x.edges[0]]
            first = np.searchsorted(x.cuts, at)
            shift = np.repeat(at[:-1], np.diff(first))
            sides = [pa.ListArray.from_arrays(pa.array(np.searchsorted(x.group[k], np.arange(len(x.cuts) + 1)).astype(np.int32)), pa.array(x.ids[k].astype(np.int32))) for k in (0, 1)]
            rows = pa.StructArray.from_arrays([pa.array((x.cuts - shift).astype(np.int64)), pa.array((np.append(x.cuts[1:], total)[: len(x.cuts)] - shift).astype(np.int64)), *sides], names=["start", "end", "a", "b"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), rows)], names=["id", "groups"])

    return encoded.select("id", "a", "b").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def _parts(batch: pa.RecordBatch, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of whole texts of about so many bytes of ids; columns row, a, b or more."""
    edges, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def pair_counts(encoded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): in how many texts the pair stands linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers_of(path_a, path_b)
        for batch in batches:
            for part in _parts(batch):
                x = Aligned(part.column(1), part.column(2), one.names, two.names)
                found, n = np.unique(x.pairs(*x.links())[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

    return encoded.select("row", "a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _bucket(n):
    """A number that grows with n, with at most some thousand values."""
    return F.when(n < 1024, n).otherwise(F.floor(F.log2(n.cast("double")) * 64) + 384).cast("long")


def statistics(spark: SparkSession, encoded: DataFrame, path_a: str, path_b: str, listed: int = LISTED) -> DataFrame:
    """Per text: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A id's most frequent one), count_sum (of the pairs' counts
    over all links), groups_sha256. encoded: as of `encode`."""
    kinds = len(tokenizers_of(path_a, path_b)[1].names.sizes)
    counts = staged(spark, pair_counts(encoded, path_a, path_b))
    steps = counts.groupBy(_bucket(F.col("n")).alias("step")).agg(F.count("*").alias("many")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for step, many in steps:
        if held + many > listed:
            break
        least, held = step, held + many
    whole = held == sum(many for _, many in steps)
    frequent = _bucket(F.col("n")) >= (least if least is not None else F.lit(None).cast("long"))
    top = counts.where(frequent).toArrow()  # `listed` rows at most
    pair = top["pair"].to_numpy()
    order = np.argsort(pair)
    best = counts.groupBy(F.floor(F.col("pair") / kinds).alias("a")).agg(F.max("n").alias("best"))
    per_a = best.toArrow()  # a row for each id of A at most
    highest = np.zeros(int(per_a["a"].to_numpy().max()) + 1 if per_a.num_rows else 1, np.int64)
    if per_a.num_rows:
        highest[per_a["a"].to_numpy()] = per_a["best"].to_numpy()
    sent = spark.sparkContext.broadcast((pair[order], top["n"].to_numpy()[order], highest))

    def looked_up(pairs: np.ndarray) -> np.ndarray:
        held, n, _ = sent.value
        if not len(held):
            return np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(held, pairs), len(held) - 1)
        return np.where(held[at] == pairs, n[at], 0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers_of(path_a, path_b)
        for batch in batches:
            for part in _parts(batch):
                x = Aligned(part.column(1), part.column(2), one.names, two.names)
                texts, left, right = x.links()
                pairs = x.ids[0][left] * kinds + x.ids[1][right]
                n = looked_up(pairs)
                is_best = (n > 0) & (n == sent.value[2][x.ids[0][left]])
                edges = np.searchsorted(texts, np.arange(x.n + 1))
                sums = [np.concatenate([[0], np.cumsum(v)]) for v in (is_best, n)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(3), pa.array(np.diff(x.edges[0])), pa.array(np.diff(x.edges[1])), pa.array(x.n_groups()), pa.array(np.diff(edges)),
                    *(pa.array(np.diff(s[edges]).astype(np.int64)) for s in sums), pa.array(x.digests(), pa.string())],
                    names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers_of(path_a, path_b)
        for batch in batches:
            for part in _parts(batch):
                x = Aligned(part.column(1), part.column(2), one.names, two.names)
                texts, pairs, times = x.pairs(*x.links())
                some = looked_up(pairs) == 0
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[texts[some]]), pa.array(pairs[some]), pa.array(times[some])], names=["row", "pair", "times"])

    kind = encoded.schema["id"].dataType.simpleString()
    out = encoded.select("row", "a", "b", "id").mapInArrow(
        told, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    if not whole:
        tail = encoded.select("row", "a", "b").mapInArrow(rare, "row long, pair long, times long")
        met = tail.join(counts.where(~frequent if least is not None else F.lit(True)), "pair").withColumn("a", F.floor(F.col("pair") / kinds))
        more = met.join(best, "a").groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows: list[tuple], path_a: str, path_b: str) -> list[tuple]:
    """Plain version for tests, by the libraries: what `statistics` returns, row by row."""
    from collections import Counter

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    one.encode_special_tokens = True
    byte, names = {name: b for b, name in enumerate(bpe.byte_names())}, {i: t for t, i in one.get_vocab().items()}
    found = []
    for _, text in rows:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace(BLANK, " ").encode() for i in b]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        parts = [[[str(t) for t, (_, e) in zip(ids, own, strict=True) if low < e <= high] for ids, own in ((a, spans[0]), (b, spans[1]))] for low, high in zip([0, *cuts], cuts, strict=False)]
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (t, f) in zip(b, spans[1], strict=True) if s < f and t < e]
        digest = hashlib.sha256(";".join(",".join(p) + "|" + ",".join(q) for p, q in parts).encode()).hexdigest() if a else ""
        found.append((len(a), len(b), len(cuts), links, digest))
    counts = Counter(pair for *_, links, _ in found for pair in set(links))
    best: dict[int, int] = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, a, b, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest)
            for (i, _), (a, b, g, links, digest) in zip(rows, found, strict=True)]

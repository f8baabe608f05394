"""Byte-pair encoding of whole text columns with a public tokenizer's file, equal to the tokenizers library's ids.

Texts are cut into pieces and pieces into ids with arrays rather than per piece. Frequent words sit in a minimal acyclic transducer: a
shared-suffix automaton whose transitions carry numbers that add up to the word's place, and a table from places to ids. It is compiled
once, sent as a file (`SparkContext.addFile`) and memory-mapped by the workers of an executor. Words that it doesn't hold are
merged exactly, all new words of a chunk at once, and remembered in a bounded table.

The fast path covers texts of Latin letters and common punctuation, for which normalising and cutting are plain rules. A text
with other characters, or with the name of a special token, is encoded by the library itself, as are pieces over LONG bytes.

Nulls count as empty texts, which have no ids. Counts of frequent words affect speed only.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.line_dedup import characters

LONG, LEXICON, OFTEN = 200, 1 << 16, 4
_U = np.uint64
_NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: White space in Unicode, of the characters below that are known here.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0]


def _classes(letters_below: int) -> np.ndarray:
    """Class of each code point: of those below a limit, and of dashes, quotes, dots and currency signs."""
    out = np.full(0x110000 + 1, UNKNOWN, np.uint8)
    for point in [*range(letters_below), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]:
        kind = unicodedata.category(chr(point))[0]
        out[point] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[WHITE] = SPACE
    return out


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on in turn."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Pairs:
    """Merges: rank of a pair of ids, and the id it becomes. Exact look-up in tables of one slot, further tables for what collides."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        left = np.array([m[0] for m in merges], np.uint64)
        keys = (left << _U(32)) | np.array([m[1] for m in merges], np.uint64)
        self.becomes = np.array([m[2] for m in merges] + [0], np.int32)
        self.tables, ranks, bits = [], np.arange(len(merges), dtype=np.int32), 20
        while len(keys):
            slot = self._slot(keys, bits)
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << bits, _U(0xFFFFFFFFFFFFFFFF)), np.full(1 << bits, _NONE, np.int32)
            held[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.tables.append((bits, held, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], 14 if len(self.tables) == 1 else bits + 1

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << _U(32)) | right.astype(np.uint64)
        out = np.full(len(keys), _NONE, np.int32)
        todo = None
        for bits, held, rank in self.tables:
            now = keys if todo is None else keys[todo]
            slot = self._slot(now, bits)
            there = held[slot]
            match = there == now
            if todo is None:
                out[match] = rank[slot[match]]
                todo = np.flatnonzero(~match & (there != _U(0xFFFFFFFFFFFFFFFF)))
            else:
                out[todo[match]] = rank[slot[match]]
                todo = todo[~match]
            if not len(todo):
                break
        return out


class Vocabulary:
    """What a tokenizer file fixes: ids of bytes, merges, special names, and which of the two cutting rules it follows."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(suffix)  # the file with word ends also folds case and drops white space
        ids, names = model["vocab"], byte_names()
        self.byte = np.array([ids[n] for n in names], np.int32)
        self.last = np.array([ids[n + suffix] for n in names], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = Pairs([(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.names = [""] * (max(max(ids.values()), *(t["id"] for t in spec["added_tokens"])) + 1)
        for name, i in [*ids.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.names[i] = name
        self.classes = _classes(0x100 if self.lower else 0x250)

    def merged(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has: in every round each piece merges its pair of lowest rank."""
        size = ends - starts
        symbol = self.byte[buf[W.ragged(starts, size)]]
        word = np.repeat(np.arange(len(starts)), size)
        symbol[np.cumsum(size) - 1] = self.last[buf[ends - 1]]
        counts, done_words, done_symbols = np.zeros(len(starts), np.int64), [], []

        def ranks(at: np.ndarray) -> np.ndarray:
            out = np.full(len(at), _NONE, np.int32)
            inner = np.flatnonzero(at < len(symbol) - 1)
            inner = inner[word[at[inner]] == word[at[inner] + 1]]
            out[inner] = self.pairs.rank(symbol[at[inner]], symbol[at[inner] + 1])
            return out

        rank = ranks(np.arange(len(symbol)))
        while len(symbol):
            head = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.concatenate([head, [len(word)]])))
            finished = least == _NONE
            if finished.any():
                done_words.append(word[finished])
                done_symbols.append(symbol[finished])
                keep = ~finished
                symbol, word, rank, least = symbol[keep], word[keep], rank[keep], least[keep]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == least)
            if len(hit) > 1:  # of pairs that overlap (a a a) every other one, from the left
                run = np.concatenate([[True], np.diff(hit) != 1])
                place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                hit = hit[place % 2 == 0]
            symbol[hit] = self.pairs.becomes[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            now = moved[hit]
            touched = np.zeros(len(symbol), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            changed = np.flatnonzero(touched)
            rank[changed] = ranks(changed)
        if not done_words:
            return np.zeros(0, np.int32), counts
        owner, ids = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(starts))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(vocab: Vocabulary, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (folded if the file says so), start and end of every piece, first piece of each text, and which texts need the library."""
    buf, n = chunk.buf, len(chunk.offsets) - 1
    points, before = characters(buf)
    kind = vocab.classes[points]
    start_of = before[chunk.offsets]
    odd = np.zeros(n, bool)
    odd[np.searchsorted(start_of, np.flatnonzero(kind == UNKNOWN), "right") - 1] = True
    if len(vocab.special):
        bars = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))
        for i in np.unique(np.searchsorted(chunk.offsets, bars, "right") - 1):
            odd[i] |= any(s in chunk.text(i) for s in vocab.special)
    if vocab.lower:
        buf = buf.copy()
        upper = (buf >= 0x41) & (buf <= 0x5A)
        latin = np.zeros(len(buf), bool)
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf[upper | latin] += 0x20
        points[((points >= 0x41) & (points <= 0x5A)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))] += 0x20
    m = len(points)
    none = np.zeros(0, np.int64)
    if not m:
        return buf, none, none, np.zeros(n + 1, np.int64), odd
    edge = np.zeros(m + 1, bool)
    edge[start_of] = True
    begin = np.ones(m, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= edge[:m]
    heads = np.flatnonzero(begin)
    tails = np.append(heads[1:], m)
    blank = kind[heads] == SPACE
    quote = (points[heads] == 0x27) & (tails - heads == 1) & ~edge[tails]
    if not vocab.lower:
        quote &= edge[heads] | (points[heads - 1] != 0x20)
        inner = np.flatnonzero(blank & ~edge[tails])
        begin[tails[inner] - 1] = True  # the last blank before a word stands alone, or joins it
        joins = inner[points[tails[inner] - 1] == 0x20]
        begin[tails[joins]] = False
    else:
        begin |= kind == NUMBER
    at = tails[quote]
    ahead = points[np.minimum(at + 1, m - 1)] * (~edge[np.minimum(at + 1, m)])
    c = points[at]
    taken = np.where(np.isin(c, [0x73, 0x74, 0x6D, 0x64]), 1, 0)
    for a, b in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
        taken[(c == a) & (ahead == b)] = 2
    at, taken = at[taken > 0], taken[taken > 0]
    begin[at] = False
    after = (at + taken)[(at + taken) < m]
    begin[after] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], m)
    if vocab.lower:
        word = kind[starts] != SPACE
        starts, ends = starts[word], ends[word]
    byte_of = np.append(np.flatnonzero((chunk.buf & 0xC0) != 0x80), len(buf))
    first = np.searchsorted(starts, start_of)
    return buf, byte_of[starts], byte_of[ends], first, odd


class Lexicon:
    """Minimal acyclic transducer over words in byte order, in one file; reading maps it."""

    @staticmethod
    def compile(words: list[bytes], vocab: Vocabulary, path: str) -> None:
        words = sorted(set(words))
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, state), ...))
        open_: list[list] = [[False, []]]  # states along the last word: final, transitions

        def close(down_to: int) -> None:
            while len(open_) > down_to + 1:
                final, moves = open_.pop()
                shape = (final, tuple(moves))
                if shape not in register:
                    register[shape] = len(states)
                    states.append(shape)
                byte, _ = open_[-1][1][-1]
                open_[-1][1][-1] = (byte, register[shape])

        last = b""
        for word in words:
            same = len(os.path.commonprefix([last, word]))
            close(same)
            for byte in word[same:]:
                open_[-1][1].append((byte, -1))
                open_.append([False, []])
            open_[-1][0] = True
            last = word
        close(0)
        states.append((open_[0][0], tuple(open_[0][1])))
        used = sorted({b for _, moves in states for b, _ in moves})
        letter = np.zeros(256, np.int32)
        letter[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        go, adds = np.full((len(states), width), -1, np.int32), np.zeros((len(states), width), np.int32)
        final, below = np.zeros(len(states), np.int32), []
        for i, (ends, moves) in enumerate(states):
            final[i], total = ends, int(ends)
            for byte, target in moves:
                go[i, letter[byte]], adds[i, letter[byte]] = target, total
                total += below[target]
            below.append(total)
        data = np.frombuffer(b"".join(words), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        ids, counts = vocab.merged(data, edges[:-1], edges[1:]) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        parts = [letter, go.reshape(-1), adds.reshape(-1), final, np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), ids]
        with open(path, "wb") as file:
            file.write(np.array([len(p) for p in parts], np.int64).tobytes())
            for p in parts:
                file.write(p.astype(np.int32).tobytes())

    def __init__(self, path: str):
        whole = np.memmap(path, np.int32, "r")
        sizes = np.frombuffer(whole[:12].tobytes(), np.int64)
        self.letter, self.go, self.adds, self.final, self.places, self.ids = np.split(whole[12:], np.cumsum(sizes)[:-1])
        self.width, self.root = len(self.go) // max(1, len(self.final)), len(self.final) - 1

    def look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word, or -1: all words take a step at a time."""
        state, place = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        live, step = np.arange(len(starts)), 0
        out = np.full(len(starts), -1, np.int64)
        while len(live):
            over = ends[live] - starts[live] == step
            if over.any():
                stop = live[over]
                out[stop] = np.where(self.final[state[over]] > 0, place[over], -1)
                live, state, place = live[~over], state[~over], place[~over]
            at = state * self.width + self.letter[buf[starts[live] + step]]
            target = self.go[at]
            place = place + self.adds[at]
            alive = target >= 0
            live, state, place, step = live[alive], target[alive].astype(np.int64), place[alive], step + 1
        return out


class Encoder:
    """Ids of chunks of texts. Keeps what it has merged in a table of one slot a word, under two digests and the length."""

    SLOTS, POOL = 1 << 20, 1 << 24

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None):
        self.vocab, self.lexicon = vocab, lexicon
        self._clear()

    def _clear(self) -> None:
        self.first, self.second = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.at, self.count = np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0

    def _remember(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[self.used: self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _plain(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces and how many each has."""
        long = ends - starts > LONG
        if not long.any():
            return self.vocab.merged(buf, starts, ends)
        ids, counts = self.vocab.merged(buf, starts[~long], ends[~long])
        every: list[np.ndarray] = [None] * len(starts)
        for i, x in zip(np.flatnonzero(~long), np.split(ids, np.cumsum(counts)[:-1]), strict=False):
            every[i] = x
        for i in np.flatnonzero(long):
            text = buf[starts[i]: ends[i]].tobytes().decode()
            every[i] = np.array(self.vocab.library.encode(text, add_special_tokens=False).ids, np.int32)
        return np.concatenate(every), np.array([len(x) for x in every])

    def encode(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and for each text where its ids begin (one more than texts)."""
        if self.used > self.POOL:
            self._clear()
        buf, starts, ends, first, odd = pieces(self.vocab, chunk)
        if odd.any():
            keep = ~odd[W.owners(first)]
            counts = np.where(odd, 0, np.diff(first))
            starts, ends, first = starts[keep], ends[keep], np.concatenate([[0], np.cumsum(counts)])
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        todo = np.arange(len(starts))
        pools = [np.zeros(0, np.int32)]
        if self.lexicon is not None:
            place = self.lexicon.look_up(buf, starts, ends)
            known = place >= 0
            at[known] = self.lexicon.places[place[known]]
            count[known] = self.lexicon.places[place[known] + 1] - at[known]
            pools, todo = [np.asarray(self.lexicon.ids)], np.flatnonzero(~known)
        base = len(pools[0])
        if len(todo):
            one = W.span_hashes(buf, starts[todo], ends[todo], fold=False)
            two = W.span_hashes(buf, starts[todo], ends[todo], fold=False, second=True)
            slot = (one & _U(self.SLOTS - 1)).astype(np.int64)
            hit = (self.first[slot] == one) & (self.second[slot] == two) & (self.count[slot] > 0)
            at[todo[hit]], count[todo[hit]] = base + self.at[slot[hit]], self.count[slot[hit]]
            new = np.flatnonzero(~hit)
            if len(new):
                _, pick, back = np.unique(one[new], return_index=True, return_inverse=True)
                own = new[pick]
                ids, counts = self._plain(buf, starts[todo[own]], ends[todo[own]])
                places = self._remember(ids) + np.cumsum(counts) - counts
                at[todo[new]], count[todo[new]] = base + places[back], counts[back]
                s = slot[own]
                self.first[s], self.second[s], self.at[s], self.count[s] = one[own], two[own], places, counts
        table = np.concatenate([*pools, self.pool[: self.used]]) if base else self.pool
        ids = table[W.ragged(at, count)]
        edges = np.concatenate([[0], np.cumsum(count)])[first]
        if not odd.any():
            return ids, edges
        parts = [ids[edges[i]: edges[i + 1]] for i in range(len(odd))]
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.vocab.library.encode(chunk.text(i).decode(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, lexicon: str | None = None) -> Encoder:
    """One for each worker process and tokenizer file."""
    if (path, lexicon) not in _encoders:
        _encoders.clear()
        _encoders[path, lexicon] = Encoder(vocabulary(path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[path, lexicon]


def _frequent(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        for chunk in W.chunks(batch.column(0)):
            buf, starts, ends, _, _ = pieces(vocab, chunk)
            fits = ends - starts <= LONG
            starts, ends = starts[fits], ends[fits]
            _, pick, counts = np.unique(W.span_hashes(buf, starts, ends, fold=False), return_index=True, return_counts=True)
            often = counts >= OFTEN
            found = [buf[starts[i]: ends[i]].tobytes() for i in pick[often]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(counts[often].astype(np.int64))], names=["word", "n"])


def lexicon(spark: SparkSession, texts: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compile the corpus's most frequent words and send the file to all executors: its name there."""
    found = texts.mapInArrow(lambda it: _frequent(it, path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [bytes(r.word) for r in found.orderBy(F.desc("n"), "word").limit(size).select("word").collect()]
    name = f"lexicon-{hashlib.sha256(path.encode() + b'|'.join(words)).hexdigest()[:24]}.bin"
    if not os.path.exists(SparkFiles.get(name)):
        folder = tempfile.mkdtemp(prefix="lexicon-")  # the driver serves the file to executors that join later, so it stays as long as the driver
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        Lexicon.compile(words, vocabulary(path), f"{folder}/{name}")
        spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", use_lexicon: bool = True) -> DataFrame:
    """Per document: id and ids (array<int>)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = lexicon(spark, texts.select("text"), path) if use_lexicon else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                ids, edges = encoder(path, name).encode(chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.last - chunk.first),
                                                  pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    return texts.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(vocab: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids: byte-level vocabularies give their bytes as UTF-8, vocabularies with word ends their names with blanks between."""
    if vocab.lower:
        return " ".join(map(vocab.names.__getitem__, ids.tolist()))
    return vocab.library.decode(ids.tolist(), skip_special_tokens=False)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the ids."""

    @F.pandas_udf("string")
    def text(column):
        return column.map(lambda ids: decoded(vocabulary(path), ids))

    return encoded.withColumn(out, text(ids_col))


def round_trip(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = lexicon(spark, texts.select("text"), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, hashes = vocabulary(path), hashlib.sha256
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                ids, edges = encoder(path, name).encode(chunk)
                each = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.last - chunk.first), pa.array(np.diff(edges)), pa.array([hashes(x.astype("<u4").tobytes()).hexdigest() for x in each]),
                    pa.array([hashes(decoded(vocab, x).encode()).hexdigest() for x in each])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

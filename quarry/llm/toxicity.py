"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

Two words are as alike as the subsequences of three and four characters that they share, each weighted by DECAY to the power of the
shortest stretch it takes up in either word, so letters may be skipped and characters inserted ("i.d.i.o.t"). Words count with their
begin and end; single letters with blanks between ("i d i o t") are taken as one word.

A document is as toxic as its worst word. Labels belong to whole texts, so training is multiple-instance: in each toxic text the
word that speaks most for toxicity is the witness (first by counts, then by the model of the round before), words of clean texts are
negatives, among them those that the model of the round before took for the worst. Kernel values against LANDMARKS words, whitened
(Nyström), feed a linear SVM with squared hinge loss, fitted by Newton steps. As the kernel is a product of weights of
subsequences, the model folds into one weight for each subsequence of a landmark, which is what the tasks look up. Doc scores
become probabilities by a logistic curve.

Bound: the model is fitted on at most SAMPLE toxic and SAMPLE clean labelled rows, those with the smallest xxhash64 of their id. Every
document is scored, over its whole text. Nulls and empty texts score as the least toxic word would; rows with null labels aren't
learned from. Without toxic or without clean rows all scores are 0. Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.line_dedup import characters

SAMPLE, LANDMARKS, NEGATIVES, ROUNDS, DECAY, COST = 4000, 512, 12000, 4, 0.8, 300.0
#: Places of the further characters of a subsequence, after its first.
STEPS = sorted([*combinations(range(1, 6), 2), *combinations(range(1, 6), 3), (2, 4, 6)], key=lambda s: s[-1])
BLOCK = 200  # words that the driver compares with the landmarks at once
SLICE = 2000  # words of which the driver holds the subsequences, or copies of the kernel rows, at once
LONGEST = 400  # characters of a word that are compared at once; longer ones are cut into overlapping stretches
_U = np.uint64
_MANY = np.random.default_rng(5).integers(1, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)
_BEGIN, _END = 2, 3
BIAS = -1.0


def _fold(points: np.ndarray) -> np.ndarray:
    upper = ((points >= 0x41) & (points <= 0x5A)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    return np.where(upper, points + 0x20, points)


def units(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds in bytes and text of every word; a run of three or more single characters between blanks is one word more."""
    starts, ends, first = W.spans(chunk, W.BLANKS)
    doc = W.owners(first)
    single = ends - starts == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    begin, stop = edge[::2], edge[1::2]
    keep = (stop - begin >= 3) & (doc[begin] == doc[np.maximum(stop - 1, 0)]) if len(begin) else np.zeros(0, bool)
    begin, stop = begin[keep], stop[keep]
    return np.concatenate([starts, starts[begin]]), np.concatenate([ends, ends[stop - 1]]), np.concatenate([doc, doc[begin]])


def subsequences(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each pattern of places in turn, shortest stretches first: the word of every place, the hash of the subsequence from there,
    whether it lies within the word, and its weight."""
    points, before = characters(buf)
    points = _fold(points).astype(np.uint64)
    a, size = before[starts], before[ends] - before[starts]
    whole = np.zeros(int((size + 2).sum()), np.uint64)
    edges = np.concatenate([[0], np.cumsum(size + 2)])
    whole[edges[:-1]], whole[edges[1:] - 1] = _BEGIN, _END
    whole[W.ragged(edges[:-1] + 1, size)] = points[W.ragged(a, size)]
    word = np.repeat(np.arange(len(starts)), size + 2)
    room = np.repeat(edges[1:], size + 2) - np.arange(len(whole))
    n, parts = len(whole), [whole * m for m in _MANY[:4]]
    for steps in STEPS:
        last = steps[-1]
        if last >= n:  # fewer letters than the stretch takes
            continue
        h = parts[0][: n - last] + _U(len(steps)) * _MANY[7]
        for k, s in enumerate(steps):
            h += parts[k + 1][s: n - last + s]
        yield word, h, room[: n - last] > last, DECAY ** (last + 1)


@dataclass
class Model:
    """Weight of each subsequence of the landmarks, and the curve from the worst word's value to a probability."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    name: str = ""

    def __post_init__(self):
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> _U(42)] = True

    def values(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        met, n_keys = [], len(self.keys)
        for word, h, inside, weight in subsequences(buf, starts, ends):
            maybe = np.flatnonzero(self.seen[h >> _U(42)] & inside)
            place = np.minimum(np.searchsorted(self.keys, h[maybe]), n_keys - 1)
            match = self.keys[place] == h[maybe]
            met.append((word[maybe[match]] * n_keys + place[match], np.full(int(match.sum()), weight)))
        # a subsequence that a word holds several times counts once, by its shortest stretch
        cell, first = np.unique(np.concatenate([c for c, _ in met]), return_index=True)
        weight = np.concatenate([w for _, w in met])[first]
        return np.bincount(cell // n_keys, self.weights[cell % n_keys] * weight, len(starts)) / _scale(ends - starts) + self.bias

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -500, 500)))


def _scale(size: np.ndarray) -> np.ndarray:
    """Longer words have more subsequences; the square root keeps a stem's share in a long word."""
    return np.sqrt(np.maximum(size, 3).astype(np.float64))


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(words), np.uint8), ends - size, ends


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of subsequence weights: word, hash, value."""
    buf, starts, ends = _joined(words)
    rows = [(w[np.flatnonzero(ok)], h[ok], np.full(int(ok.sum()), x)) for w, h, ok, x in subsequences(buf, starts, ends)]
    word, h, value = (np.concatenate(c) for c in zip(*rows, strict=True))
    return word, h, value / _scale(ends - starts)[word]


@dataclass
class Table:
    """Landmarks by their subsequences: the keys, and for each key the landmarks that have it and their values."""

    keys: np.ndarray
    edges: np.ndarray
    marks: np.ndarray
    values: np.ndarray
    n: int

    @staticmethod
    def of(words: list[bytes]) -> Table:
        word, h, value = _features(words)
        keys = np.unique(h)
        cell, first = np.unique(np.searchsorted(keys, h) * len(words) + word, return_index=True)
        counts = np.bincount(cell // len(words), minlength=len(keys))
        return Table(keys, np.concatenate([[0], np.cumsum(counts)]), cell % len(words), value[first], len(words))

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """Kernel values of words against the landmarks."""
        word, h, value = _features(words)
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        match = np.flatnonzero(self.keys[place] == h)
        # a subsequence that a word holds several times counts once, by its shortest stretch, which comes first
        cell, first = np.unique(word[match] * len(self.keys) + place[match], return_index=True)
        word, place, value = cell // len(self.keys), cell % len(self.keys), value[match[first]]
        counts = self.edges[place + 1] - self.edges[place]
        held = W.ragged(self.edges[place], counts)
        at = np.repeat(word * self.n, counts) + self.marks[held]
        return np.bincount(at, np.repeat(value, counts) * self.values[held], len(words) * self.n).reshape(len(words), self.n)

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """The weight of each key, from those of the landmarks."""
        key = np.repeat(np.arange(len(self.keys)), np.diff(self.edges))
        return np.bincount(key, self.values * weights[self.marks], len(self.keys))


def _kernel(words: list[bytes], table: Table, whiten: np.ndarray) -> np.ndarray:
    """Whitened kernel values of words against the landmarks."""
    out = np.zeros((len(words), whiten.shape[1]), np.float32)
    for at in range(0, len(words), BLOCK):
        out[at: at + BLOCK] = table.kernel(words[at: at + BLOCK]) @ whiten
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared hinge loss and half the squared norm, by Newton steps with halving. The offset is fixed: what shares nothing with any
    landmark stands at BIAS, on the clean side."""
    beta = np.zeros(x.shape[1])

    def slacks(b):
        return 1 - y * (np.concatenate([x[at: at + SLICE] @ b for at in range(0, len(x), SLICE)]) + BIAS)

    def loss(b):
        return 0.5 * b @ b + (weight * np.maximum(0, slacks(b)) ** 2).sum()

    for _ in range(40):
        slack = slacks(beta)
        gradient, curvature = beta.copy(), np.eye(len(beta))
        for at in range(0, len(x), SLICE):  # in slices, for the driver's memory
            on = at + np.flatnonzero(slack[at: at + SLICE] > 0)
            part = x[on].astype(np.float64)
            gradient -= 2 * ((weight * y * slack)[on] @ part)
            curvature += 2 * (part * weight[on, None]).T @ part
        step = np.linalg.solve(curvature, gradient)
        size, now = 1.0, loss(beta)
        while loss(beta - size * step) > now and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _dotted(word: bytes) -> bytes | None:
    return b".".join(bytes([b]) for b in word) if word.isascii() and 3 < len(word) < 30 else None


def _fit_words(positive: list[bytes], negative: list[bytes]) -> Model:
    gaps = [g for g in map(_dotted, positive) if g]
    spaced = [w[: len(w) // 2] + b"*" + w[len(w) // 2:] for w in positive if w.isascii() and 3 < len(w) < 30]
    good = list(dict.fromkeys([*positive, *gaps, *spaced]))
    marks = list(dict.fromkeys([*positive[: LANDMARKS // 2], *negative[: LANDMARKS // 2]]))
    table = Table.of(marks)
    among = table.kernel(marks)
    scale = np.sqrt(np.trace(among) / len(marks))
    values, vectors = np.linalg.eigh(among / scale**2)
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept]) / scale**2
    x = _kernel([*good, *negative], table, whiten)
    y = np.concatenate([np.ones(len(good)), -np.ones(len(negative))])
    beta = _svm(x, y, np.where(y > 0, COST * max(1.0, 0.1 * len(negative) / len(good)), COST))
    return Model(table.keys, table.folded(whiten @ beta), BIAS)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns in front of the text, and the distinct words of each text, lower-cased."""
    for batch in batches:
        for chunk in W.chunks(batch.column(batch.num_columns - 1)):
            starts, ends, doc = units(chunk)
            fits = ends - starts <= LONGEST
            starts, ends, doc = starts[fits], ends[fits], doc[fits]
            n = chunk.last - chunk.first
            doc, value = W.distinct(doc, W.span_hashes(chunk.buf, starts, ends))
            hashes = W.span_hashes(chunk.buf, starts, ends)
            _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            names = pa.array([chunk.buf[starts[i]: ends[i]].tobytes().decode().lower().encode() for i in first], pa.binary())
            place = np.searchsorted(hashes[first], value) if len(value) else value.astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(edges), names.take(pa.array(place)))
            front = [batch.column(i).slice(chunk.first, n) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*front, held], names=[*batch.schema.names[:-1], "words"])


def _bounds(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where each value begins and ends in them."""
    edges = np.frombuffer(names.buffers()[1], np.int32)[names.offset: names.offset + len(names) + 1].astype(np.int64)
    return np.frombuffer(names.buffers()[2], np.uint8)[edges[0]: edges[-1]], edges[:-1] - edges[0], edges[1:] - edges[0]


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some words alone, and where each begins and ends in them."""
    size = ends - starts
    to = np.cumsum(size)
    return buf[W.ragged(starts, size)], to - size, to


def _worths(model: Model, names: pa.Array) -> np.ndarray:
    return np.concatenate([model.values(*_bounds(names.slice(at, SLICE))) for at in range(0, len(names), SLICE)])


def fit(texts: list[str | None], toxic: list[int]) -> Model | None:
    """Multiple-instance training on labelled texts; None if a label is missing."""
    column = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    return fit_sets([b.column(0) for b in _word_sets(iter([column]))], toxic)


def _numbered(columns: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of all texts, and the numbers of each text's words, ascending. Takes the columns out of the list: the driver
    then holds every word once, and four bytes for each word of a text.

    Words are numbered by their hashes: ties between them then don't depend on the order of the rows."""
    sizes = np.concatenate([np.zeros(0, np.int32), *(np.diff(c.offsets.to_numpy()) for c in columns)])
    coded = []
    while columns:
        coded.insert(0, columns.pop().flatten().dictionary_encode())
    flat = pa.chunked_array(coded, pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries()
    names = flat.chunk(0).dictionary if flat.num_chunks else pa.array([], pa.binary())
    ids = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in flat.chunks)])
    hashes = [W.span_hashes(*_bounds(names.slice(at, SLICE))) for at in range(0, len(names), SLICE)]
    order = np.argsort(np.concatenate([np.zeros(0, np.uint64), *hashes]), kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    held, at, end = [], 0, 0
    for size in sizes.tolist():  # in place: no text has more distinct numbers than words
        mine = np.unique(number[ids[at: at + size]])
        at, begin, end = at + size, end, end + len(mine)
        ids[begin: end] = mine
        held.append(ids[begin: end])
    names = names.take(pa.array(order))
    del flat, coded
    pa.default_memory_pool().release_unused()
    return names, held


def _tallies(held: list[np.ndarray], toxic: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of how many different toxic and clean texts each word is one."""
    seen: set[bytes] = set()
    bad, good = np.zeros(n), np.zeros(n)
    for d, y in zip(held, toxic, strict=True):
        if (key := d.tobytes()) not in seen:
            seen.add(key)
            (bad if y else good)[d] += 1
    return bad, good


def fit_sets(columns: list[pa.Array], toxic: list[int]) -> Model | None:
    """`fit` on the distinct words of each text, as lists of binaries: the driver needs no texts. Empties `columns`."""
    toxic_ids = [i for i, y in enumerate(toxic) if y]
    if not toxic_ids or len(toxic_ids) == len(toxic):
        return None
    names, held = _numbered(columns)
    bad, good = _tallies(held, toxic, len(names))
    word = lambda i: names[int(i)].as_py()
    common = np.argsort(-good, kind="stable")[: NEGATIVES // 2]
    other = np.flatnonzero(good > 0)
    spread = other[np.argsort(W.mix(other.astype(np.uint64)), kind="stable")][: NEGATIVES // 2]
    clean = list(dict.fromkeys([*common[good[common] > 0].tolist(), *spread.tolist()]))
    odds = np.log(((bad + 0.5) / (1 + len(toxic_ids))) / ((good + 1) / (1 + len(toxic) - len(toxic_ids))))
    worth = bad * odds
    model, hard = None, []
    enough = 2 if len(toxic_ids) > 50 else 1  # a word of one text only may be anything
    for turn in range(ROUNDS):
        wins: dict[int, int] = {}
        for d in toxic_ids:
            if len(held[d]):
                w = int(held[d][np.argmax(worth[held[d]])])
                if odds[w] > 2.5 and (turn == 0 or worth[w] > 0) and bad[w] >= enough:
                    wins[w] = wins.get(w, 0) + 1
        if not wins:
            return None
        witnesses = sorted(wins, key=lambda w: (-wins[w], w))
        against = [word(w) for w in [*hard, *clean] if w not in wins and odds[w] < 2.5]
        model = _fit_words([word(w) for w in witnesses], against)
        worth = _worths(model, names)
        hard = [*dict.fromkeys([*other[np.argsort(-worth[other] + 5 * (odds[other] > 2.5), kind="stable")][: NEGATIVES // 6].tolist(), *hard])]
        worth = worth + 0.3 * np.clip(odds, -2, 4)
    raw = _worths(model, names)
    top = np.array([raw[d].max() if len(d) else -1.0 for d in held])
    # the curve also sees each toxic text as it would be with dots in its worst word
    worst = [int(held[d][np.argmax(raw[held[d]])]) for d in toxic_ids if len(held[d])]
    dotted = [g for g in (_dotted(word(w)) for w in worst) if g]
    more = model.values(*_joined(dotted)) if dotted else np.zeros(0)
    model.slope, model.shift = _curve(np.concatenate([top, more]), np.concatenate([np.array(toxic, bool), np.ones(len(more), bool)]))
    model.name = uuid.uuid4().hex
    return model


def _curve(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve with smoothed targets, both labels weighing the same."""
    n, m = label.sum(), (~label).sum()
    target = np.where(label, (n + 1) / (n + 2), 1 / (m + 2))
    weight = np.where(label, 0.5 / n, 0.5 / m)
    x = np.stack([value, np.ones(len(value))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 1e-6 * b)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled rows of each label. An id with both labels is toxic. The executors cut the texts into words;
    the driver gets each text's distinct words of at most LONGEST bytes."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    columns, toxic = [], []
    for y in (True, False):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        cut = rows.join(some, "id").select("id", F.xxhash64("text").alias("h"), "text").mapInArrow(_word_sets, f"id {kind}, h long, words array<binary>")
        found = cut.orderBy("id", "h").limit(sample).select("words").toArrow().column(0).combine_chunks()
        columns += found.chunks if isinstance(found, pa.ChunkedArray) else [found]
        toxic += [int(y)] * len(found)
        del found
    return fit_sets(columns, toxic)


class Scorer:
    """Remembers the values of words in a table of one slot a word."""

    SLOTS = 1 << 21

    def __init__(self, model: Model):
        self.model, self.keys, self.held = model, np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS)

    def tops(self, chunk: W.Chunk) -> np.ndarray:
        """Value of the worst word of each text."""
        starts, ends, doc = units(chunk)
        out = np.full(chunk.last - chunk.first, -np.inf)
        long = np.flatnonzero(ends - starts > LONGEST)
        if len(long):  # stretches of LONGEST bytes that overlap by half, cut at characters
            pieces = [(s, min(int(ends[i]), s + LONGEST), doc[i]) for i in long for s in range(int(starts[i]), int(ends[i]), LONGEST // 2)]
            more = np.array(pieces, np.int64)
            inside = np.concatenate([(chunk.buf & 0xC0) == 0x80, [False]])
            for column in (0, 1):
                for _ in range(3):
                    more[:, column] += inside[more[:, column]]
            keep = np.ones(len(starts), bool)
            keep[long] = False
            starts, ends, doc = np.concatenate([starts[keep], more[:, 0]]), np.concatenate([ends[keep], more[:, 1]]), np.concatenate([doc[keep], more[:, 2]])
        if len(starts):
            h = W.span_hashes(chunk.buf, starts, ends)
            slot = (h & _U(self.SLOTS - 1)).astype(np.int64)
            new = np.flatnonzero(self.keys[slot] != h)
            values = self.held[slot]
            if len(new):
                _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
                own = new[first]
                fresh = np.concatenate([self.model.values(*_cut(chunk.buf, starts[own[at: at + SLICE]], ends[own[at: at + SLICE]])) for at in range(0, len(own), SLICE)])
                values[new] = fresh[back]
                self.keys[slot[own]], self.held[slot[own]] = h[own], fresh
            np.maximum.at(out, doc, values)
        return out


_scorers: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One for each worker process and model."""
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def score(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Per document: id, score (0 to 1), predicted (1 from `least` on)."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value) if sent.value else None
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                n = chunk.last - chunk.first
                found = np.zeros(n)
                if scorer:
                    top = scorer.tops(chunk)
                    found = scorer.model.probability(np.where(np.isfinite(top), top, -1.0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, n), pa.array(found)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def flagged(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7, mark: str = "_predicted") -> DataFrame:
    """All rows and columns of docs, and `mark`, which must not be one of them: scored where they are, without a join."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def predicted(column: pa.Array) -> pa.Array:
        scorer, found = _scorer(sent.value), []
        for chunk in W.chunks(column):
            top = scorer.tops(chunk)
            found.append(scorer.model.probability(np.where(np.isfinite(top), top, -1.0)) >= least)
        return pa.array(np.concatenate([np.zeros(0, bool), *found]).astype(np.int32))

    return docs.withColumn(mark, predicted(F.col(text_col)))

"""Language-model scoring with Brown classes.

The CLASSED most frequent training words are put into CLASSES classes by exchange clustering: in every round, each word whose turn
it is moves to the class that raises the likelihood of the class bigrams most, all words in parallel against the same class
matrix. Every other word, known or not, belongs to a class by shape (length, last byte, bytes beyond ASCII), so a text's classes never
need a look-up that grows with the vocabulary. Class trigrams, bigrams and unigrams are interpolated (Witten-Bell); a word's probability
in its class is (c + 0.5) / (n + 0.5 * v), with one unknown word in each shape class. That is a distribution over all known words,
one unknown word per shape, and the end of a text.

Counts of the LISTED most frequent words travel with the tasks, a bound that doesn't grow; the counts of rarer words are joined.
Word, word-pair and class-trigram counts cover every training text in whole.

Nulls: a null text is empty, that is, one end token. Without training texts N is 0 and all words are unknown. Repeated rows are
scored each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.session import discard, staged

CLASSES, CLASSED, LISTED, ROUNDS = 64, 1 << 14, 1 << 19, 8
SHAPES = 16
END = CLASSES + SHAPES  # class of the end of a text; also its number among the words of a pair, after the classed ones
_K = END + 1


def _tokens(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape (0..SHAPES-1) of every word, and the first word of each text."""
    starts, ends, first = W.spans(chunk, W.BLANKS)
    wide = np.concatenate([[0], np.cumsum(chunk.buf >= 0x80)])
    size = ends - starts
    length = (size > 3).astype(np.int64) + (size > 6) + (size > 10)
    last = chunk.buf[ends - 1]
    mark = ((last < 0x30) | ((last > 0x39) & (last < 0x41))).astype(np.int64)
    shape = length + 4 * mark + 8 * (wide[ends] > wide[starts])
    return W.span_hashes(chunk.buf, starts, ends).view(np.int64), shape, first


class Listed:
    """Frequent words in hash order, and what is known of each."""

    def __init__(self, words: np.ndarray, **values: np.ndarray):
        order = np.argsort(words)
        self.words = words[order]
        self.values = {k: v[order] for k, v in values.items()}

    def places(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch.column(0)):
            words, shape, _ = _tokens(chunk)
            found, first, n = np.unique(words, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(shape[first].astype(np.int32)), pa.array(n)], names=["word", "shape", "n"])


def _sequence(values: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The values of each text with an end before and after it; texts in turn share their ends."""
    n = len(first) - 1
    out = np.full(len(values) + n + 1, end, np.int64)
    out[np.arange(len(values)) + W.owners(first) + 1] = values
    return out


def _pairs(batches: Iterator[pa.RecordBatch], classed: Listed, bound: int) -> Iterator[pa.RecordBatch]:
    """Counts of adjacent words: classed words by number, others by bound + shape, the end by bound + SHAPES."""
    for batch in batches:
        for chunk in W.chunks(batch.column(0)):
            words, shape, first = _tokens(chunk)
            at = classed.places(words)
            line = _sequence(np.where(at >= 0, at, bound + shape), first, bound + SHAPES)
            found, n = np.unique(line[:-1] << 20 | line[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((found >> 20).astype(np.int32)), pa.array((found & 0xFFFFF).astype(np.int32)), pa.array(n)], names=["u", "v", "n"])


def _matrix(spark: SparkSession, around: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs."""
    sent = spark.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_K, _K), np.int64)
        for batch in batches:
            for word, after, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                total[sent.value[word]] += np.bincount(sent.value[after.values.to_numpy()], n.values.to_numpy(), _K).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    out = np.zeros((_K, _K), np.int64)
    for i, j, n in around.select("word", "after", "n_after").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = n
    sent.unpersist()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(left: np.ndarray, right: np.ndarray, own: int, now: int, matrix: np.ndarray) -> int:
    """Class that gives the class bigrams the greatest likelihood if the word moves there from class `now`. left, right: counts of
    the classes before and after the word without itself; own: how often it follows itself."""
    m = matrix.astype(np.float64)
    m[:, now] -= left
    m[now, :] -= right
    m[now, now] -= own
    rows, columns = m.sum(1) + left, m.sum(0) + right  # the word's neighbours keep their classes, whichever the word takes
    many = left.sum() + right.sum() + own
    before, after = left[:, None], right[None, :]
    gain = (_xlogx(m + before) - _xlogx(m)).sum(0) + (_xlogx(m + after) - _xlogx(m)).sum(1)
    corner = np.diag(m)
    gain += _xlogx(corner + left + right + own) - _xlogx(corner + left) - _xlogx(corner + right) + _xlogx(corner)
    gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(columns + left.sum() + own) - _xlogx(columns)
    if many == 0:
        return now
    best = int(np.argmax(gain[:CLASSES]))
    return best if gain[best] > gain[now] + 1e-9 else now


def exchange(spark: SparkSession, around: DataFrame, n_words: int, bound: int) -> np.ndarray:
    """Class of each classed word, then of the shapes and the end, which stay where they are."""
    classes = np.concatenate([np.arange(bound) % CLASSES, CLASSES + np.arange(SHAPES + 1)])
    for turn in range(ROUNDS):
        matrix = _matrix(spark, around, classes)
        sent = spark.sparkContext.broadcast((classes, matrix))

        def move(batches: Iterator[pa.RecordBatch], turn=turn, sent=sent) -> Iterator[pa.RecordBatch]:
            known, table = sent.value
            for batch in batches:
                words, moved = [], []
                for i, word in enumerate(batch.column(0).to_pylist()):
                    if word >= bound or (word * 0x9E3779B1 >> 7) % 2 != turn % 2:
                        continue
                    sums, own = [], 0
                    for side in (1, 3):
                        other, n = batch.column(side)[i].values.to_numpy(), batch.column(side + 1)[i].values.to_numpy()
                        own = int(n[other == word].sum())
                        sums.append(np.bincount(known[other[other != word]], n[other != word], _K))
                    to = best_class(sums[1], sums[0], own, int(known[word]), table)
                    if to != known[word]:
                        words.append(word)
                        moved.append(to)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(moved, pa.int32())], names=["word", "to"])

        found = around.select("word", "after", "n_after", "before", "n_before").mapInArrow(move, "word int, to int").collect()  # at most a row for each classed word
        classes = classes.copy()
        for word, to in found:
            classes[word] = to
        sent.unpersist()
        if len(found) < n_words // 200:
            break
    return classes


def _trigrams(batches: Iterator[pa.RecordBatch], classed: Listed, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_K * _K * _K, np.int64)
    for batch in batches:
        for chunk in W.chunks(batch.column(0)):
            a, b, c = _contexts(chunk, *_tokens(chunk), classed, classes)
            total += np.bincount((a * _K + b) * _K + c, minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])


def _contexts(chunk, words, shape, first, classed: Listed, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token of each text (its end is a token) and of the two before it; a text begins after two ends."""
    at = classed.places(words)
    line = _sequence(np.where(at >= 0, classes[at], CLASSES + shape), first, END)
    two = np.concatenate([[END], line[:-2]])
    two[np.flatnonzero(line[:-1] == END)] = END
    return two, line[:-1], line[1:]


def transitions(counts: np.ndarray) -> np.ndarray:
    """log10 P(c | a, b) for all classes, interpolated."""
    n3 = counts.reshape(_K, _K, _K).astype(np.float64)
    n2 = n3.sum(0)
    n1 = n2.sum(0)
    one = (n1 + 0.5) / (n1.sum() + 0.5 * _K)

    def mixed(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds = (n > 0).sum(-1, keepdims=True)
        total = n.sum(-1, keepdims=True) + kinds
        return np.where(total > 0, (n + kinds * lower) / np.maximum(total, 1), lower)

    two = mixed(n2, one[None, :])
    return np.log10(mixed(n3, two[None, :, :]))


def score(spark: SparkSession, docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          listed_words: int = LISTED, classed_words: int = CLASSED) -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score, score. train: the rows to learn from."""
    learn = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = staged(spark, learn.mapInArrow(_counts, "word long, shape int, n long").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")))
    n_docs = learn.count()
    top = counts.orderBy(F.desc("n"), "word").limit(listed_words).toArrow()
    words, n, shape = (top[c].to_numpy() for c in ("word", "n", "shape"))
    by_shape = {r.shape: r for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    total, kinds = sum(r.n for r in by_shape.values()) + n_docs, sum(r.v for r in by_shape.values()) + (n_docs > 0)
    classed = Listed(words[:classed_words])
    many = n[:classed_words][np.argsort(words[:classed_words])]
    sent = spark.sparkContext.broadcast(classed)
    pairs = staged(spark, learn.mapInArrow(lambda it: _pairs(it, sent.value, classed_words), "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n")))
    after = pairs.groupBy(F.col("u").alias("word")).agg(F.collect_list(F.struct("v", "n")).alias("x"))  # a word has classed_words + SHAPES + 1 neighbours at most
    before = pairs.groupBy(F.col("v").alias("word")).agg(F.collect_list(F.struct("u", "n")).alias("y"))
    empty = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    around = staged(spark, after.join(before, "word", "full").select(
        "word", F.coalesce("x.v", empty[0]).alias("after"), F.coalesce("x.n", empty[1]).alias("n_after"), F.coalesce("y.u", empty[0]).alias("before"), F.coalesce("y.n", empty[1]).alias("n_before")))
    classes = exchange(spark, around, len(classed.words), classed_words)
    discard(spark, pairs, around)
    cells = np.zeros(_K**3, np.int64)
    for cell, m in learn.mapInArrow(lambda it: _trigrams(it, sent.value, classes), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # _K ** 3 rows at most
        cells[cell] = m
    mass, size = np.zeros(_K), np.zeros(_K)
    np.add.at(mass, classes[: len(many)], many)
    np.add.at(size, classes[: len(many)], 1)
    for s in range(SHAPES):
        own = shape[:classed_words] == s
        row = by_shape.get(s)
        mass[CLASSES + s] = (row.n if row else 0) - n[:classed_words][own].sum()
        size[CLASSES + s] = (row.v if row else 0) - own.sum() + 1
    class_of = np.where(np.arange(len(words)) < classed_words, -1, CLASSES + shape)
    class_of[: len(classed.words)] = classes[classed.places(words[:classed_words])]
    emit = np.log10((n + 0.5) / (mass[class_of] + 0.5 * size[class_of])) if len(words) else np.zeros(0)
    base = np.log10(n + 0.5)
    listed = Listed(words, emit=emit, base=base)
    model = spark.sparkContext.broadcast((classed, classes, transitions(cells), listed))
    floor = float(np.log10(total + 0.5 * (kinds + 1)))
    end_base = float(np.log10(n_docs + 0.5)) - floor
    shape_floor = np.log10(mass[CLASSES: END] + 0.5 * size[CLASSES: END])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores without the words that the list doesn't hold, which go along by hash."""
        classed, classes, steps, listed = model.value
        part, at_row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                m = chunk.last - chunk.first
                words, shape, first = _tokens(chunk)
                a, b, c = _contexts(chunk, words, shape, first, classed, classes)
                edges = first + np.arange(m + 1)
                place = listed.places(words)
                known = place >= 0
                emits = np.where(known, listed.values["emit"][place], 0.0) if len(listed.words) else np.zeros(len(words))
                bases = np.where(known, listed.values["base"][place] - floor, 0.0) if len(listed.words) else np.zeros(len(words))
                add = lambda x, e: np.add.reduceat(np.append(x, 0.0), e[:-1]) * (np.diff(e) > 0)
                score = add(steps[a, b, c], edges) + add(emits, first)
                rare = np.flatnonzero(~known)
                doc = W.owners(first)[rare]
                counts = np.bincount(doc, minlength=m)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(part + at_row + np.arange(m)), batch.column(0).slice(chunk.first, m), pa.array(np.diff(first) + 1),
                    pa.array(np.diff(first) - counts + (1 if n_docs else 0)), pa.array(add(bases, first) + end_base), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[rare])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(shape[rare].astype(np.int32)))],
                    names=["row", "id", "n_tokens", "n_known", "base", "score", "rare", "shapes"])
                at_row += m

    kind = docs.schema[id_col].dataType.simpleString()
    partial = staged(spark, docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        sums, f"row long, id {kind}, n_tokens long, n_known long, base double, score double, rare array<long>, shapes array<int>"))
    rare = partial.select("row", F.explode(F.arrays_zip("rare", "shapes")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.shapes").alias("of"))
    rarer = counts.select("word", "n").where(F.col("n") <= int(n[-1])) if len(n) == listed_words else counts.select("word", "n").where(F.lit(False))
    met = rare.join(rarer, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tail = F.element_at(F.array(*(F.lit(float(x)) for x in shape_floor)), F.col("of") + 1)
    logs = F.log10(F.col("n") + 0.5)
    more = met.groupBy("row").agg(F.sum((F.col("n") > 0).cast("long")).alias("k"), F.sum(logs - floor).alias("b"), F.sum(logs - tail).alias("s"))
    out = partial.select("row", "id", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"))

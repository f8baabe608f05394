"""Token alignment, source mixing and ranked search against plain versions, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pytest

from quarry.llm import alignment, impact_search, mixture

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, pair string, `rank` string, row string, item string, shard string"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, rows):
    """(doc_id, text[, source]) with further columns whose names clash with those used inside the operators."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", "y", "z", "r", "i", "h") for r in rows], SCHEMA)


def odd_texts(n):
    rng = random.Random(1)
    letters = [*"ab  \n\tTheing é日\x00ﬁ'sğя—…", "<0x41>", "<|endoftext|>", "<s>", " the", "ing", " ", "\xa0", "😀", "====="]
    return [(100 + k, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))) for k in range(n)]


@pytest.fixture(scope="module")
def aligned(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "the river"), (3, "a▁b"), (4, "a"), (4, "a"), (5, "x" * 5000), (6, "long " * 3000), *odd_texts(200)]
    return rows, alignment.encode(spark, documents(spark, rows), *PATHS), alignment.brute(rows, *PATHS)


@pytest.mark.parametrize("listed", [1 << 20, 50, 0])
def test_alignment_matches_the_libraries(spark, aligned, listed):
    _, encoded, want = aligned
    assert Counter(map(tuple, alignment.statistics(spark, encoded, *PATHS, listed).collect())) == Counter(want)


def test_alignment_groups_tile_the_texts(aligned):
    rows, encoded, want = aligned
    many = Counter((i, n) for (i, *_), (_, _, _, n, *_) in zip(rows, want, strict=True))
    found = alignment.groups(encoded, *PATHS).collect()
    assert Counter((r.id, len(r.groups)) for r in found) == many
    for r in found:
        assert [g.start for g in r.groups[1:]] == [g.end for g in r.groups[:-1]] and all(g.a and g.b and g.start < g.end for g in r.groups)
    ends = {r.id: r.groups[-1].end for r in found if r.groups}
    assert ends[6] == 15001 and ends[None] == 10


def test_alignment_of_an_empty_table(spark):
    encoded = alignment.encode(spark, documents(spark, []), *PATHS)
    assert alignment.statistics(spark, encoded, *PATHS).count() == 0


def one_by_one(votes, seats, most=None):
    out, most = [0] * len(votes), most or [seats] * len(votes)
    for _ in range(seats):
        open_ = [(-Fraction(v) / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, out, most, strict=True)) if v and s < m]
        if open_:
            out[min(open_)[1]] += 1
    return out


def test_sainte_lague_gives_the_highest_quotients():
    rng = random.Random(2)
    for _ in range(300):
        votes = [rng.choice([0, 1, 5, rng.randint(1, 1000), Fraction(rng.randint(1, 99), 7)]) for _ in range(rng.randint(1, 8))]
        seats, most = rng.randint(0, 60), [rng.randint(0, 20) for _ in votes] if rng.random() < 0.4 else None
        assert mixture.sainte_lague(votes, seats, most) == one_by_one(votes, seats, most)
    assert sum(mixture.sainte_lague([10**15, 1, 3 * 10**14], 10**12)) == 10**12


def test_targets_are_capped_and_shared_again():
    assert mixture.targets([100, 100, 100], [3, 1, 2], Fraction(450), 2) == [200, Fraction(250, 3), Fraction(500, 3)]
    assert mixture.targets([10, 0, 1000], [3, 1, 2], Fraction(1515), 2) == [20, 0, 1495]
    assert mixture.targets([], [], Fraction(0), 2) == []


@pytest.mark.parametrize("shard_words", [1 << 18, 300])
def test_mix_meets_its_targets(spark, shard_words):
    rng = random.Random(3)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "B", "é", None, "tiny" if k < 12 else "a"])) for k in range(900)]
    rows += [(7, "again and again", "B")] * 20 + [(None, None, "B"), (None, "x\ty\x0bz", None), (5000, "word " * 20000, "é")]
    found = mixture.mix(spark, documents(spark, rows), shard_words=shard_words).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in found) == Counter((i, len((t or "").split()), s) for i, t, s in rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in names]
    goals = dict(zip(names, mixture.targets(sizes, [3, 1, 2, 3, 1][: len(names)], Fraction(3, 2) * sum(sizes), 2), strict=True))
    for name, size in zip(names, sizes, strict=True):
        own = [r for r in found if r.source == name]
        assert {r.source_size for r in own} == {size} and {r.target for r in own} == {float(goals[name])}
        assert abs(sum(r.taken for r in own) - goals[name]) <= 2 + goals[name] / 100
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    again = mixture.mix(spark, documents(spark, rows).repartition(3), shard_words=shard_words).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert Counter(map(tuple, mixture.mix(spark, documents(spark, rows), seed=1, shard_words=shard_words).collect())) != Counter(map(tuple, found))


def test_mix_takes_whole_blocks(spark):
    """With a large block every document's share follows from the blocks of its shard that the permutation puts first."""
    rows = [(k, "w " * (k % 9), "ab"[k % 2]) for k in range(200)]
    found = mixture.mix(spark, documents(spark, rows), block=7).collect()
    for source in "ab":
        own = sorted((r for r in found if r.source == source and r.size), key=lambda r: r.place)
        words = [r.doc_id for r in own for _ in range(r.size)]
        taken = Counter({r.doc_id: r.taken for r in own})
        n, total = -(-len(words) // 7), sum(taken.values())
        factor, shift = mixture.permutation(n, 0, source, 0)
        want = next((c for q in range(2 * n + 1) if sum((c := Counter(w for at, w in enumerate(words) for _ in range(q // n + ((factor * (at // 7) + shift) % n < q % n)))).values()) == total), None)
        assert want is not None and +taken == want


def test_mix_of_empty_tables_and_texts(spark):
    assert mixture.mix(spark, documents(spark, [])).count() == 0
    found = mixture.mix(spark, documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in found] == [(0, 0, 0.0, 0)] * 2


ITEMS = [(1, "The river THE"), (1, "stone w1"), (2, None), (3, ""), (None, "w3 w4 été zzz"), (5, "qqq"), (6, " ".join(f"w{i}" for i in range(60))), (2, "the of and"),
         (6, " ".join(f"w{i}" for i in range(60))), (7, "of " * 50)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 5])
@pytest.mark.parametrize("k", [10, 1, 1000])
def test_search_matches_all_scores(spark, k, block_bytes):
    rng = random.Random(4)
    words = ["the", "of", "and", "river", "stone", "light", "été", "ñandú", "straße", "12", "3.5", "it's", "THE", "A_b", *(f"w{i}" for i in range(60))]
    rows = [(1, None), (2, ""), (3, " - "), (None, "the river"), (None, "the river"), (7, "the river"), (7, "the river"), (4, "The"), (9, "long the " * 3000)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(500)]
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, score int")
    found = impact_search.search(spark, documents(spark, rows), items, k, block_bytes=block_bytes)
    assert Counter(map(tuple, found.collect())) == Counter(impact_search.brute(rows, ITEMS, k))


def test_search_stops_before_the_lists_end(spark):
    """A document that holds the item whole is found without reading the lists of its common words through."""
    import numpy as np

    rows = [(i, "common " * (1 + i % 3) + f"w{i}") for i in range(5000)] + [(9000, "rare words of one item common")]
    items = impact_search.Items([(1, "rare words of one item")])
    (batch,) = impact_search._postings(iter([documents(spark, rows).coalesce(1).select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]]), items)
    shard = impact_search.Impacts(batch.to_pylist()[0], np.full(len(items.vocabulary), 1000), 5001, 30000)
    docs, scores = shard.search(*items.terms[0], 1, np.zeros(0, np.int64))
    assert shard.ids[docs].tolist() == [9000] and len(scores) == 1


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert impact_search.search(spark, documents(spark, [(1, "a")]), none).count() == 0
    assert impact_search.search(spark, documents(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0

"""The dealt operators against brute force, exact round trips and held-out accuracy, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, brown, decontaminate, line_dedup, linking, ngram_join, token_files, topk, toxicity, warc
from quarry.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, node string"


def documents(spark, rows):
    """Rows with further columns whose names clash with those used inside the operators."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z") for i, t in rows], SCHEMA)


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and river stone light over under quick brown été ñandú straße 12 3.5 it's".split()) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [(1, BASE), (2, BASE), (3, BASE.replace("river", "brook", 1)), (4, None), (5, ""), (6, "  \n \t"), (7, "one"), (8, "One"), (9, "two words"), (10, prose(2)),
         (11, prose(2) + " tail"), (12, "long " * 3000 + prose(3)), (13, BASE + "\n" + BASE), (13, BASE + "\n" + BASE), (-14, "日本語 " + BASE), (15, "a" * 5000)]


def test_word_hashes_and_shingles():
    column = pa.array(["Ab cd", None, "", "x", "ab CD ef", "été"])
    (chunk,) = W.chunks(column)
    starts, ends, first = W.spans(chunk, W.BLANKS)
    h = W.span_hashes(chunk.buf, starts, ends)
    assert np.diff(first).tolist() == [2, 0, 0, 1, 3, 1]
    assert (h[:2] == h[3:5]).all() and len(set(h.tolist())) == 5
    doc, s = W.shingles(h, first, 2)
    assert sorted(Counter(doc.tolist()).items()) == [(0, 1), (3, 1), (4, 2), (5, 1)]
    assert s[doc == 0][0] in s[doc == 4]
    assert [c.last - c.first for c in W.chunks(pa.array(["x" * 100, "y", "z" * 5]), 6)] == [1, 2]


@pytest.mark.parametrize("count", [1, 5000])
def test_fm_index_finds_all_windows(spark, count):
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, "short item"), (3, None), (4, ""), (None, "one"), (2, "short item"), (9, "Two, WORDS")]
    rows = [*TEXTS, (20, "w0 " + " ".join(f"W{i}" for i in range(3, 18)) + " tail"), (21, "a Short  ITEM, short item"), (22, "short item " * count)]
    found = decontaminate.contamination(spark, documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=60).collect()
    texts = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found)
    named = [(str(i), t) for i, t in items if i is not None and t]
    want = Counter((i, n, h, tuple(x)) for i, t in rows for n, h, x in [decontaminate.brute(t, named)])
    assert texts == want
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in found}
    assert spans[20] == [(1, 16)] and spans[22] == [(0, 2 * count)]
    assert {r.doc_id for r in found if r.contaminated} >= {9, 20, 21, 22}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(spark, documents(spark, []), none).count() == 0
    assert decontaminate.contamination(spark, documents(spark, TEXTS), none).where("contaminated").count() == 0


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(3)
    rows = list(TEXTS)
    for k in range(60):  # copies that drift from one another, so that links chain
        words = BASE.split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        rows.append((100 + k, " ".join(words)))
    found = ngram_join.jaccard_join(spark, documents(spark, [*rows, (None, BASE)]))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert got == Counter([*ngram_join.brute(rows), (None, ngram_join.brute([(1, BASE)])[0][1], None)])
    assert ngram_join.jaccard_join(spark, documents(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    out = {r.node: r.component for r in linking.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 1 for i in range(1, 41)) and all(out[i] == 100 for i in range(100, 160)) and out[200] == 199


def test_fuzzy_lines_match_brute_force(spark):
    line = "the quick brown fox jumps over the lazy dog beside the river bank at dawn"
    rows = [(3, f"{line}\n\nother\n{line}!"), (1, f"{line}.\nab\nab"), (2, None), (4, ""), (5, "\n \n"), (6, "ab\nother\r"), (7, "unlike anything else here at all"),
            (8, "x" * 20000), (9, "x" * 20001), (10, "ñandú été straße — “quoted” words in a line that is long"), (11, "ñandú été straße — “quoted” words in a line that is lon")]
    docs = documents(spark, [*rows, (None, line)])
    found = line_dedup.fuzzy_lines(spark, docs)
    want = line_dedup.brute(rows)
    assert {r.doc_id: r.dropped for r in found.collect() if r.doc_id is not None} == want
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(docs, found).collect()}
    assert kept[1] == f"{line}.\nab" and kept[2] is None and kept[3] == "\nother" and kept[6] == "" or kept[6] is not None
    assert kept[5] == "\n \n" and kept[None] == line
    assert line_dedup.fuzzy_lines(spark, documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(spark, name):
    path, rng = public_tokenizers.path(name), random.Random(4)
    odd = [*"'strevmldSTRE  \n\t\xa0 aB1,.-!ÉßÀ²½ªµ×÷€–“", *map(chr, range(0x180, 0x250)), "日", "é", "\x1f", "​"]
    rows = [*TEXTS, *((1000 + k, "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))) for k in range(400)),
            (5000, "x<|endoftext|>y"), (5001, "<|startoftext|>"), (5002, "'" * 9), (5003, "b" * 3000), (5004, "=" * 4000 + "'s")]
    library = Tokenizer.from_file(path)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.decode(bpe.encode(spark, documents(spark, rows), path), path).collect())
    want = [(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == Counter((i, ids, library.decode(list(ids), skip_special_tokens=False)) for i, ids in want)


def test_lexicon_is_minimal_and_exact(tmp_path):
    vocab = bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    words = sorted({w.encode() for w in "talk talks talked walk walks walked a été".split()})
    bpe.Lexicon.compile(words, vocab, str(tmp_path / "x.bin"))
    lexicon = bpe.Lexicon(str(tmp_path / "x.bin"))
    asked = [*words, b"tal", b"walking", b"b", b"talkss"]
    ends = np.cumsum([len(w) for w in asked])
    places = lexicon.look_up(np.frombuffer(b"".join(asked), np.uint8), ends - [len(w) for w in asked], ends)
    assert places.tolist() == [*range(len(words)), -1, -1, -1, -1]
    for word, p in zip(words, places, strict=False):
        assert lexicon.ids[lexicon.places[p]: lexicon.places[p + 1]].tolist() == vocab.library.encode(word.decode(), add_special_tokens=False).ids
    assert len(lexicon.final) < sum(map(len, words))  # shared suffixes


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*TEXTS, (None, "null id")]
    manifest = token_files.write(spark, documents(spark, rows), path, folder=f"file://{tmp_path}")
    library, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.read(spark, manifest).collect()), key=lambda r: r[1]) == want
    some = token_files.read(spark, manifest, wanted=[12, 3, 99]).collect()
    assert sorted(map(tuple, some)) == sorted(w for w in want if w[0] in (3, 12))
    row = max(manifest.collect(), key=lambda r: r.bytes)
    data = bytearray((tmp_path / row.path.rpartition("/")[2]).read_bytes())
    data[20] ^= 1
    with pytest.raises(Exception, match="checksum|zstd|decompress|rror"):
        reader = token_files.Reader(pa.BufferReader(bytes(data)))
        list(reader.documents(range(len(reader.ids))))
    assert token_files.read(spark, token_files.write(spark, documents(spark, []), path)).count() == 0


def test_warc_chain_rejects_magic_in_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a", "<p>é</p>"), (2, None, None), (3, "u", ""), (5, "u", "<p>é</p>"), (4, "u\r\nX: y", fake + "tail" + fake), (6, "u", fake), (7, "u", "WARC/1.1\r\n" * 50), (9, "u", "z" * 20000)]
    pages = spark.createDataFrame([(*r, 7) for r in [*rows, (None, "n", "n")]], "page_id long, url string, html string, file int")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        archive = warc.write(spark, pages.repartition(2), f"{tmp_path}/w")
        records = warc.read(spark, archive)
        found = {r.page_id: r for r in warc.pages(records).collect()}
        payloads = {r.payload_hex for r in records.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found.pop(None).record_type == "response" and sorted(found) == [1, 2, 3, 4, 5, 6, 7, 9]
    for i, _, html in rows:
        data = (html or "").encode()
        assert found[i].payload_bytes == len(data)
        assert hashlib.sha1(data).hexdigest() in payloads
        assert found[i].refers_to == {5: 1, 3: 2}.get(i) and found[i].record_type == ("revisit" if i in (5, 3) else "response")
    assert warc.read(spark, warc.write(spark, pages.limit(0), f"{tmp_path}/none")).count() == 0
    torn = tmp_path / "torn"
    torn.mkdir()
    (torn / "a.txt").write_bytes(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")
    with pytest.raises(ValueError, match="breaks off"):
        warc.read(spark, str(torn)).count()


def test_warc_headers_have_no_bound(spark, tmp_path):
    url = "data:text/plain," + "x" * 100_000
    pages = spark.createDataFrame([(1, "u", "a"), (2, url, "b"), (3, "v", "c")], "page_id long, url string, html string")
    found = warc.pages(warc.read(spark, warc.write(spark, pages.coalesce(1), f"{tmp_path}/w"))).collect()
    assert {r.page_id: r.url for r in found} == {1: "u", 2: url, 3: "v"}


def test_warc_records_outlast_a_change_of_splits(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(60)], "page_id long, url string, html string")
    archive = warc.write(spark, pages.coalesce(1), f"{tmp_path}/w")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        records = warc.read(spark, archive)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        assert {r.page_id for r in warc.pages(records).collect()} == set(range(60))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("cosine", [0.0, 0.75])
def test_top_k_matches_brute_force(spark, monkeypatch, cosine):
    monkeypatch.setattr(topk, "COSINE", cosine)
    monkeypatch.setattr(topk, "BUCKET", 16)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.2, 1, 3])]) for i in range(150)]
    rows += [(200 + i, [1.0] * 8) for i in range(30)] + [(300, None), (301, [1.0, None]), (302, [math.nan] * 8), (303, [math.inf] * 8), (304, [0.0] * 8), (320, [2.0] * 3), (340, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    whole = {i: np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 8 - len(v))).astype(int) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 20 == 0:
            best = sorted((-int(whole[q] @ whole[v]), v) for v in whole if v != q)[:20]
            want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(spark, df, df.where("vec_id % 20 = 0")).collect())) == sorted(want)
    assert topk.top_k(spark, df.limit(0), df.limit(0)).count() == 0


def test_brown_scores(spark):
    rows = [*TEXTS, *((100 + k, prose(k, 200)) for k in range(40))]
    docs = documents(spark, rows)
    got = brown.score(spark, docs, docs.where("doc_id >= 100 or doc_id < 5")).collect()
    tokens = lambda t: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(), None]
    count = Counter(w for i, t in rows if i >= 100 or i < 5 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == Counter(
        (i, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.doc_id == 10]
    assert held[0].score > held[0].base_score
    empty = brown.score(spark, docs, docs.limit(0)).collect()
    assert len(empty) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 for r in empty)


def test_brown_joins_rare_words(spark):
    rows = [(k, prose(k, 80) + f" rare{k % 3}") for k in range(12)]
    docs = documents(spark, rows)
    whole = {r.doc_id: r for r in brown.score(spark, docs, docs).collect()}
    few = {r.doc_id: r for r in brown.score(spark, docs, docs, listed_words=6, classed_words=4).collect()}
    for i in whole:
        assert few[i].n_known == whole[i].n_known and abs(few[i].base_score - whole[i].base_score) < 1e-6


def test_class_probabilities_sum_to_one():
    counts = np.random.default_rng(2).integers(0, 3, brown._K**3) * (np.arange(brown._K**3) % 7 == 0)
    assert np.allclose((10.0 ** brown.transitions(counts)).sum(-1), 1)


def test_best_class_raises_the_likelihood():
    rng = np.random.default_rng(3)
    k, n = brown._K, 30
    words = rng.poisson(0.6, (n, n))
    classes = rng.integers(0, 5, n)

    def likelihood(c):
        m = np.zeros((k, k))
        np.add.at(m, (c[:, None].repeat(n, 1), c[None, :].repeat(n, 0)), words)
        return brown._xlogx(m).sum() - brown._xlogx(m.sum(0)).sum() - brown._xlogx(m.sum(1)).sum(), m.astype(np.int64)

    for w in range(n):
        _, m = likelihood(classes)
        others = np.arange(n) != w
        left, right = np.bincount(classes[others], words[others, w], k), np.bincount(classes[others], words[w, others], k)
        got = brown.best_class(left, right, int(words[w, w]), int(classes[w]), m)
        tried = [likelihood(np.where(np.arange(n) == w, c, classes))[0] for c in range(brown.CLASSES)]
        assert abs(tried[got] - max(tried)) < 1e-6


def test_string_kernel_on_held_out_texts(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(300):
        words = prose(k, 40).split()
        if k % 3 == 0:
            words.insert(rng.randrange(40), rng.choice(["blockhead", "nitwit", "dimwit"]) + rng.choice(["", "s", "!"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 3 == 0)))
    docs, told = documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (900, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, docs, told.where("doc_id < 150"))
    more = documents(spark, [*rows, *((1000 + i, t) for i, t in TEXTS), (500, "you n.i.t.w.i.t go"), (501, "a block*head here")])
    found = toxicity.score(spark, more, model).collect()
    hits = {r.doc_id for r in found if r.predicted == 1}
    assert {k for k, _, y in labels if y} | {500, 501} <= hits and not hits & ({k for k, _, y in labels if not y} | {1004, 1005, 1006, 1007})
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in toxicity.score(spark, docs, toxicity.train(spark, docs, told.limit(0))).collect()} == {0.0}


def test_fit_holds_each_word_once():
    rng = random.Random(9)
    names = [f"w{k:06d}x".encode() for k in range(30000)]
    columns = [pa.array([rng.sample(names, 150) for _ in range(800)], pa.list_(pa.binary())) for _ in range(2)]
    want = [[sorted(d) for d in c.to_pylist()] for c in columns]
    tracemalloc.start()
    words, held = toxicity._numbered(columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert columns == [] and [sorted(words[int(i)].as_py() for i in d) for d in held[::100]] == sum(want, [])[::100]
    assert all((np.diff(d) > 0).all() for d in held) and held[0].itemsize == 4
    assert peak < 6_000_000


def test_kernel_of_landmarks_is_the_product_of_their_subsequences():
    marks, words = [b"idiot", b"i.d.i.o.t", b"aaaa", b"hello"], [b"idiots", b"aaa", b"zzz", b"hell", b"x"]

    def weights(word):
        _, h, value = toxicity._features([word])
        out = {}
        for k, v in zip(h.tolist(), value.tolist(), strict=True):
            out[k] = max(v, out.get(k, 0))
        return out

    of, by = [weights(w) for w in words], [weights(m) for m in marks]
    want = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in by] for a in of]
    assert np.allclose(toxicity.Table.of(marks).kernel(words), want)


def test_scores_of_words_do_not_depend_on_the_texts_around_them():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcdeé"), 6)) for _ in range(5000)})
    _, keys, _ = toxicity._features([w.encode() for w in words[:40]])
    keys = np.unique(keys)
    model = toxicity.Model(keys, rng.normal(size=len(keys)), toxicity.BIAS, name="t")
    seen = []
    values = model.values
    model.values = lambda buf, starts, ends: seen.append(len(buf)) or values(buf, starts, ends)
    tops = toxicity.Scorer(model).tops(next(W.chunks(pa.array([" ".join(words), *words[:3]]))))
    alone = [values(*toxicity._joined([w.encode()]))[0] for w in words]
    assert tops[0] == max(alone) and tops[1:].tolist() == alone[:3]
    assert max(seen) < 10 * toxicity.SLICE < sum(len(w.encode()) for w in words)  # no call gets the whole texts


def test_sketches_keep_alike_pairs_and_drop_others(spark):
    rng = random.Random(2)
    base = [f"{rng.getrandbits(24):06x}" for _ in range(60)]

    def line(swaps):
        out = list(base)
        for k in rng.sample(range(60), swaps):
            out[k] = f"{rng.getrandbits(24):06x}"
        return " ".join(out)

    lines = [line(s) for s in [0, 1, 2, 3, *[9] * 60]] + ["ab", "ab"]
    items = spark.createDataFrame(list(enumerate(x.encode() for x in lines)), "node long, item binary")
    told = linking.sketches(items, lambda c: line_dedup.line_sets(c, 5))
    one, two = (told.select(*(F.col(c).alias(f"{c}_{s}") for c in told.columns)) for s in ("a", "b"))
    left = {(r.node_a, r.node_b) for r in one.join(two, F.expr("node_a < node_b") & linking.sketches_allow(80)).select("node_a", "node_b").collect()}
    sets = [{x[k: k + 5] for k in range(max(1, len(x) - 4))} for x in lines]
    alike = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert alike <= left and len(left - alike) < 100  # of 1770 pairs of lines with nine words changed, that share bands


def test_packed_postings_lead_to_the_smallest_node(spark):
    rng = np.random.default_rng(8)
    chunks = [(rng.integers(0, 400, 700), rng.permutation(3000)[:700]) for _ in range(5)]
    rows = [r for k, n in chunks for r in linking.packed(k.astype(np.int64), n.astype(np.int64)).to_pylist()]
    met = linking.with_hubs(spark.createDataFrame([(r["slot"], r["own"], r["local"]) for r in rows], linking.PACKED)).collect()
    want = {}
    for keys, nodes in chunks:
        for k, n in zip(keys.tolist(), nodes.tolist(), strict=True):
            want.setdefault(k, set()).add(n)
    got = {}
    for r in met:
        assert r.hub < r.node
        got.setdefault(r.key, set()).update((r.node, r.hub))
    assert got == {k: v for k, v in want.items() if len(v) > 1}
    assert len(linking.packed(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0

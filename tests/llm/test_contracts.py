"""Contract cases of operators 1 and 5, and the stages of the pipeline on tables whose columns have the names of inner ones."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

from quarry.llm import line_dedup, ngram_join, topk, toxicity, warc  # noqa: E402


def archived(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return warc.pages(warc.read(spark, warc.write(spark, pages))).collect()


def test_header_lines_end_at_cr_lf_only(spark):
    urls = {1: "http://x/ X-Payload-Length: 5", 2: "http://x/\u0085WARC-Refers-To: <urn:page:77>", 3: "http://x/  "}
    got = {r.page_id: r for r in archived(spark, [(i, u, f"p{i}é") for i, u in urls.items()])}
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got.items()} == {i: (4, "response", None) for i in urls}
    assert got[1].url == urls[1] and got[2].url == urls[2]


def test_every_row_has_a_record_and_every_payload_one_response(spark):
    rows = [(None, "u", "same"), (5, "v", "same"), (5, "u", "same"), (5, "u", "same"), (9, None, "same"), (None, None, None), (None, None, None), (7, "u", "own")]
    got = archived(spark, rows)
    same = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_bytes == 4)
    assert len(got) == len(rows)
    assert same == [(0, "revisit", 5), (5, "response", None), (5, "revisit", 5), (5, "revisit", 5), (9, "revisit", 5)]
    assert sorted(r.record_type for r in got if r.payload_bytes == 0) == ["response", "revisit"]
    assert [(r.page_id, r.record_type) for r in got if r.payload_bytes == 3] == [(7, "response")]


def test_products_of_large_components_are_exact(spark):
    rows = [(0, [1.0, 0.0]), (1, [4e7, 1.0]), (2, [3.0, 1.0]), (3, [-4e7, 1.0]), (4, [1e7, -1e7])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(spark, vectors, vectors, k=4).orderBy("query_id", "rank").collect()
    want = []
    for q, x in rows:
        scores = [(-sum(int(64 * a) * int(64 * b) for a, b in zip(x, y, strict=True)), v) for v, y in rows if v != q]
        want += [(q, n + 1, v, -s) for n, (s, v) in enumerate(sorted(scores))]
    assert [tuple(r) for r in got] == want


def test_products_beyond_64_bits_raise(spark):
    vectors = spark.createDataFrame([(0, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(spark, vectors, vectors).collect()


def test_a_repeated_query_id_counts_by_its_smallest_vector(spark):
    vectors = spark.createDataFrame([(0, [2.0]), (0, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(spark, vectors, vectors.where("vec_id = 0")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 4096)]


INNER = "doc_id long, text string, _predicted int, _contaminated string, _key string, _id long, _dropped string, _removed string, _goes long"
CLEAN = [f"line {i} tells of {w} and other things that nobody minds at all" for i, w in enumerate("apples birds clouds drums eagles forests gates hills".split())]


def others(n):
    """Clean texts of words of which each stands in several."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(120)]
    return [" ".join(rng.choice(words) for _ in range(25)) for _ in range(n)]


def test_stages_keep_columns_with_inner_names(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    phrase = " ".join(f"benchword{i}" for i in range(15))
    texts = [*CLEAN, CLEAN[0], phrase, None, "", "you zorkface idiot", "what a zorkface", "a zorkface again", *[f"zorkface number{i}" for i in range(12)], *others(60)]
    docs = spark.createDataFrame([(i, t, 3, "c", "k", 8, "d", "r", 9) for i, t in enumerate(texts)], INNER)
    spark.createDataFrame([(i, int("zorkface" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", phrase)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        assert {tuple(r)[2:] for r in kept.collect()} == {(3, "c", "k", 8, "d", "r", 9)}
        left[name] = {r.doc_id: r.text for r in kept.collect()}
    toxic = {i for i, t in enumerate(texts) if t and "zorkface" in t}
    assert set(left["toxicity"]) == set(range(len(texts))) - toxic
    assert {i for i, t in left["line dedup"].items() if t != texts[i]} == {i for i, gone in line_dedup.brute(list(enumerate(texts))).items() if gone}
    assert set(left["line dedup"]) == set(range(len(texts)))
    gone = {i for i, _, c in ngram_join.brute(list(enumerate(texts)), 5, 80) if c != i}
    assert set(left["n-gram jaccard join"]) == set(range(len(texts))) - gone and 8 in gone
    assert set(left["benchmark decontamination"]) == set(range(len(texts))) - {9}
    done = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(done) == set(range(len(texts))) - toxic - {9}  # line dedup has emptied the copy, which then links with nothing


def test_conflicting_labels_count_as_toxic(spark):
    texts = [*(f"{t} zorkface" for t in others(12)), *others(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(72)] + [(0, 0), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(spark, docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(spark, docs, model).collect()}
    assert got == {i: int(i < 12) for i in range(72)}

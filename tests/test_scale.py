"""What keeps a task's memory, the exchanges and the repeated work bounded; results stand in the other tests."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.catalogue import relations, stored
from quarry.functions import vectors as V
from quarry.operators import blocks as B
from quarry.operators import graph as G
from quarry.operators import ranking as K
from quarry.plans import extract as E
from quarry.plans.extract import extract
from quarry.session import COMPILED_BYTES
from quarry.sources.warehouse import Warehouse


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_run_in_methods_that_are_compiled(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    files = spark.createDataFrame([("r", "a.py", "python", "def f(x):\n    return g(x)\n")], "repo string, path string, lang string, text string")
    extract(files)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == str(COMPILED_BYTES)


def test_embeddings_stay_inside_the_row(spark):
    texts = [None, "", "12 !", "one", "fooBar foo_bar FOO foo", "a b a b a", " ".join(f"w{i % 700}x{chr(97 + i % 26)}" for i in range(9000)), "Über zwei"]
    df = V.HashedFeatures().embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert "Exchange" not in _plan(df)
    for row in df.collect():
        want = V.HashedFeatures().query(texts[row["id"]])
        assert len(row["embedding"]) == V.DIM
        assert max(abs(a - b) for a, b in zip(row["embedding"], want, strict=True)) < 1e-6


def test_a_text_is_digested_once(spark):
    column = V.digest_embedding(F.col("text"))
    assert not re.search(r"lambdafunction\(.*sha2\(", str(column))
    rows = spark.createDataFrame([("abc",), ("",), (None,)], "text string").select("text", column.alias("v"), V.digest_embedding(F.col("text"), 40).alias("w")).collect()
    for text, v, w in rows:
        want = [None] * V.DIM if text is None else V.DigestStub().query(text)
        assert len(v) == V.DIM and w == v[:40]
        assert all(a is b if b is None else abs(a - b) < 1e-6 for a, b in zip(v, want, strict=True))


def test_co_change_tasks_are_bounded_and_nothing_is_sorted_for_its_stamp(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relations, "TASK_LINES", 5)
    lines = [(o, p, p) for o in range(20) for p in (1, 2, 3 + o)] + [(0, 1, 1), (None, 1, 1), (20, 1, 1), (20, 2, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(o, f"2001-12-{o + 1:02}") for o in range(20)] + [(20, None)], "o_orderkey long, d string")
    orders.select("o_orderkey", F.col("d").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    df = relations.co_change_parts(spark, str(tmp_path))
    plan = _plan(df)
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan and f"{-(-len(lines) // 5)}), REPARTITION_BY_NUM" in plan
    assert [tuple(r)[:3] + (r["last_seen"],) for r in df.collect()] == [(1, 2, 21, "2001-12-20")]


def test_blocks_take_one_exchange_of_texts(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w0") for i in range(300)] + [(7, "w9 w9"), (8, None)], "doc_id long, text string")
    dealt = B.by_stretch(docs, "doc_id", 302, 16)
    blocks = B.posting_blocks(K.postings(dealt, ["stretch", "doc_id"], "text"), "doc_id", 302, 3.0, 16)
    assert _plan(blocks).count("Exchange") == 1
    old = B.posting_blocks(K.postings(docs, ["doc_id"], "text"), "doc_id", 302, 3.0, 16)
    rows = lambda df: Counter((r["term"], r["stretch"], r["n"], round(r["peak"], 9), tuple(sorted((x["key"], x["tf"]) for x in r["rows"]))) for r in df.collect())
    assert rows(blocks) == rows(old)


def test_the_last_step_of_a_traversal_is_not_stored(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")], "src string, dst string")
    for depth in (1, 2, 3):
        seen = []
        found = G.callers_within(edges, spark.createDataFrame([("a",)], "node string"), depth, stage=lambda df, seen=seen: seen.append(1) or df)
        assert len(seen) == depth - 1
        assert {tuple(r) for r in found.collect()} == set(list(zip("bcde", range(1, 5)))[:depth])


def test_what_changed_is_found_once(spark, tmp_path, monkeypatch):
    calls, staged = [], stored.staged
    monkeypatch.setattr(stored, "staged", lambda spark, df: calls.append(df.columns) or staged(spark, df))
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    stored.store(warehouse, spark.createDataFrame([("a", "x y\nz"), ("b", "u")], "path string, text string"), 2)
    stored.store(warehouse, spark.createDataFrame([("a", "x y\nz"), ("c", "v")], "path string, text string"), 2)
    assert calls == [["path", "status"]] * 2
    assert {(r["path"], r["name"]) for r in warehouse.read("symbols", stored.REPO).collect()} == {("a", "x"), ("a", "z"), ("c", "v")}


def test_windows_of_the_extraction_copy_few_columns(spark):
    files = spark.createDataFrame([("r", "a.py", "python", "def f(x):\n    return g(x)\n")], "repo string, path string, lang string, text string")
    placed = E.place(E.lex(files))
    assert not {"p1", "t1", "t5", "k1"} & set(placed.columns)
    plan = E.entities(files)._jdf.queryExecution().optimizedPlan()
    widest, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Window":
            widest = max(widest, node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < widest <= 32


def test_extraction_tasks_get_a_bounded_text_and_two_stages(spark, tmp_path, monkeypatch):
    source = "class C{0}:\n    def f_{0}(self, x: D) -> D:\n        return g_{0}(h(x))\n"
    rows = [("r", f"m{i}.py", "python", source.format(i)) for i in range(30)] + [("r", "n.txt", "text", "x" * 100_000), ("r", "e.py", "python", None)]
    files = spark.createDataFrame(rows, "repo string, path string, lang string, text string")
    size = sum(len(text) for _, _, lang, text in rows if lang == "python" and text)
    monkeypatch.setattr(E, "TASK_BYTES", 100)
    tasks = -(-size // 100)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: re.findall(r"hashpartitioning\((f[12])#\d+L?, f[12]#\d+L?, (\d+)\), REPARTITION_BY_NUM", _plan(df))
    assert dealt(E.entities(files)) == [("f1", str(tasks)), ("f2", str(tasks))]
    stored = []

    def stage(df):
        df.write.parquet(f"{tmp_path}/found{len(stored)}")
        stored.append(1)
        return spark.read.parquet(f"{tmp_path}/found{len(stored) - 1}")

    for out in (extract(files), extract(files, stage)):
        assert {n for _, n in dealt(out["symbols"]) + dealt(out["refs"])} == {str(tasks)}
        assert {r["local_qname"] for r in out["symbols"].collect()} == {q for i in range(30) for q in (f"C{i}", f"C{i}.f_{i}")}
        assert {(r["from_local_qname"], r["target_name"]) for r in out["refs"].where("via = 'call'").collect()} == {
            (f"C{i}.f_{i}", t) for i in range(30) for t in (f"g_{i}", "h")}
    monkeypatch.undo()
    assert E.tasks_for(files) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fitting_words_makes_no_copy_of_the_landmark_table():
    toxicity = pytest.importorskip("quarry.llm.toxicity")
    letters = np.random.default_rng(3).integers(97, 123, (200, 24), dtype=np.uint8)
    words = [row.tobytes() for row in letters]
    tracemalloc.start()
    model = toxicity._fit_words(words[:100], words[100:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.dtype == np.float64 and len(model.weights) == len(model.keys)
    assert peak < 2.5 * len(model.keys) * len(words) * 4

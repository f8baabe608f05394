"""Operators against brute force, with one key holding a third of the rows or more."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from quarry.catalogue import relations
from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.operators import cochange
from quarry.operators.cochange import co_change
from quarry.operators.graph import callers_within
from quarry.operators.ranking import collapse, knn, module_rollup
from quarry.operators.windows import budget_prefix, gap_sessions, latest_open
from quarry.plans.pack import Pack, Part


def test_hot_key_sessions(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(20000)) for _ in range(4000)]
    got = {tuple(r) for r in gap_sessions(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", 15, 2).collect()}
    want = set()
    for key in {k for k, _ in rows}:
        run = []
        for t in [*sorted(t for k, t in rows if k == key), None]:
            if run and (t is None or t - run[-1] > 15):
                if len(run) >= 2:
                    want.add((key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    assert got == want


def test_hot_key_budget(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else "cold", rng.randrange(1, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, cost long")
    got = {(r["k"], r["id"], r["running"]) for r in budget_prefix(df, ["k"], [F.desc("cost"), F.col("id")], "cost", 700, F.col("id")).collect()}
    want = set()
    for key in ("hot", "cold"):
        total = 0
        for i, _, cost in sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0])):
            total += cost
            if total > 700:
                break
            want.add((key, i, total))
    assert got == want


def test_as_of_lookup_crosses_cells(spark):
    spans = spark.createDataFrame([("u", 10, 1), ("u", 95, 2), ("u", 95, 3)], "k string, t long, id long")
    points = spark.createDataFrame([("u", 9, 100), ("u", 10, 101), ("u", 94, 102), ("u", 95, 103), ("u", 400, 104), ("u", 211, 105)], "k string, t long, p long")
    got = {r["p"]: r["owner_id"] for r in latest_open(points, spans, ["k"], "t", "t", "id", 120, 50).collect()}
    assert got == {101: 1, 102: 1, 103: 3, 105: 3}


def test_sweeping_groups_emit_nothing(spark):
    rows = [(f"c{i}", n, 1.0, "2026-01-01") for i in range(4) for n in ("a", "b")] + [("sweep", f"f{i}", 1.0, "2026-01-02") for i in range(40)]
    df = spark.createDataFrame(rows + [("sweep", "a", 1.0, "x"), ("sweep", "b", 1.0, "x")], "g string, item string, weight double, stamp string")
    assert [tuple(r) for r in co_change(df, [], "g", "item").collect()] == [("a", "b", 4, 4.0, "2026-01-01")]


def test_uncapped_groups_count_in_whole_and_no_row_grows_with_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cochange, "BLOCK_ITEMS", 4)
    groups = {"sweep": range(40), "pair": (3, 39), "six": range(6), "one": (1,), None: (1, 2)}
    rows = [(g, n, 0.5, d) for g, items in groups.items() for n in items for d in ("2026-01-01", "2026-01-02" if g == "six" else "2026-01-01")]
    df = spark.createDataFrame(rows + [("pair", None, 0.5, "2026-01-01")], "g string, item long, weight double, stamp string")
    want = Counter(pair for g, items in groups.items() if g for pair in combinations(items, 2))
    got = {(r["src"], r["dst"]): r["count"] for r in co_change(df, [], "g", "item", None, 1).collect()}
    assert got == want and len(got) == 40 * 39 // 2
    lines = [(o, p, p) for o in (1, 2) for p in range(7)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT o_orderkey, TIMESTAMP_NTZ '2001-12-01 00:00:00' AS o_orderdate FROM VALUES (1L), (2L) AS t(o_orderkey)").write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r["src"], r["dst"]) for r in relations.co_change_parts(spark, str(tmp_path)).collect()} == set(combinations(range(7), 2))


def test_closure_takes_fewest_hops_and_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("a", "c"), ("d", "c"), ("z", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in callers_within(edges, start, 2).collect()} == {("b", 1), ("c", 1), ("a", 2), ("d", 2)}
    assert {tuple(r) for r in callers_within(edges, start, 1).collect()} == {("b", 1), ("c", 1)}


def test_collapse_counts_what_it_hides(spark):
    df = spark.createDataFrame([("r.py", n, 1.0 / n) for n in (45, 88, 201, 310)] + [("s.py", 7, 0.5)], "path string, start_line int, score double")
    got = {r["path"]: r["at"] for r in collapse(df, ["path"], "start_line", [F.desc("score")]).select("path", T.card_location(
        F.col("path"), F.col("start_line"), F.lit(0), F.col("extra_lines"), F.col("hidden_count")).alias("at")).collect()}
    assert got == {"r.py": "r.py:45,88,201 (+1)", "s.py": "s.py:7"}


def test_knn_matches_brute_force_in_blocks(spark, monkeypatch):
    import numpy as np

    from quarry.operators import ranking

    monkeypatch.setattr(ranking, "QUERY_BLOCK_BYTES", 8 * 6 * 2)      # two queries per block
    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(200, 6)), rng.normal(size=(5, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(3)
    got = knn(df, "v", [(q, v.tolist()) for q, v in enumerate(asked)], 4, "id").collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(asked) @ unit(vectors).T), axis=1)[:, :4]
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == {(q, k + 1, int(best[q, k])) for q in range(5) for k in range(4)}


def test_paths_and_names(spark):
    paths = ["src/latest_news.py", "a/b.py", ".env", "prod.env", "x/__tests__/y.ts", "vendor/a.go", "k/uv.lock", "keep.log", "x.log", "d/o.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    p = F.col("path")
    rows = {r["path"]: r for r in df.select("path", P.is_test_path(p).alias("t"), P.code_language(p).alias("c"), P.data_language(p).alias("d"),
                                           P.in_ignored_dir(p).alias("i"), P.ignored_by(p, P.IGNORED_GLOBS).alias("g"),
                                           P.ignored_by(p, ["*.log", "!keep.log"]).alias("r"), T.module_of(p).alias("m")).collect()}
    assert rows["src/latest_news.py"]["t"] and not rows["a/b.py"]["t"] and rows["x/__tests__/y.ts"]["t"]
    assert rows[".env"]["d"] is None and rows["prod.env"]["d"] == "ini" and rows["d/o.md"]["c"] is None
    assert rows["vendor/a.go"]["i"] and rows["k/uv.lock"]["g"] and rows["x.log"]["r"] and not rows["keep.log"]["r"]
    assert rows["x/__tests__/y.ts"]["m"] == "x/__tests__" and rows["a/b.py"]["m"] == "a"
    assert {r["module"]: r["n_matches"] for r in module_rollup(df).collect()}["a"] == 1


def test_pack_states_truncation():
    pack = Pack("T", 60, [Part("", [(f"card {i}", 9) for i in range(50)], total=50)])
    assert "showing" in pack.render() and "of 50" in pack.render()
    assert "[showing" not in Pack("T", 100, [Part("A", [("x", 1)], total=1)]).render()
    assert Pack("T", 100, [Part("A", [], "nothing", 0)], notes=["n"]).render() == "T\n\nA\n  nothing\n\n[n]\n"


def test_token_estimate_never_undercounts(spark):
    row = spark.range(1).select(T.estimate_tokens(F.repeat(F.lit("x"), 400)).alias("n")).first()
    assert row["n"] == 115

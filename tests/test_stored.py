"""The stored index over many runs, binding after changes, and stored posting blocks and suffix tables."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.catalogue.stored import REPO, store
from quarry.operators import blocks as B
from quarry.operators import graph as G
from quarry.operators import ranking as K
from quarry.operators import resolve as R
from quarry.sources.warehouse import PER_FILE, SCHEMAS, Warehouse


def folders(warehouse):
    return sorted(folder for table in SCHEMAS for folder, _ in warehouse._folders(table, REPO))


def test_folders_do_not_grow_and_old_rows_go(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    texts = {f"f{i}": f"alpha {i}\nbeta\nalpha again" for i in range(12)}
    many, run = [], 0
    for run in range(6):
        texts[f"f{run}"] = f"gamma {run}\ndelta"
        texts.pop(f"f{11 - run}", None)
        store(warehouse, spark.createDataFrame(list(texts.items()), "path string, text string"), shelves=4)
        many.append(len(folders(warehouse)))
        got = {(r["path"], r["name"], r["start_line"]) for r in warehouse.read("symbols", REPO).collect()}
        want = {(p, line.split(" ")[0], max(i for i, x in enumerate(t.split("\n"), 1) if x.split(" ")[0] == line.split(" ")[0])) for p, t in texts.items() for line in t.split("\n")}
        assert got == want
        assert {(r["src_id"], r["dst_id"]) for r in warehouse.read("edges", REPO).collect()} == {(p, n) for p, n, _ in want}
    assert max(many[1:]) <= 3 * 2 + 2 * 4 and many[-1] <= max(many[:3])
    on_disk = warehouse._raw("symbols").where("path = 'f11'").count()
    assert on_disk == 0
    assert "symbols" in PER_FILE and [x for x in os.listdir(tmp_path / "w/_claims" / REPO) if x[0] != "."] == [str(run + 1)]


def test_only_touched_shelves_are_written(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    texts = {f"f{i}": f"alpha {i}" for i in range(40)}
    store(warehouse, spark.createDataFrame(list(texts.items()), "path string, text string"), shelves=8)
    store(warehouse, spark.createDataFrame(list((texts | {"f3": "beta"}).items()), "path string, text string"))
    second = [v for folder, v in warehouse._folders("symbols", REPO) if v["gen"] == 2]
    assert len(second) == 1
    gens = {r["gen"] for r in warehouse.read("symbols", REPO).select("gen").distinct().collect()}
    assert gens == {1, 2} and warehouse.read("symbols", REPO).count() == 40


def test_a_dead_run_leaves_nothing_visible(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    state = spark.createDataFrame([("a", "one"), ("b", "two")], "path string, text string")
    store(warehouse, state)
    gen = warehouse.next_generation(REPO)
    rows = warehouse.read("symbols", REPO).drop("gen", "repo", "shelf")
    warehouse.append("symbols", rows, REPO, gen, 1)
    warehouse.append("edges", warehouse.read("edges", REPO).drop("gen", "repo"), REPO, gen)
    assert warehouse.read("symbols", REPO).count() == 2 and warehouse.next_generation(REPO) == gen + 1
    store(warehouse, spark.createDataFrame([("a", "one"), ("b", "three")], "path string, text string"))
    assert all(v["gen"] != gen for table in SCHEMAS for _, v in warehouse._folders(table, REPO))


def test_hub_callers_are_dealt(spark):
    """Half of all edges lead to one node, which stands on a cycle."""
    rng = random.Random(1)
    edges = {("hub", "t"), ("t", "s1")} | {(f"s{i}", "hub") for i in range(300)} | {(f"s{rng.randrange(300)}", f"s{rng.randrange(300)}") for _ in range(300)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    nodes = sorted({x for e in edges for x in e})

    def plain(target, depth):
        hops, frontier = {}, {target}
        for step in range(1, depth + 1):
            frontier = {s for s, d in edges if d in frontier} - set(hops)
            hops |= dict.fromkeys(frontier, step)
        return {(target, n, h) for n, h in hops.items()}

    targets = spark.createDataFrame([(n, n) for n in nodes], "target string, node string")
    for depth in (1, 3):
        got = {tuple(r) for r in G.callers_within(df, targets, depth, ["target"], hub=20).collect()}
        assert got == set().union(*(plain(n, depth) for n in nodes))


def test_suffix_table_gives_what_the_lookup_gives(spark):
    rows = [("1", "run", "a.b.run", "a/b.py"), ("2", "run", "c.run", "c.py"), ("3", "C", "a.b.C", "a/b.py"), ("4", "go", "a.b.C.go", "a/b.py"), ("5", "go", "z.C.go", "z.py"), ("6", "odd", None, "n.py")]
    symbols = spark.createDataFrame(rows, "id string, name string, qname string, path string")
    names = ["run", "b.run", "C.go", "go", "a.b", "a.b.C.go", "", "C", ".go", "odd"]
    got = {r["name"]: r["id"] for r in G.find_symbols(G.suffix_table(symbols), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    for name in names:
        hit = G.find_symbol(symbols, name).first()
        assert got[name] == (hit["id"] if hit else None), name


@pytest.mark.parametrize(("terms", "age"), [(["rare", "common"], 1.0), (["rare", "common"], 0.7), (["common"], 1.5), (["absent"], 1.0), (["rare", "absent", "w3"], 1.0)])
def test_blocks_give_the_exact_top_k(spark, terms, age):
    """age: the average length when the blocks were written, against the present one."""
    rng = random.Random(2)
    texts = [(i, " ".join(["common"] * rng.randint(0, 4) + ["rare"] * (rng.random() < 0.02) * rng.randint(1, 5) + [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 30))])) for i in range(2000)]
    docs = spark.createDataFrame(texts, "id long, text string")
    post = K.postings(docs, ["id"], "text").cache()
    n, average = len(texts), sum(len(t.split()) for _, t in texts) / len(texts)
    blocks = B.posting_blocks(post, "id", n, average * age, 16).cache()
    found, counts = B.blocks_topk(blocks, terms, n, average, 10, first=12)
    want = K.bm25_postings(post, ["id"], terms, n, average).orderBy(F.desc("score"), "id").limit(10)
    assert [(r[0], round(r[1], 9)) for r in found.collect()] == [(r[0], round(r[1], 9)) for r in want.collect()]
    if terms == ["rare", "common"] and age == 1:
        assert 0 < counts["read"] < counts["blocks"] / 2, counts


@pytest.mark.parametrize("seed", range(2))
def test_rebinding_equals_binding_anew(spark, seed):
    """Random repositories, random changes: renames, moves, new and deleted files, changed imports."""
    rng = random.Random(seed)
    names, modules = ["run", "get", "pay", "ship", "tax"], ["a.x", "a.y", "b.x", "b.z", "x", "z", "c"]

    def make(path):
        symbols = [("r", path, "py", n, n if rng.random() < 0.7 else f"C.{n}", k) for k, n in enumerate(rng.choices(names, k=rng.randint(0, 3)))]
        imports = [("r", path, rng.choice(modules), rng.sample(names, rng.randint(0, 2)), rng.choice([None, "alias"]), k) for k in range(rng.randint(0, 2))]
        refs = [("r", path, "py", n, "call", "me") for n in rng.sample([*names, "alias", "print"], rng.randint(0, 4))]
        return symbols, imports, refs

    def frames(state):
        flat = [[row for parts in state.values() for row in parts[k]] for k in range(3)]
        return (spark.createDataFrame(flat[0], "repo string, path string, lang string, name string, local_qname string, ord int"),
                spark.createDataFrame(flat[1], "repo string, path string, module string, names array<string>, alias string, ord long"),
                spark.createDataFrame(flat[2], "repo string, path string, lang string, target_name string, via string, from_local_qname string"),
                spark.createDataFrame([("r", p) for p in state], "repo string, path string"))

    old = {f"{d}{f}.py": make(f"{d}{f}.py") for d in ("a/", "b/", "") for f in ("x", "y", "z", "u", "v")}
    new = dict(old)
    for path in rng.sample(sorted(old), 3):
        new[path] = make(path)
    for path in rng.sample(sorted(old), 2):
        new.pop(path)
    new["c/x.py"], new["b/c.py"] = make("c/x.py"), make("b/c.py")
    gone = spark.createDataFrame([("r", p) for p in {*old, *new} if old.get(p) != new.get(p)], "repo string, path string")
    (s0, i0, r0, f0), (s1, i1, r1, f1) = frames(old), frames(new)
    before = R.resolve_names(R.wanted_names(r0), s0, i0, f0)
    mine = lambda df: df.join(gone, ["repo", "path"], "left_semi")
    found = R.rebind(before, gone, mine(r1), mine(s0), mine(s1), s1, i1, f0, f1)
    want = R.resolve_names(R.wanted_names(r1), s1, i1, f1)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)

"""Golden questions as relations: questions, what each expects, what each answer holds and costs, and what a plain search costs.

A question set is small and given by hand. Its answers come from the tools one by one; all the rest is one plan over the
whole set: every expectation is a row that an answer holds or not, and each tree is searched once for all patterns.
"""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.evaluate import grep_costs
from quarry.plans.tools import Explorer
from quarry.sources.tree import scan_tree
from quarry.sources.warehouse import Warehouse

SEARCH_K, SEARCH_BUDGET, READ_FILES = 8, 1500, 4
TOOLS = ("symbol_context", "what_breaks", "what_tests", "file_context")
#: Names of the lists in a question file, and the part each plays.
PARTS = {"must_contain": "wanted", "expect_symbols": "wanted", "expect_files": "wanted", "forbid_symbols": "barred"}


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def expectations(spark: SparkSession, questions: list[dict]) -> DataFrame:
    """id, part (wanted or barred), item."""
    rows = [(q["id"], part, item) for q in questions for name, part in PARTS.items() if ("tool" in q) == (name == "must_contain") for item in q.get(name, [])]
    return spark.createDataFrame(rows, "id string, part string, item string")


def answers(spark: SparkSession, warehouse: Warehouse, questions: list[dict], repo: str, embedder=None, use_graph: bool = True) -> DataFrame:
    """id, place in the set, answer, tokens, and the limits that the question sets."""
    ask = {name: Explorer(spark, warehouse, name, embedder) for name in {q.get("repo", repo) for q in questions}}
    rows = []
    for place, q in enumerate(questions):
        tool, explorer = q.get("tool"), ask[q.get("repo", repo)]
        if tool is not None and tool not in TOOLS:
            raise ValueError(f"question {q['id']} asks for a tool that isn't there: {tool}")
        pack = getattr(explorer, tool)(q["target"]) if tool else explorer.search(q["question"], k=SEARCH_K, expand=use_graph, budget=SEARCH_BUDGET)
        rows.append((q["id"], place, q["question"], pack.render(), pack.tokens(), q.get("max_tokens") if tool else None, 1.0 if tool else float(q.get("min_recall", 1.0))))
    return spark.createDataFrame(rows, "id string, place int, question string, answer string, tokens long, ceiling long, floor double")


def baselines(spark: SparkSession, spec: dict, root: str) -> DataFrame:
    """id, baseline: tokens of searching and reading, for the questions that name a pattern."""
    opened, trees = int(spec.get("baseline", {}).get("read_files", READ_FILES)), {}
    for q in spec["questions"]:
        if q.get("baseline_grep"):
            trees.setdefault(f"{root}/{q['baseline_root']}" if q.get("baseline_root") else root, {})[q["id"]] = q["baseline_grep"]
    out = spark.createDataFrame([], "id string, baseline long")
    for folder, patterns in trees.items():
        files = scan_tree(spark, folder, "").select(F.concat(F.lit(folder + "/"), "path").alias("path"), "text")
        out = out.unionByName(grep_costs(files, patterns, opened).withColumnRenamed("tokens", "baseline"))
    return out


def run(spark: SparkSession, warehouse: Warehouse, spec: dict, repo: str, root: str, embedder=None, use_graph: bool = True) -> DataFrame:
    """A row for each question: id, question, baseline_tokens, tokens, saving, recall, passed, detail."""
    given = answers(spark, warehouse, spec["questions"], repo, embedder, use_graph)
    held = expectations(spark, spec["questions"]).join(given, "id").withColumn("there", F.contains("answer", F.col("item")))
    wanted = F.col("part") == "wanted"
    told = held.groupBy("id").agg(
        F.avg(F.when(wanted, F.col("there").cast("double"))).alias("found"),
        F.array_sort(F.collect_list(F.when(wanted & ~F.col("there"), F.col("item")))).alias("absent"),
        F.array_sort(F.collect_list(F.when(~wanted & F.col("there"), F.col("item")))).alias("leaked"))
    none = F.array().cast("array<string>")
    rows = given.join(told, "id", "left").join(baselines(spark, spec, root), "id", "left").withColumns({
        "recall": F.coalesce("found", F.lit(1.0)), "absent": F.coalesce("absent", none), "leaked": F.coalesce("leaked", none),
        "baseline_tokens": F.coalesce("baseline", F.lit(0))})
    low, dear = F.col("recall") < F.col("floor"), F.coalesce(F.col("tokens") > F.col("ceiling"), F.lit(False))
    why = F.concat_ws("; ", F.when(F.size("leaked") > 0, F.concat(F.lit("should not hold "), F.array_join("leaked", ", "))),
                      F.when(low, F.concat(F.lit("lacks "), F.array_join("absent", ", "))),
                      F.when(dear, F.concat_ws(" ", F.lit("costs"), "tokens", F.lit("of"), "ceiling")))
    return rows.orderBy("place").select(
        "id", "question", "baseline_tokens", "tokens", F.coalesce(F.try_divide("baseline_tokens", "tokens"), F.lit(0.0)).alias("saving"),
        "recall", (~low & ~dear & (F.size("leaked") == 0)).alias("passed"), why.alias("detail"))


def summary(results: DataFrame) -> dict:
    measured = F.col("baseline_tokens") > 0
    return results.agg(F.percentile(F.when(measured, F.col("saving")), 0.5).alias("median_saving"), F.count_if(measured).alias("measured"),
                       F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("questions")).first().asDict()

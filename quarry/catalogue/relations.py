"""Relations and history queries (J*, A1-A10, K*)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalogue.registry import longs, query, table
from quarry.catalogue.search import part_edges
from quarry.operators import cochange as C
from quarry.operators import graph as G
from quarry.operators import resolve as R
from quarry.operators.diff import changed_files
from quarry.operators.testlink import strongest
from quarry.session import staged

AS_OF = "2002-01-01"
TASK_LINES = 500_000  # order lines of a task, about


def _co_change_sql(item: str, cap: int | None, support: int) -> str:
    return f"""b AS (SELECT DISTINCT l_orderkey AS k, {item} AS s FROM lineitem),
ok AS (SELECT k FROM b GROUP BY 1 HAVING count(*) {'>= 2' if cap is None else f'BETWEEN 2 AND {cap}'}),
pr AS (SELECT x.s AS src, y.s AS dst, exp(-greatest((DATE '{AS_OF}' - o_orderdate::DATE)::DOUBLE, 0) / 180.0::DOUBLE) AS w,
              strftime(o_orderdate, '%Y-%m-%d') AS d
       FROM b x JOIN b y ON x.k = y.k AND x.s < y.s JOIN ok ON ok.k = x.k JOIN orders ON o_orderkey = x.k),
co AS (SELECT src, dst, count(*) AS count, round(sum(w), 4) AS weight, max(d) AS last_seen FROM pr GROUP BY 1, 2 HAVING count(*) >= {support})"""


def _co_change(spark: SparkSession, folder: str, item: str, cap: int | None, support: int) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    dated = orders.select("l_orderkey", C.decay(age, F.col("o_orderdate").isNotNull()).alias("weight"),
                          F.col("o_orderdate").cast("date").alias("stamp"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", item)
    # A task gets a bounded number of lines, however many there are, and what follows up to the pairs stays where the orders are.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / TASK_LINES))
    each = lines.repartition(tasks, "l_orderkey").join(dated.repartition(tasks, "l_orderkey"), "l_orderkey")
    pairs = C.co_change(each, [], "l_orderkey", item, cap, support)
    return pairs.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


@query(f"WITH {_co_change_sql('l_suppkey', 25, 3)} SELECT src, dst, count, weight, last_seen FROM co")
def co_change_suppliers(spark, folder):
    """Suppliers that keep appearing in the same order."""
    return _co_change(spark, folder, "l_suppkey", 25, 3)


@query(f"WITH {_co_change_sql('l_partkey', None, 2)} SELECT src, dst, count, weight, last_seen FROM co")
def co_change_parts(spark, folder):
    """Parts of every order, however many it has."""
    return _co_change(spark, folder, "l_partkey", None, 2)


@query(f"""WITH {_co_change_sql('l_suppkey', 25, 3)},
bo AS (SELECT src AS node, dst AS other, weight FROM co UNION ALL SELECT dst, src, weight FROM co),
rk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS rank FROM bo)
SELECT node, other, weight, rank FROM rk WHERE rank <= 5""")
def undirected_neighbours(spark, folder):
    """Pairs stored once, read both ways; strongest five partners per node."""
    pairs = _co_change(spark, folder, "l_suppkey", 25, 3)
    both = G.both_ways(pairs, "src", "dst", "weight")
    return longs(G.top_neighbours(both, [F.desc("weight"), F.col("other")], 5), "rank")


EDGES_SQL = """ed AS (SELECT DISTINCT x.l_partkey AS src, y.l_partkey AS dst FROM lineitem x JOIN lineitem y
 ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber WHERE x.l_partkey <> y.l_partkey)"""


def _closure_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL},
r(node, hops) AS (SELECT src, 1 FROM ed WHERE dst = 1 UNION SELECT ed.src, hops + 1 FROM r JOIN ed ON ed.dst = r.node WHERE hops < {depth})
SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY 1"""


@query(_closure_sql(2))
def callers_two_hops(spark, folder):
    """Callers within two hops."""
    target = table(spark, folder, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("node"))
    return longs(G.callers_within(staged(spark, part_edges(spark, folder)), target, 2, stage=lambda df: staged(spark, df)), "hops")


@query(_closure_sql(4))
def callers_four_hops(spark, folder):
    """Bounded transitive closure at its deepest, target on cycles included."""
    target = table(spark, folder, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("node"))
    return longs(G.callers_within(staged(spark, part_edges(spark, folder)), target, 4, stage=lambda df: staged(spark, df)), "hops")


@query(f"""WITH {EDGES_SQL}, one AS (SELECT dst AS target, src AS node, 1 AS hops FROM ed),
two AS (SELECT target, node, hops FROM one UNION ALL SELECT one.target, ed.src, 2 FROM one JOIN ed ON ed.dst = one.node)
SELECT target, node, min(hops)::BIGINT AS hops FROM two GROUP BY 1, 2""")
def callers_of_every_part(spark, folder):
    """What a change of each thing would touch, for all of them in one run."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("target"), F.col("p_partkey").alias("node"))
    return longs(G.callers_within(staged(spark, part_edges(spark, folder)), parts, 2, ["target"], stage=lambda df: staged(spark, df)), "hops")


RESOLVE_SQL = """sy AS (SELECT p_partkey AS k, concat(p_brand, '/f', p_size) AS path, p_brand AS folder, p_type AS lang, p_name AS name FROM part),
rf AS (SELECT s.path, s.lang, d.name FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber
       JOIN sy s ON s.k = x.l_partkey JOIN sy d ON d.k = y.l_partkey),
wa AS (SELECT DISTINCT path, lang, name FROM rf),
pf AS (SELECT lang, name, path, any_value(folder) AS folder, count(*) AS n FROM sy GROUP BY 1, 2, 3),
pd AS (SELECT lang, name, folder, sum(n) AS n, min(path) AS p FROM pf GROUP BY 1, 2, 3),
pa AS (SELECT lang, name, sum(n) AS n, min(path) AS p FROM pf GROUP BY 1, 2),
im AS (SELECT concat(p_brand, '/f', p_size) AS path, p_name AS name, arg_max(concat(p_brand, '.f', p_size % 50 + 1), p_partkey) AS module FROM part GROUP BY 1, 2),
mk AS (SELECT DISTINCT path, replace(path, '/', '.') AS f, string_split(path, '/')[2] AS stem FROM sy),
ms AS (SELECT stem, max(path) AS p FROM mk GROUP BY 1),
ta AS (SELECT im.path, im.name, coalesce(mk.path, ms.p) AS tp FROM im LEFT JOIN mk ON mk.f = im.module
       LEFT JOIN ms ON ms.stem = string_split(im.module, '.')[2]),
an AS (SELECT wa.path, wa.lang, wa.name, pa.n IS NOT NULL AS known,
  CASE WHEN h.n >= 1 THEN wa.path WHEN t.n = 1 THEN t.path WHEN pd.n = 1 THEN pd.p WHEN pa.n = 1 THEN pa.p END AS dst_path
  FROM wa LEFT JOIN pa ON pa.lang = wa.lang AND pa.name = wa.name
  LEFT JOIN pf h ON h.lang = wa.lang AND h.name = wa.name AND h.path = wa.path
  LEFT JOIN ta ON ta.path = wa.path AND ta.name = wa.name
  LEFT JOIN pf t ON t.lang = wa.lang AND t.name = wa.name AND t.path = ta.tp
  LEFT JOIN pd ON pd.lang = wa.lang AND pd.name = wa.name AND pd.folder = string_split(wa.path, '/')[1])"""


def part_symbols(spark: SparkSession, folder: str, part: DataFrame | None = None):
    part = table(spark, folder, "part") if part is None else part
    named = part.select(
        F.lit("r").alias("repo"), F.col("p_partkey").alias("ord"), F.concat("p_brand", F.lit("/f"), "p_size").alias("path"),
        F.col("p_type").alias("lang"), F.col("p_name").alias("name"), F.col("p_name").alias("local_qname"))
    imports = part.select(
        F.lit("r").alias("repo"), F.concat("p_brand", F.lit("/f"), "p_size").alias("path"), F.array("p_name").alias("names"),
        F.lit(None).cast("string").alias("alias"), F.col("p_partkey").alias("ord"),
        F.concat(F.lit("."), "p_brand", F.lit(".f"), F.col("p_size") % 50 + 1).alias("module"))
    lines = table(spark, folder, "lineitem")
    left = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("a"))
    right = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("b"))
    source = named.select(F.col("ord").alias("a"), "repo", "path", "lang")
    target = named.select(F.col("ord").alias("b"), F.col("name").alias("target_name"))
    refs = left.join(right, ["l_orderkey", "l_linenumber"]).join(source, "a").join(target, "b").select(
        "repo", "path", "lang", "target_name", F.lit("call").alias("via"), F.col("a").cast("string").alias("from_local_qname"))
    return named, imports, refs, named.select("repo", "path").distinct()


@query(f"WITH {RESOLVE_SQL} SELECT path, lang, name, dst_path, known FROM an")
def resolve_priority(spark, folder):
    """Name binding by file, import, folder and uniqueness."""
    symbols, imports, refs, files = part_symbols(spark, folder)
    wanted = refs.select("repo", "path", "lang", F.col("target_name").alias("name")).distinct()
    return R.resolve_names(wanted, symbols, imports, files).select("path", "lang", "name", "dst_path", "known")


@query(f"""WITH {RESOLVE_SQL},
b AS (SELECT an.dst_path, an.known FROM rf JOIN an ON an.path = rf.path AND an.lang = rf.lang AND an.name = rf.name)
SELECT count(*) AS total, count(dst_path) AS resolved, count(*) FILTER (dst_path IS NULL AND known) AS unresolved,
 count(*) FILTER (dst_path IS NULL AND NOT known) AS external,
 round(CASE WHEN count(*) FILTER (dst_path IS NOT NULL OR known) = 0 THEN 0 ELSE count(*) FILTER (dst_path IS NULL AND known)::DOUBLE / count(*) FILTER (dst_path IS NOT NULL OR known) END, 6) AS unresolved_ratio FROM b""")
def resolution_stats(spark, folder):
    """A5: how many references were bound."""
    symbols, imports, refs, files = part_symbols(spark, folder)
    stats = R.resolution_stats(R.bind(refs, symbols, imports, files))
    return stats.drop("repo").withColumn("unresolved_ratio", F.round("unresolved_ratio", 6))


@query(f"""WITH {RESOLVE_SQL}
SELECT DISTINCT path AS src_path, dst_path FROM an WHERE dst_path IS NOT NULL AND dst_path <> path""")
def imports_derived(spark, folder):
    """File dependencies derived from bound references."""
    symbols, imports, refs, files = part_symbols(spark, folder)
    return R.file_imports(R.edges(R.bind(refs, symbols, imports, files))).select("src_path", "dst_path")


@query("""SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, concat(p_brand, '.', p_name) AS q FROM part)
WHERE q = 'ring' OR ends_with(q, '.hot ring') OR p_name = 'hot ring' ORDER BY length(q), q, p_partkey LIMIT 1""")
def symbol_lookup_suffix(spark, folder):
    """Exact or suffix match, shortest qualified name first."""
    symbols = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qname"),
        F.lit("").alias("path"))
    return G.find_symbol(symbols, "hot ring").select(F.col("id").alias("p_partkey"), F.col("name").alias("p_name"))


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS name, concat(p_brand, '.', replace(p_name, ' ', '.')) AS qname FROM part),
q AS (SELECT DISTINCT unnest([p_name, string_split(p_name, ' ')[-1], concat(p_brand, '.', replace(p_name, ' ', '.')), p_type]) AS name FROM part),
k AS (SELECT unnest(list_append(list_transform(range(1, len(string_split(qname, '.')) + 1), lambda i: array_to_string(string_split(qname, '.')[i:], '.')), name)) AS key, id, qname FROM s),
b AS (SELECT key, arg_min(id, (length(qname), qname, id::VARCHAR)) AS id FROM k GROUP BY 1)
SELECT q.name, b.id FROM q LEFT JOIN b ON b.key = q.name""")
def symbol_lookup_batch(spark, folder):
    """A table of names looked up at once, among them last words, qualified names and names that nothing has."""
    part = table(spark, folder, "part")
    qname = F.concat_ws(".", "p_brand", F.replace("p_name", F.lit(" "), F.lit(".")))
    symbols = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), qname.alias("qname"), F.lit("").alias("path"))
    names = part.select(F.explode(F.array("p_name", F.element_at(F.split("p_name", " "), -1), qname, "p_type")).alias("name"))
    return longs(G.find_symbols(G.suffix_table(symbols), names), "id")


@query("""SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name))[1:12], ',') AS siblings FROM part GROUP BY 1""")
def siblings_slice(spark, folder):
    """Distinct member names of each container, first twelve."""
    # A name is folded with its container before anything is gathered, so repeats never pile up in one task.
    members = table(spark, folder, "part").select("p_brand", "p_name").distinct()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name"))
    first = members.withColumn("rank", rank).where(F.col("rank") <= 12)
    return first.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_name")), ",").alias("siblings"))


@query("""SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ', ') AS vias FROM lineitem GROUP BY 1""")
def uses_collect_vias(spark, folder):
    """How a thing is used, distinct and sorted."""
    lines = table(spark, folder, "lineitem")
    return G.uses_of(lines, ["l_partkey"], "l_returnflag").select("l_partkey", F.array_join("vias", ", ").alias("vias"))


@query("""WITH g AS (SELECT o_custkey, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS r FROM orders)
SELECT o_custkey, o_orderstatus, CASE min(r) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM g GROUP BY 1, 2""")
def evidence_max(spark, folder):
    """A4: strongest evidence per pair."""
    grade = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low")
    return strongest(table(spark, folder, "orders").withColumn("confidence", grade), ["o_custkey", "o_orderstatus"])


@query("SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def edge_histogram(spark, folder):
    """Relations by type."""
    return G.edge_histogram(table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "kind"), "kind")


@query("""SELECT (SELECT count(*) FROM region) AS n_region, (SELECT count(*) FROM nation) AS n_nation, (SELECT count(*) FROM customer) AS n_customer""")
def independent_counts(spark, folder):
    """Counts side by side as scalar subqueries, never a chain of outer joins."""
    count = lambda name: table(spark, folder, name).agg(F.count(F.lit(1)))
    return count("region").select(
        F.col("count(1)").alias("n_region"), count("nation").scalar().alias("n_nation"), count("customer").scalar().alias("n_customer"))


@query("""WITH b AS (SELECT concat('doc/', doc_id) AS path, sha256(CASE WHEN quality = 1 THEN text ELSE concat(text, '!') END) AS old
            FROM labels JOIN documents USING (doc_id)
           UNION ALL SELECT concat('bench/', item_id), sha256(text) FROM benchmark),
f AS (SELECT concat('doc/', doc_id) AS path, sha256(text) AS sha FROM documents)
SELECT coalesce(f.path, b.path) AS path, CASE WHEN sha IS NULL THEN 'stale' WHEN sha = old THEN 'unchanged' ELSE 'changed' END AS status
FROM f FULL JOIN b ON f.path = b.path""")
def changed_files_diff(spark, folder):
    """Changed, unchanged and stale files by content hash."""
    documents = table(spark, folder, "documents")
    found = documents.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.sha2("text", 256).alias("sha256"))
    seen = table(spark, folder, "labels").select("doc_id", "quality").join(documents, "doc_id").select(
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"),
        F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("old_sha256"))
    gone = table(spark, folder, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id")).alias("path"),
                                                    F.sha2("text", 256).alias("old_sha256"))
    return changed_files(found, seen.unionByName(gone)).select("path", "status")

"""The code path end to end (X*, C*, J2-J22, A*), over source files that Spark writes from `documents`.

Every document becomes one file, and every ASCII word of its text stands in it. Each line with such words becomes a
function: its first words name it and the two functions that it calls (a line of one or two repeats its last), all others
stand behind as calls in its docstring or comment, where extraction must not take them for calls. The language follows
the document number, the class is named after it, and every seventh file is a test. Names are words of the text, so they
repeat across files just as real ones do. Because the text follows from the tables, SQL can state what extraction,
binding and linking have to find.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalogue.registry import longs, query, table
from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import resolve as R
from quarry.operators.testlink import test_links
from quarry.plans.chunk import chunks
from quarry.plans.extract import extract, imports_of, parsed_of
from quarry.plans.index import unique_symbols, with_identity
from quarry.session import staged

LANGUAGES = ("python", "typescript", "java", "javascript", "go", "rust")
EXTENSIONS = (".py", ".ts", ".java", ".js", ".go", ".rs")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """repo, path, lang, text, is_test: one generated source file per document."""
    doc = F.col("doc_id")
    words = F.transform(F.split("text", "\n"), lambda line: F.regexp_extract_all(F.lower(line), F.lit("[a-z]+"), F.lit(0)))
    base = table(spark, folder, "documents").select(
        "doc_id", F.filter(words, lambda w: F.size(w) > 0).alias("fns"), (doc % 6).alias("l"))
    name = lambda w, i: F.concat(F.lit("f_"), F.element_at(w, F.least(F.lit(i), F.size(w))))
    rest = lambda w: F.when(F.size(w) > 3, F.concat(F.array_join(F.slice(w, 4, F.size(w)), "() "), F.lit("()"))).otherwise("")
    cls = F.concat(F.lit("D"), doc.cast("string"))

    def functions(template: str) -> Column:
        """`template` with A, B, C for the function and its two callees, R for the words behind and T for the class."""
        def one(w: Column) -> Column:
            values = {"A": name(w, 1), "B": name(w, 2), "C": name(w, 3), "R": rest(w), "T": cls}
            return F.concat(*(values[part] if i % 2 else F.lit(part) for i, part in enumerate(re.split("<([ABCRT])>", template))))

        return F.array_join(F.transform("fns", one), "")

    imported = F.when(F.size("fns") > 0, F.concat(
        F.lit("from pkg"), F.floor((doc + 6) / 10).cast("string"), F.lit(".m"), (doc + 6).cast("string"), F.lit(" import "),
        name(F.get("fns", F.lit(0)), 3), F.lit("\n"))).otherwise("\n")
    text = (
        F.when(F.col("l") == 0, F.concat(imported, F.lit("class "), cls, F.lit(":\n"), functions(
            "    def <A>(self, x: <T>) -> <T>:\n        \"\"\"<R>\"\"\"\n        return <B>(<C>(x))\n")))
        .when(F.col("l") == 1, F.concat(F.lit("export class "), cls, F.lit(" {\n"), functions(
            "  <A>(x: <T>): <T> {\n    // <R>\n    return <B>(<C>(x));\n  }\n"), F.lit("}\n")))
        .when(F.col("l") == 2, F.concat(F.lit("public class "), cls, F.lit(" {\n"), functions(
            "  public <T> <A>(<T> x) {\n    // <R>\n    return <B>(<C>(x));\n  }\n"), F.lit("}\n")))
        .when(F.col("l") == 3, F.concat(F.lit("class "), cls, F.lit(" {\n"), functions(
            "  <A>(x) {\n    // <R>\n    return <B>(<C>(x));\n  }\n"), F.lit("}\n")))
        .when(F.col("l") == 4, F.concat(F.lit("type "), cls, F.lit(" struct {\n\tv int\n}\n"), functions(
            "func <A>(x *<T>) <T> {\n\t// <R>\n\treturn <B>(<C>(x))\n}\n")))
        .otherwise(F.concat(F.lit("pub struct "), cls, F.lit(" {\n    v: i32,\n}\n"), functions(
            "pub fn <A>(x: &<T>) -> <T> {\n    // <R>\n    <B>(<C>(x))\n}\n")))
    )
    path = F.concat(F.when(doc % 7 == 3, "tests/").otherwise(""), F.lit("pkg"), F.floor(doc / 10).cast("string"), F.lit("/m"),
                    doc.cast("string"), _pick(EXTENSIONS, F.col("l")))
    return base.select(F.lit("r").alias("repo"), path.alias("path"), _pick(LANGUAGES, F.col("l")).alias("lang"), text.alias("text")).withColumn(
        "is_test", P.is_test_path(F.col("path")))


# The same files, as SQL relations.
CORPUS_SQL = """
dc AS (SELECT doc_id, doc_id % 6 AS l, concat('D', doc_id) AS cls, ['python', 'typescript', 'java', 'javascript', 'go', 'rust'][doc_id % 6 + 1] AS lang,
  concat(CASE WHEN doc_id % 7 = 3 THEN 'tests/' ELSE '' END, 'pkg', doc_id // 10, '/m', doc_id, ['.py', '.ts', '.java', '.js', '.go', '.rs'][doc_id % 6 + 1]) AS path,
  list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_extract_all(lower(s), '[a-z]+')), lambda w: len(w) > 0) AS fns FROM documents),
fn AS (SELECT doc_id, l, cls, lang, path, len(fns) AS n, unnest(fns) AS w, generate_subscripts(fns, 1) - 1 AS k FROM dc),
ff AS (SELECT *, concat('f_', w[1]) AS a, concat('f_', w[least(2, len(w))]) AS b, concat('f_', w[least(3, len(w))]) AS c, l < 4 AS is_method,
  coalesce(array_to_string(list_transform(w[4:], lambda v: concat(v, '()')), ' '), '') AS rest,
  CASE WHEN l = 0 THEN 3 + 3 * k WHEN l < 4 THEN 2 + 4 * k ELSE 4 + 4 * k END AS s FROM fn),
sy AS (SELECT path, lang, doc_id, a AS name, CASE WHEN is_method THEN 'method' ELSE 'function' END AS kind, CASE WHEN is_method THEN cls END AS parent,
   CASE WHEN is_method THEN concat(cls, '.', a) ELSE a END AS local_qname, s AS start_line, s + CASE WHEN l = 0 THEN 2 ELSE 3 END AS end_line, k + 1 AS ord FROM ff
  UNION ALL SELECT path, lang, doc_id, cls, CASE WHEN l < 4 THEN 'class' ELSE 'struct' END, NULL, cls, CASE WHEN l = 0 THEN 2 ELSE 1 END,
   CASE WHEN l = 0 THEN 2 + 3 * len(fns) WHEN l < 4 THEN 2 + 4 * len(fns) ELSE 3 END, 0 FROM dc WHERE l > 0 OR len(fns) > 0),
us AS (SELECT path, lang, CASE WHEN is_method THEN concat(cls, '.', a) ELSE a END AS owner, a, unnest(
    CASE WHEN l = 3 THEN [{'t': b, 'via': 'call'}, {'t': c, 'via': 'call'}]
         ELSE [{'t': b, 'via': 'call'}, {'t': c, 'via': 'call'}, {'t': cls, 'via': 'param'}, {'t': cls, 'via': 'return'}] END) AS u FROM ff),
rf AS (SELECT path, lang, owner, u.t AS target, u.via AS via FROM us WHERE u.t <> a)"""
IMPORT_SQL = """
im AS (SELECT path, concat('f_', fns[1][least(3, len(fns[1]))]) AS name, concat('pkg', (doc_id + 6) // 10, '.m', doc_id + 6) AS module, concat('pkg', (doc_id + 6) // 10, '/m', doc_id + 6, '.py') AS f1,
  concat('tests/pkg', (doc_id + 6) // 10, '/m', doc_id + 6, '.py') AS f2 FROM dc WHERE l = 0 AND len(fns) > 0)"""
BOUND_SQL = CORPUS_SQL + "," + IMPORT_SQL + """,
pf AS (SELECT lang, name, path, regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n, arg_min(local_qname, ord) AS q FROM sy GROUP BY 1, 2, 3, 4),
pd AS (SELECT lang, name, folder, sum(n) AS n, min({'p': path, 'q': q}) AS h FROM pf GROUP BY 1, 2, 3),
pa AS (SELECT lang, name, sum(n) AS n, min({'p': path, 'q': q}) AS h FROM pf GROUP BY 1, 2),
ta AS (SELECT im.path, im.name, d.path AS tp FROM im JOIN dc d ON d.path = im.f1 OR d.path = im.f2),
wa AS (SELECT DISTINCT path, lang, target AS name FROM rf),
an AS (SELECT wa.path, wa.lang, wa.name, pa.n IS NOT NULL AS known,
  CASE WHEN h.n >= 1 THEN {'p': wa.path, 'q': h.q} WHEN t.n = 1 THEN {'p': t.path, 'q': t.q} WHEN pd.n = 1 THEN pd.h WHEN pa.n = 1 THEN pa.h END AS d
  FROM wa LEFT JOIN pa ON pa.lang = wa.lang AND pa.name = wa.name
  LEFT JOIN pf h ON h.lang = wa.lang AND h.name = wa.name AND h.path = wa.path
  LEFT JOIN ta ON ta.path = wa.path AND ta.name = wa.name
  LEFT JOIN pf t ON t.lang = wa.lang AND t.name = wa.name AND t.path = ta.tp
  LEFT JOIN pd ON pd.lang = wa.lang AND pd.name = wa.name AND pd.folder = regexp_replace(wa.path, '/[^/]*$', '')),
bo AS (SELECT rf.*, an.d.p AS dp, an.d.q AS dq, an.known FROM rf JOIN an ON an.path = rf.path AND an.name = rf.target),
eg AS (SELECT DISTINCT concat('r:', path, ':', owner) AS src_id, concat('r:', dp, ':', dq) AS dst_id,
  CASE via WHEN 'call' THEN 'CALLS' ELSE 'REFERENCES' END AS kind, CASE WHEN via <> 'call' THEN via END AS via, path AS src_path, dp AS dst_path FROM bo WHERE dp IS NOT NULL)"""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, corpus(spark, folder))  # read by each part of the extraction


def _parsed(spark: SparkSession, folder: str):
    files = _files(spark, folder)
    return files, extract(files, stage=lambda df: staged(spark, df))


def _bound(spark: SparkSession, folder: str):
    files, out = _parsed(spark, folder)
    bound = R.bind(out["refs"], out["symbols"], out["imports"], files.select("repo", "path", "is_test"))
    return files, out, staged(spark, bound)


@query(f"WITH {CORPUS_SQL} SELECT path, local_qname, kind, parent, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM sy")
def code_symbols(spark, folder):
    """Definitions with spans and parents, all languages."""
    found = extract(_files(spark, folder))["symbols"]
    return longs(found.select("path", "local_qname", "kind", "parent", "start_line", "end_line"), "start_line", "end_line")


@query(f"""WITH {CORPUS_SQL},
sg AS (SELECT path, k + 1 AS ord, CASE l WHEN 0 THEN concat('def ', a, '(self, x: ', cls, ') -> ', cls, ':') WHEN 1 THEN concat(a, '(x: ', cls, '): ', cls)
  WHEN 2 THEN concat('public ', cls, ' ', a, '(', cls, ' x)') WHEN 3 THEN concat(a, '(x)') WHEN 4 THEN concat('func ', a, '(x *', cls, ') ', cls)
  ELSE concat('pub fn ', a, '(x: &', cls, ') -> ', cls) END AS signature FROM ff)
SELECT path, ord::BIGINT AS ord, signature FROM sg""")
def code_signatures(spark, folder):
    """Headers of functions, on one line."""
    found = extract(_files(spark, folder))["symbols"]
    return longs(found.where(F.col("kind").isin("function", "method")).select("path", "ord", "signature"), "ord")


@query(f"""WITH {CORPUS_SQL} SELECT path, k + 1 AS ord, CASE WHEN l = 0 THEN left(rest, 400) ELSE '' END AS docstring FROM ff""")
def code_docstrings(spark, folder):
    """Docstrings of functions, up to their stored width; only Python has them."""
    found = extract(_files(spark, folder))["symbols"]
    return longs(found.where(F.col("kind").isin("function", "method")).select("path", "ord", "docstring"), "ord")


@query(f"WITH {CORPUS_SQL} SELECT path, owner AS from_local_qname, target AS target_name, via FROM rf")
def code_references(spark, folder):
    """References with their owner and kind."""
    return extract(_files(spark, folder))["refs"].select("path", "from_local_qname", "target_name", "via")


@query(f"WITH {CORPUS_SQL}, {IMPORT_SQL} SELECT path, module, name AS names FROM im")
def code_imports(spark, folder):
    """Import statements."""
    return imports_of(corpus(spark, folder)).select("path", "module", F.array_join("names", ",").alias("names"))


@query(f"""WITH {CORPUS_SQL} SELECT path, (CASE WHEN l = 0 THEN 3 + 3 * len(fns) WHEN l < 4 THEN 3 + 4 * len(fns) ELSE 4 + 4 * len(fns) END)::BIGINT AS loc,
 lang = 'javascript' AS types_unavailable FROM dc""")
def code_files(spark, folder):
    """Line counts and whether types exist to extract."""
    return longs(parsed_of(corpus(spark, folder)).select("path", "loc", "types_unavailable"), "loc")


@query(f"""WITH {CORPUS_SQL},
cb AS (SELECT path, l, a, k, s, cls, lang, rest, CASE l WHEN 0 THEN concat('def ', a, '(self, x: ', cls, ') -> ', cls, ':', chr(10), '        \"\"\"', rest, '\"\"\"', chr(10), '        return ', b, '(', c, '(x))')
  WHEN 1 THEN concat(a, '(x: ', cls, '): ', cls, ' {{', chr(10), '    // ', rest, chr(10), '    return ', b, '(', c, '(x));', chr(10), '  }}')
  WHEN 2 THEN concat('public ', cls, ' ', a, '(', cls, ' x) {{', chr(10), '    // ', rest, chr(10), '    return ', b, '(', c, '(x));', chr(10), '  }}')
  WHEN 3 THEN concat(a, '(x) {{', chr(10), '    // ', rest, chr(10), '    return ', b, '(', c, '(x));', chr(10), '  }}')
  WHEN 4 THEN concat('func ', a, '(x *', cls, ') ', cls, ' {{', chr(10), chr(9), '// ', rest, chr(10), chr(9), 'return ', b, '(', c, '(x))', chr(10), '}}')
  ELSE concat('pub fn ', a, '(x: &', cls, ') -> ', cls, ' {{', chr(10), '    // ', rest, chr(10), '    ', b, '(', c, '(x))', chr(10), '}}') END AS body FROM ff),
sg AS (SELECT *, CASE WHEN l = 0 THEN string_split(body, chr(10))[1] ELSE trim(string_split(body, '{{')[1]) END AS sig FROM cb),
ch AS (SELECT concat('r:', path, ':', k) AS id, CASE WHEN l < 4 THEN 'method' ELSE 'function' END AS kind,
   concat(regexp_replace(replace(path, '/', '.'), '\\.[^.]*$', ''), '.', CASE WHEN l < 4 THEN concat(cls, '.') ELSE '' END, a) AS symbol_qname,
   s AS start_line, s + CASE WHEN l = 0 THEN 2 ELSE 3 END AS end_line,
   concat('# file: ', path, CASE WHEN l < 4 THEN concat(chr(10), '# class: ', cls) ELSE '' END, chr(10), '# ', sig,
     CASE WHEN l = 0 AND rest <> '' THEN concat(chr(10), '# doc: ', left(rest, 160)) ELSE '' END, chr(10), body) AS text FROM sg
  UNION ALL SELECT concat('r:', path, ':', len(fns)), 'module', NULL, 1, 3, concat('# file: ', path, chr(10),
   CASE WHEN l = 4 THEN concat('type ', cls, ' struct {{', chr(10), chr(9), 'v int') ELSE concat('pub struct ', cls, ' {{', chr(10), '    v: i32,') END, chr(10), '}}') FROM dc WHERE l >= 4)
SELECT id, kind, symbol_qname, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, md5(text) AS digest FROM ch""")
def code_chunks(spark, folder):
    """Chunks of every file with their ids and texts."""
    files, out = _parsed(spark, folder)
    made = chunks(files, files.where(F.lit(False)), out["symbols"], out["parsed"])
    return longs(made.select("id", "kind", "symbol_qname", "start_line", "end_line", F.md5("text").alias("digest")), "start_line", "end_line")


@query(f"WITH {BOUND_SQL} SELECT src_id, dst_id, kind, via FROM eg")
def code_edges(spark, folder):
    """Distinct bound relations."""
    _, _, bound = _bound(spark, folder)
    return R.edges(bound).select("src_id", "dst_id", "kind", "via")


@query(f"""WITH {BOUND_SQL} SELECT count(*) AS total, count(dp) AS resolved, count(*) FILTER (dp IS NULL AND known) AS unresolved,
 count(*) FILTER (dp IS NULL AND NOT known) AS external FROM bo""")
def code_resolution(spark, folder):
    """A5: binding statistics of the whole corpus."""
    _, _, bound = _bound(spark, folder)
    return R.resolution_stats(bound).select("total", "resolved", "unresolved", "external")


@query(f"WITH {BOUND_SQL} SELECT DISTINCT src_path, dst_path FROM eg WHERE src_path <> dst_path")
def code_file_imports(spark, folder):
    """File-level dependencies, J23."""
    _, _, bound = _bound(spark, folder)
    return R.file_imports(R.edges(bound)).select("src_path", "dst_path")


@query(f"""WITH {CORPUS_SQL}, ids AS (SELECT DISTINCT path, name, parent, local_qname FROM sy)
SELECT concat('r:', path, ':', parent) AS src_id, concat('r:', path, ':', local_qname) AS dst_id FROM ids WHERE parent IS NOT NULL""")
def code_members(spark, folder):
    """Class to member."""
    files, out = _parsed(spark, folder)
    return R.contains_edges(with_identity(out["symbols"], files)).select("src_id", "dst_id")


@query(f"""WITH {CORPUS_SQL},
la AS (SELECT *, row_number() OVER (PARTITION BY path, local_qname ORDER BY ord DESC) AS rn FROM sy)
SELECT concat('r:', path, ':', local_qname) AS id, concat(regexp_replace(replace(path, '/', '.'), '\\.[^.]*$', ''), '.', local_qname) AS qname,
 start_line::BIGINT AS start_line FROM la WHERE rn = 1""")
def code_unique_symbols(spark, folder):
    """One row per id, the last definition wins."""
    files, out = _parsed(spark, folder)
    return longs(unique_symbols(with_identity(out["symbols"], files)).select("id", "qname", "start_line"), "start_line")


@query(f"""WITH {BOUND_SQL},
ts AS (SELECT path FROM dc WHERE path LIKE 'tests/%'),
ev AS (SELECT concat('r:', dp, ':', dq) AS target_id, concat('r:', bo.path, ':', owner) AS test_id, CASE WHEN im.name IS NOT NULL THEN 0 ELSE 1 END AS g
       FROM bo LEFT JOIN im ON im.path = bo.path AND im.name = bo.target WHERE via = 'call' AND dp IS NOT NULL AND bo.path IN (FROM ts) AND dp NOT IN (FROM ts))
SELECT target_id, test_id, CASE min(g) WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM ev GROUP BY 1, 2""")
def code_test_links(spark, folder):
    """Which tests exercise what, by strongest evidence."""
    files, out, bound = _bound(spark, folder)
    linked = test_links(bound, out["symbols"], out["imports"], files.select("repo", "path", "is_test"))
    return linked.select("target_id", "test_id", "confidence")


@query(f"""WITH RECURSIVE {BOUND_SQL},
ca AS (SELECT DISTINCT src_id AS src, dst_id AS dst FROM eg WHERE kind = 'CALLS'),
tg AS (SELECT dst AS node FROM ca GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
r(node, hops) AS (SELECT src, 1 FROM ca JOIN tg ON tg.node = dst UNION SELECT ca.src, hops + 1 FROM r JOIN ca ON ca.dst = r.node WHERE hops < 3)
SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY 1""")
def code_callers(spark, folder):
    """Everything that reaches the most called function within three hops."""
    _, _, bound = _bound(spark, folder)
    calls = staged(spark, R.edges(bound).where("kind = 'CALLS'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct())
    target = calls.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")
    return longs(G.callers_within(calls, target, 3, stage=lambda df: staged(spark, df)), "hops")


@query()
def code_embeddings(spark, folder):
    """Hashed-feature vectors of every chunk (rows only: the hash is not SQL)."""
    from quarry.functions.vectors import HashedFeatures

    files, out = _parsed(spark, folder)
    made = chunks(files, files.where(F.lit(False)), out["symbols"], out["parsed"])
    vectors = HashedFeatures().embed(made.select("id", "text"))
    return vectors.select("id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))

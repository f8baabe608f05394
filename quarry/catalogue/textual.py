"""Lines, windows, classification and names (S*, P*, C*, E3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalogue.registry import longs, micros, query, table
from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.functions.vectors import digest_embedding
from quarry.operators.windows import gap_sessions, latest_open, sliding_windows, tumbling_windows
from quarry.plans import chunk as C

LINES_SQL = """ln AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents)"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.split_lines(F.col("text")).alias("l"))


@query(f"""WITH {LINES_SQL},
w AS (SELECT doc_id, l, unnest(generate_series(0, (ceil(greatest(len(l) - 12, 0) / 9.0::DOUBLE) * 9)::BIGINT, 9)) AS o FROM ln)
SELECT doc_id, o AS window_start, least(o + 11, greatest(len(l) - 1, 0))::BIGINT AS window_end, md5(array_to_string(l[o + 1:o + 12], chr(10))) AS digest FROM w""")
def sliding_line_windows(spark, folder):
    """Overlapping line windows."""
    w = sliding_windows(_lines(spark, folder), "l", 12, 9)
    return longs(w.select("doc_id", "window_start", F.least(F.col("window_start") + 11, F.greatest(F.size("l") - 1, F.lit(0))).alias("window_end"),
                          F.md5(F.array_join("window", "\n")).alias("digest")), "window_start", "window_end")


@query(f"""WITH {LINES_SQL},
w AS (SELECT doc_id, l, unnest(generate_series(0, greatest(len(l) - 1, 0) // 10)) AS n FROM ln),
x AS (SELECT doc_id, n, l[n * 10 + 1:n * 10 + 10] AS s FROM w)
SELECT doc_id, n AS window_no, len(s)::BIGINT AS n_lines, md5(array_to_string(s, chr(10))) AS digest FROM x WHERE len(list_filter(s, lambda y: trim(y) <> '')) > 0""")
def tumbling_line_windows(spark, folder):
    """C4: fixed line windows, blank ones dropped."""
    w = tumbling_windows(_lines(spark, folder), "l", 10)
    return longs(w.select("doc_id", "window_no", F.size("window").alias("n_lines"), F.md5(F.array_join("window", "\n")).alias("digest")),
                 "window_no", "n_lines")


HOUR = 3_600_000_000


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {HOUR} THEN 0 ELSE 1 END AS s FROM e),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(t) AS session_start, max(t) AS session_end, count(*) AS n_rows FROM k GROUP BY user_id, n HAVING count(*) >= 2""")
def gap_sessions_by_user(spark, folder):
    """Runs of rows no more than a gap apart, short ones dropped."""
    events = table(spark, folder, "events").select("user_id", micros(F.col("ts")).alias("t"))
    return gap_sessions(events, ["user_id"], "t", HOUR, 2)


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
j AS (SELECT c.event_id, v.event_id AS owner_id, row_number() OVER (PARTITION BY c.event_id ORDER BY v.t DESC, v.event_id DESC) AS rn
      FROM e c JOIN e v ON v.user_id = c.user_id AND v.event_type = 'view' AND v.t <= c.t AND v.t >= c.t - {2 * HOUR} WHERE c.event_type = 'click')
SELECT event_id, owner_id FROM j WHERE rn = 1""")
def innermost_owner(spark, folder):
    """J5, X3 by analogy: the latest span that holds a point."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("t"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "t")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "t")
    return latest_open(clicks, views, ["user_id"], "t", "t", "view_id", 2 * HOUR, HOUR // 4).select("event_id", "owner_id")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, folder):
    """Content hash."""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


FILE_SQL = """pp AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS g, regexp_extract(url, '/([0-9]+)', 1) AS n FROM pages),
pf AS (SELECT page_id, g, CASE WHEN g = 'en' AND length(n) = 3 THEN concat('src/', n, '.PY') WHEN g = 'en' THEN concat('src/test_', n, '.go')
  WHEN g = 'fr' THEN concat('node_modules/', n, '.ts') WHEN g = 'de' THEN concat('web/', n, '.min.js') WHEN g = 'es' THEN concat('conf/spec/', n, '.yaml')
  ELSE concat('.env', n) END AS path, length(n) AS k FROM pp)"""


def _page_files(spark: SparkSession, folder: str) -> DataFrame:
    g = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1)
    n = F.regexp_extract("url", r"/([0-9]+)", 1)
    path = (
        F.when((g == "en") & (F.length(n) == 3), F.concat(F.lit("src/"), n, F.lit(".PY")))
        .when(g == "en", F.concat(F.lit("src/test_"), n, F.lit(".go")))
        .when(g == "fr", F.concat(F.lit("node_modules/"), n, F.lit(".ts")))
        .when(g == "de", F.concat(F.lit("web/"), n, F.lit(".min.js")))
        .when(g == "es", F.concat(F.lit("conf/spec/"), n, F.lit(".yaml")))
        .otherwise(F.concat(F.lit(".env"), n)))
    return table(spark, folder, "pages").select("page_id", path.alias("path"))


@query(f"""WITH {FILE_SQL}
SELECT page_id, path, CASE WHEN path LIKE '%.PY' THEN 'python' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.ts' THEN 'typescript'
  WHEN path LIKE '%.js' THEN 'javascript' END AS code_lang, CASE WHEN path LIKE '%.yaml' THEN 'yaml' END AS data_lang,
  path LIKE 'src/test_%' OR path LIKE 'conf/spec/%' AS is_test, path LIKE 'node_modules/%' OR path LIKE '%.min.js' AS ignored FROM pf""")
def path_classify(spark, folder):
    """Language, test code and ignore rules of a path."""
    path = F.col("path")
    return _page_files(spark, folder).select(
        "page_id", "path", P.code_language(path).alias("code_lang"), P.data_language(path).alias("data_lang"),
        P.is_test_path(path).alias("is_test"), (P.in_ignored_dir(path) | P.ignored_by(path, P.IGNORED_GLOBS)).alias("ignored"))


@query(f"""WITH {FILE_SQL}
SELECT page_id, CASE WHEN path LIKE 'src/%.go' THEN false WHEN path LIKE 'src/%' THEN true WHEN path LIKE '%.yaml' THEN true ELSE false END AS ignored FROM pf""")
def ignore_file_rules(spark, folder):
    """Ignore-file patterns with a re-inclusion; the last match decides."""
    rules = ["# comment", "src/", "!src/test_*.go", "**/spec/*.yaml", "/nowhere"]
    return _page_files(spark, folder).select("page_id", P.ignored_by(F.col("path"), rules).alias("ignored"))


# Documents with a head that depends on their language: licence comments, then an import block, then imports.
HEAD = {
    "en": "/*\nCopyright\n*/\n# more\nimport (\n  \"a\"\n  x(\"b\")\n)\n",
    "fr": "// licence\n// line\nimport {\n  a,\n} from \"x\"\nfrom y import z\n",
    "de": "<!-- licence\n-->\nuse {b};\npackage p\n",
    "es": "value = 1\n// kept\n#dropped\nimport q\n",
}
HEAD_SQL = "CASE lang " + " ".join(
    "WHEN '%s' THEN '%s'" % (lang, head.replace("\n", "\\n")) for lang, head in HEAD.items()) + " ELSE '' END"
HEADED_SQL = f"""hd AS (SELECT doc_id, lang, concat(replace({HEAD_SQL}, '\\n', chr(10)), text) AS t FROM documents),
nl AS (SELECT doc_id, lang, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ln FROM hd),
nb AS (SELECT * FROM nl WHERE regexp_replace(line, '\\s+', '', 'g') <> '')"""


def _headed(spark: SparkSession, folder: str) -> DataFrame:
    head = F.lit("")
    for lang, text in HEAD.items():
        head = F.when(F.col("lang") == lang, text).otherwise(head)
    lines = table(spark, folder, "documents").select(
        F.lit("r").alias("repo"), F.col("doc_id").alias("path"), F.posexplode(T.split_lines(F.concat(head, F.col("text")))).alias("p", "line"))
    return lines.select("repo", "path", (F.col("p") + 1).alias("ln"), "line").where(F.regexp_replace("line", r"\s+", "") != "")


def _summary(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("path").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("ln").cast("long").alias("first_line"), F.sum(F.length("line")).cast("long").alias("n_chars"))


SUMMARY_SQL = "SELECT doc_id, count(*) AS n_lines, min(ln)::BIGINT AS first_line, sum(length(line))::BIGINT AS n_chars"


@query(f"""WITH {HEADED_SQL},
c AS (SELECT *, coalesce(bool_and((lang = 'en' AND ln <= 4) OR (lang = 'fr' AND ln <= 2) OR (lang = 'de' AND ln <= 2)
        OR regexp_matches(line, '^\\s*(#|//|--|;|!)')) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING), false) AS head FROM nb)
{SUMMARY_SQL} FROM c WHERE NOT head GROUP BY 1""")
def leading_comment_strip(spark, folder):
    """The comment run above the first code line goes."""
    return _summary(C.strip_leading_comments(_headed(spark, folder)))


@query(f"""WITH {HEADED_SQL}
{SUMMARY_SQL} FROM nb WHERE NOT ((lang = 'en' AND ln BETWEEN 5 AND 8) OR (lang = 'fr' AND ln BETWEEN 3 AND 5) OR (lang = 'de' AND ln = 3)) GROUP BY 1""")
def import_block_strip(spark, folder):
    """Bracketed import groups go, everything else stays."""
    return _summary(C.strip_import_blocks(_headed(spark, folder)))


@query(f"""WITH {HEADED_SQL}
{SUMMARY_SQL} FROM nb WHERE NOT regexp_matches(trim(line), '^(#|import |from |package |use |#include|using |export \\* |export \\{{|require\\(|const \\{{)') GROUP BY 1""")
def import_line_filter(spark, folder):
    """Import and hash lines go."""
    return _summary(C.drop_import_lines(_headed(spark, folder)))


AFFIX_SQL = """nm AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN concat('test_', replace(p_name, ' ', '_')) WHEN 'SMALL' THEN concat('Test', replace(p_name, ' ', ''))
  WHEN 'LARGE' THEN concat(replace(p_name, ' ', '_'), '_test') WHEN 'PROMO' THEN concat(replace(p_name, ' ', ''), 'Spec') WHEN 'MEDIUM' THEN upper(replace(p_name, ' ', '_')) ELSE 'test' END AS name FROM part)"""


@query(f"""WITH {AFFIX_SQL}
SELECT p_partkey, name, CASE WHEN starts_with(name, 'test_') AND length(name) > 5 THEN ltrim(substring(name, 6), '_')
 WHEN starts_with(name, 'Test') AND length(name) > 4 THEN ltrim(substring(name, 5), '_') WHEN starts_with(name, 'test') AND length(name) > 4 THEN ltrim(substring(name, 5), '_')
 WHEN ends_with(name, '_test') THEN name[:-6] WHEN ends_with(name, 'Spec') THEN name[:-5] ELSE name END AS stem,
 name = upper(name) AND name <> lower(name) AND length(name) > 1 AS is_const FROM nm""")
def name_rules(spark, folder):
    """Test affixes and the constant rule."""
    words, joined = F.replace("p_name", F.lit(" "), F.lit("_")), F.replace("p_name", F.lit(" "), F.lit(""))
    name = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("test_"), words)).when(F.col("p_type") == "SMALL", F.concat(F.lit("Test"), joined))
        .when(F.col("p_type") == "LARGE", F.concat(words, F.lit("_test"))).when(F.col("p_type") == "PROMO", F.concat(joined, F.lit("Spec")))
        .when(F.col("p_type") == "MEDIUM", F.upper(words)).otherwise("test"))
    df = table(spark, folder, "part").select("p_partkey", name.alias("name"))
    return df.select("*", T.strip_test_affix(F.col("name")).alias("stem"), T.is_constant_name(F.col("name")).alias("is_const"))


@query("""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '') AS w, p_brand, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size > 25 THEN concat(replace(p_brand, '#', ''), '.', w, '.m') WHEN p_size > 10 THEN concat(replace(p_brand, '#', ''), '.', w, '.Other.m')
  ELSE concat(w, '.', w, '.m') END AS qname,
 CASE WHEN p_size > 10 THEN concat('r:', replace(p_brand, '#', ''), '/', w, '.java') ELSE concat('r:', w, '.java') END || ':' ||
 CASE WHEN p_size > 25 OR p_size <= 10 THEN concat(w, '.m') ELSE 'Other.m' END AS id FROM n""")
def symbol_names(spark, folder):
    """Symbol ids and qualified names; a file named after its type does not repeat it."""
    word = F.replace("p_name", F.lit(" "), F.lit(""))
    folder_name = F.replace("p_brand", F.lit("#"), F.lit(""))
    path = F.when(F.col("p_size") > 10, F.concat(folder_name, F.lit("/"), word, F.lit(".java"))).otherwise(F.concat(word, F.lit(".java")))
    local = F.when(F.col("p_size").between(11, 25), F.lit("Other.m")).otherwise(F.concat(word, F.lit(".m")))
    df = table(spark, folder, "part").select("p_partkey", path.alias("path"), local.alias("local"))
    return df.select("p_partkey", T.qualified_name(F.col("path"), F.col("local")).alias("qname"),
                     T.symbol_id(F.lit("r"), F.col("path"), F.col("local")).alias("id"))


def _byte_sql(i: int) -> str:
    return f"round((('0x' || substring(sha256(text), {(i % 32) * 2 + 1}, 2))::INTEGER - 127.5::DOUBLE) / 127.5::DOUBLE, 5)"


@query(f"""SELECT doc_id, 384::BIGINT AS dim, {_byte_sql(0)} AS e0, {_byte_sql(31)} AS e31, {_byte_sql(383)} AS e383,
  md5(array_to_string(list_transform(range(384), lambda i: ('0x' || substring(sha256(text), CAST((i % 32) * 2 + 1 AS INTEGER), 2))::INTEGER), ',')) AS every_dimension FROM documents""")
def digest_embeddings(spark, folder):
    """The deterministic test embedding of every document."""
    df = table(spark, folder, "documents").select("doc_id", digest_embedding(F.col("text")).alias("v"))
    at = lambda i: F.round(F.get("v", F.lit(i)).cast("double"), 5).alias(f"e{i}")
    whole = F.md5(F.array_join(F.transform("v", lambda x: F.round(x * 127.5 + 127.5).cast("int").cast("string")), ",").cast("binary"))
    return df.select("doc_id", F.size("v").cast("long").alias("dim"), at(0), at(31), at(383), whole.alias("every_dimension"))


@query("""
WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z0-9]+|[a-z][a-z0-9]*|[A-Z]+'))) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n, md5(word) AS h FROM w GROUP BY ALL),
b AS (SELECT doc_id, CAST(CAST(concat('0x', h[1:8]) AS BIGINT) % 384 AS INTEGER) AS bucket, sum((CASE WHEN h[9] >= '8' THEN 1.0::DOUBLE ELSE -1 END) * (1 + ln(n::DOUBLE))) AS x FROM c GROUP BY 1, 2)
SELECT doc_id, bucket, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM b WHERE abs(x) > 1e-9""")
def feature_embeddings(spark, folder):
    """Every non-zero component of the feature-hash embedding of every document."""
    from quarry.functions.vectors import HashedFeatures

    df = HashedFeatures().embed(table(spark, folder, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).where("abs(x) > 1e-8").select(
        "doc_id", "bucket", F.round(F.col("x").cast("double"), 5).alias("value"))


@query(f"""WITH {LINES_SQL}
SELECT doc_id, CASE WHEN len(l) >= 3 THEN array_to_string(l[3:5], chr(10)) END AS excerpt, substring(l[1], 1, 120) AS first_line FROM ln""")
def line_ranges(spark, folder):
    """Exact line ranges, clamped at the end, and first-line truncation."""
    from quarry.sources.tree import line_range

    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", line_range(text, F.lit(3), F.lit(5)).alias("excerpt"), T.first_line(text, 120).alias("first_line"))

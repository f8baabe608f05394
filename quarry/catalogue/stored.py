"""The stored index over two states of the documents (K1-K5), binding after a change (J2-J4), answers cut to budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalogue.registry import longs, query, table
from quarry.catalogue.relations import RESOLVE_SQL, part_symbols
from quarry.functions import text as T
from quarry.operators import resolve as R
from quarry.operators.diff import changed_files
from quarry.operators.fitting import CARD, HEADING, NOTE, fit_answers
from quarry.session import staged, staging_path
from quarry.sources.warehouse import Warehouse, shelves_for

REPO = "docs"
#: The second state: documents of good quality get a line more, toxic ones go, benchmark items come.
STATES_SQL = """WITH marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
files AS (SELECT concat(coalesce(source, ''), '/', doc_id) AS path, CASE WHEN quality = 1 THEN concat(coalesce(text, ''), chr(10), 'added line') ELSE coalesce(text, '') END AS text
  FROM documents LEFT JOIN marks USING (doc_id) WHERE coalesce(toxic, 0) <> 1 UNION ALL SELECT concat('bench/', item_id), coalesce(text, '') FROM benchmark),
lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM files),
names AS (SELECT path, ord, string_split(line, ' ')[1] AS name FROM lines)"""


def _states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents")
    path, text = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), "doc_id").alias("path"), F.coalesce("text", F.lit(""))
    marks = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    later = documents.join(marks, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) != 1).select(
        path, F.when(F.col("quality") == 1, F.concat(text, F.lit("\nadded line"))).otherwise(text).alias("text"))
    items = table(spark, folder, "benchmark").select(F.concat(F.lit("bench/"), "item_id").alias("path"), text.alias("text"))
    return documents.select(path, text.alias("text")), later.unionByName(items)


def store(warehouse: Warehouse, state: DataFrame, shelves: int | None = None) -> int:
    """Bring the stored rows of a state's texts up to date: each line's first word is a symbol, of which the last of a text stays. How
    many folders the sweep took."""
    spark, gen = warehouse.spark, warehouse.next_generation(REPO)
    known, before = warehouse.published(REPO), warehouse.read("files", REPO)
    found = state.select("path", "text", F.sha2("text", 256).alias("sha256"))
    diff = staged(spark, changed_files(found, before.select("path", F.col("sha256").alias("old_sha256"))).select("path", "status"))  # read by all that follows
    shelves = known["shelves"] if known else shelves or shelves_for(found.count())
    gone = diff.where("status <> 'unchanged'").select("path")
    touched = warehouse.touched(gone, shelves)
    none = F.lit(None)
    work = found.join(gone, "path", "left_semi")
    lines = work.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("path", (F.col("at") + 1).alias("ord"), F.substring_index("line", " ", 1).alias("name"))
    rows = lines.select(T.symbol_id(F.lit(REPO), F.col("path"), F.col("name")).alias("id"), "path", none.alias("lang"), "ord", "name", none.alias("qname"), F.col("name").alias("local_qname"), none.alias("kind"),
                        F.col("ord").alias("start_line"), F.col("ord").alias("end_line"), *(none.alias(c) for c in ("start_byte", "end_byte", "signature", "docstring", "parent", "is_test", "body")))
    warehouse.replace("symbols", rows, gone, REPO, gen, shelves, touched, key="id", order="ord")
    now = work.select("path", none.alias("lang"), F.lit(False).alias("is_data"), F.lit(False).alias("is_test"), "sha256", F.length("text").alias("size"), none.alias("loc"))
    same = before.join(diff.where("status = 'unchanged'"), "path", "left_semi")
    warehouse.snapshot(now, same, REPO, gen, shelves, touched)
    live = warehouse.live("symbols", REPO, gen)
    links = live.select(F.col("path").alias("src_id"), F.col("name").alias("dst_id"), F.lit("CALLS").alias("kind"), none.alias("via"), F.col("path").alias("src_path"), none.alias("dst_path"))
    warehouse.append("edges", links, REPO, gen)
    record = spark.createDataFrame([(gen, gen, gen, shelves)], "files_gen long, edges_gen long, history_gen long, shelves int")
    columns = ("root", "embedder", "dim", "commit", "has_history", "indexed_at", "n_docs", "total_words")
    warehouse.append("repos", record.select("*", *(none.alias(c) for c in columns)), REPO, gen)
    return warehouse.sweep(REPO)


def _twice(spark: SparkSession, folder: str) -> Warehouse:
    warehouse = Warehouse(spark, staging_path(spark, "warehouse"))
    for state in _states(spark, folder):
        store(warehouse, state)
    return warehouse


@query(f"{STATES_SQL} SELECT concat('docs:', path, ':', name) AS id, path, name, max(ord) AS start_line FROM names GROUP BY path, name")
def index_upsert(spark, folder):
    """K1-K3: rows of changed files replaced on their shelves, the last definition of a key stays, the rest moves along."""
    return longs(_twice(spark, folder).read("symbols", REPO).select("id", "path", "name", "start_line"), "start_line")


@query(f"{STATES_SQL} SELECT path, sha256(text) AS sha256, length(text) AS size FROM files")
def index_prune(spark, folder):
    """K4: files that are gone leave the snapshot, and so do their rows."""
    warehouse = _twice(spark, folder)
    rows = warehouse.read("symbols", REPO).select("path").distinct()
    return longs(warehouse.read("files", REPO).join(rows, "path", "left_semi").select("path", "sha256", "size"), "size")


@query(f"{STATES_SQL} SELECT DISTINCT path AS src_id, name AS dst_id FROM names")
def index_replace_edges(spark, folder):
    """K5: relations of the generation before are replaced as a whole."""
    return _twice(spark, folder).read("edges", REPO).select("src_id", "dst_id")


#: The second state: definitions of one brand are renamed, another brand's files go.
_RENAMED, _GONE = "Brand#11", "Brand#12"
REBIND_SQL = f"""WITH pt AS (SELECT p_partkey, p_brand, p_size, p_type, CASE WHEN p_brand = '{_RENAMED}' THEN concat(p_name, ' again') ELSE p_name END AS p_name
 FROM part WHERE p_brand <> '{_GONE}'), {RESOLVE_SQL.replace("FROM part", "FROM pt")}"""


@query(f"{REBIND_SQL} SELECT path, lang, name, dst_path, known FROM an")
def rebind_after_change(spark, folder):
    """Bindings after a change from those before it; the SQL binds everything anew."""
    part = table(spark, folder, "part")
    later = part.where(F.col("p_brand") != _GONE).withColumn("p_name", F.when(F.col("p_brand") == _RENAMED, F.concat("p_name", F.lit(" again"))).otherwise(F.col("p_name")))
    symbols, imports, refs, files = part_symbols(spark, folder, part)
    answers = R.resolve_names(R.wanted_names(refs), symbols, imports, files)
    new_symbols, new_imports, new_refs, new_files = part_symbols(spark, folder, later)
    # A file's references name parts of other files, so a rename changes the text of those that refer to it as well.
    old_lines, new_lines = (R.wanted_names(r).groupBy("repo", "path").agg(F.sort_array(F.collect_list(F.struct("lang", "name"))).alias(side)) for r, side in ((refs, "old"), (new_refs, "new")))
    edited = old_lines.join(new_lines, ["repo", "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("repo", "path")
    renamed = files.where(F.startswith("path", F.lit(f"{_RENAMED}/")) | F.startswith("path", F.lit(f"{_GONE}/")))
    gone = edited.unionByName(renamed).distinct()
    mine = lambda df: df.join(gone, ["repo", "path"], "left_semi")
    return R.rebind(answers, gone, mine(new_refs), mine(symbols), mine(new_symbols), new_symbols, new_imports, files, new_files).select("path", "lang", "name", "dst_path", "known")


#: Answers are sources, their sections languages, their cards whole documents; two languages have notes, one has no heading.
FIT_SQL = """WITH a AS (SELECT DISTINCT source AS answer, 3 AS title_cost, 4000 + 500 * (length(source) % 4) AS budget FROM documents WHERE source IS NOT NULL),
s AS (SELECT answer, lang AS section, CASE WHEN lang <> 'es' THEN length(lang) + 2 END AS heading_cost, CASE WHEN lang IN ('de', 'fr') THEN 700 END AS note_cost
  FROM a CROSS JOIN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
c AS (SELECT source AS answer, lang AS section, doc_id AS pos, greatest(1, ceil(coalesce(length(text), 0) / 4.0::DOUBLE * 1.15::DOUBLE))::BIGINT AS cost FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
st AS (SELECT s.* FROM s WHERE note_cost IS NOT NULL OR EXISTS (SELECT 1 FROM c WHERE c.answer = s.answer AND c.section = s.section)),
i AS (SELECT answer, section, 0 AS kind, NULL::BIGINT AS pos, coalesce(heading_cost, 0) AS cost, coalesce(heading_cost, 2) AS need FROM st
  UNION ALL SELECT answer, section, 1, pos, cost, cost FROM c UNION ALL SELECT answer, section, 2, NULL, note_cost, NULL FROM st WHERE note_cost IS NOT NULL),
r AS (SELECT i.*, budget, title_cost + coalesce(sum(cost) OVER (PARTITION BY i.answer ORDER BY section, kind, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM i JOIN a ON a.answer = i.answer),
o AS (SELECT *, sum(CASE WHEN spent + need > budget AND kind = 0 THEN 1 ELSE 0 END) OVER w AS heads, sum(CASE WHEN spent + need > budget THEN 1 ELSE 0 END) OVER w AS overs,
  min(CASE WHEN spent + need > budget THEN section END) OVER w AS cut FROM r WINDOW w AS (PARTITION BY answer ORDER BY section, kind, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, overs = 0 OR (kind = 2 AND cut = section AND heads = 0) AS shown FROM o)"""


@query(f"""{FIT_SQL} SELECT answer, section, count(*) FILTER (shown AND kind = 0) AS headings, count(*) FILTER (shown AND kind = 1) AS cards,
 count(*) FILTER (shown AND kind = 2) AS notes, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (shown AND kind = 1), '') AS listed FROM f GROUP BY 1, 2""")
def answers_within_budget(spark, folder):
    """Many answers of several sections, each cut to its budget at the first item that goes over it."""
    documents = table(spark, folder, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    answers = documents.select(F.col("source").alias("answer")).distinct().select("answer", F.lit(3).alias("title_cost"), (4000 + 500 * (F.length("answer") % 4)).alias("budget"))
    langs = [r[0] for r in documents.select("lang").distinct().collect()]  # a language each
    sections = answers.select("answer").withColumn("section", F.explode(F.lit(langs))).select(
        "answer", "section", F.when(F.col("section") != "es", F.length("section") + 2).alias("heading_cost"), F.when(F.col("section").isin("de", "fr"), 700).alias("note_cost"))
    cards = documents.select(F.col("source").alias("answer"), F.col("lang").alias("section"), F.col("doc_id").alias("pos"),
                             F.greatest(F.lit(1), T.estimate_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("cost"))
    found = fit_answers(answers, sections, cards).where("shown")
    every = sections.select("answer", "section").join(cards.select("answer", "section").distinct().withColumn("filled", F.lit(True)), ["answer", "section"], "left").where("filled OR section IN ('de', 'fr')")
    counts = found.groupBy("answer", "section").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in ((HEADING, "headings"), (CARD, "cards"), (NOTE, "notes"))),
                                                    F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("listed"))
    filled = every.select("answer", "section").join(counts, ["answer", "section"], "left")
    return filled.select("answer", "section", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("headings", "cards", "notes")), F.coalesce("listed", F.lit("")).alias("listed"))

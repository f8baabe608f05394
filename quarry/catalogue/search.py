"""Search, ranking and evaluation queries (R*, P14-P20, A11-A17, W1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalogue.registry import longs, query, table
from quarry.functions import text as T
from quarry.operators import evaluate as E
from quarry.operators import ranking as R
from quarry.operators.blocks import blocks_topk, by_stretch, posting_blocks
from quarry.operators.windows import budget_prefix
from quarry.plans.pack import priced
from quarry.session import staged

TERMS = ["avec", "nicht", "thereou", "with"]
TERMS_SQL = "('avec'), ('nicht'), ('thereou'), ('with')"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)

BM25_SQL = f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS term FROM documents),
dl AS (SELECT d.doc_id, count(t.term)::DOUBLE AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
q(term) AS (VALUES {TERMS_SQL}),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tok JOIN q USING (term) GROUP BY 1, 2),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
       FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY 1)"""
KNN_SQL = """
qv AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
kn AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings CROSS JOIN qv)"""


def _first_vector(embeddings: DataFrame) -> list[float]:
    return embeddings.where(F.col("vec_id") == 0).select("embedding").first()[0]


def _knn(spark: SparkSession, folder: str, k: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return R.knn(vectors, "embedding", [(0, _first_vector(vectors))], k, "vec_id")


@query(f"""WITH {KNN_SQL}
SELECT vec_id, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM kn
ORDER BY score DESC, vec_id LIMIT 20""")
def knn_cosine_topk(spark, folder):
    """Exact cosine nearest neighbours of one query vector."""
    return longs(_knn(spark, folder, R.SEED_POOL).select("vec_id", F.round("score", 5).alias("score"), "rank"), "rank")


@query(f"""WITH {BM25_SQL}
SELECT doc_id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20""")
def bm25_topk(spark, folder):
    """R2: best documents for a few words."""
    scored = R.bm25_scan(table(spark, folder, "documents"), "doc_id", "text", TERMS, lambda df: staged(spark, df))
    return R.ranked(scored, [F.desc("score"), F.col("doc_id")], R.SEED_POOL).select("doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {BM25_SQL}
SELECT doc_id, round(score, 5) AS score FROM bm""")
def bm25_from_postings(spark, folder):
    """R2: the same scores for every matching document, through the stored form of the index."""
    documents = table(spark, folder, "documents")
    post = R.postings(documents, ["doc_id"], "text")
    stats = documents.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(R.words(F.col("text")))).alias("a")).first()
    return R.bm25_postings(post, ["doc_id"], TERMS, stats["n"], stats["a"]).select("doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {BM25_SQL}
SELECT doc_id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20""")
def bm25_blocks_topk(spark, folder):
    """R2: the best documents from stored blocks, of which only those are read whose bound reaches the threshold."""
    documents = table(spark, folder, "documents")
    total = documents.count()
    words = documents.agg(F.avg(F.size(R.words(F.col("text"))))).first()[0]
    post = R.postings(by_stretch(documents.select("doc_id", "text"), "doc_id", total), ["stretch", "doc_id"], "text")
    blocks = staged(spark, posting_blocks(post, "doc_id", total, words))
    found, _ = blocks_topk(blocks, TERMS, total, words, R.SEED_POOL)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


@query(f"""WITH {BM25_SQL}, {KNN_SQL},
va AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM kn ORDER BY rank LIMIT 20),
ta AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY rank LIMIT 20),
al AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS s, 0 AS arm, rank FROM va
       UNION ALL SELECT id, 0.25::DOUBLE / (60 + rank), 1, rank FROM ta),
fu AS (SELECT id, sum(s) AS score, min(arm * 1000 + rank) AS seen FROM al GROUP BY 1)
SELECT id, round(score / max(score) OVER (), 5) AS relevance, row_number() OVER (ORDER BY score DESC, seen) AS rank
FROM fu ORDER BY score DESC, seen LIMIT 8""")
def hybrid_search(spark, folder):
    """Both arms over whole tables, fused, normalised, best eight."""
    vector = _knn(spark, folder, R.SEED_POOL).select(F.col("vec_id").alias("id"), "rank")
    scored = R.bm25_scan(table(spark, folder, "documents"), "doc_id", "text", TERMS, lambda df: staged(spark, df))
    words = R.ranked(scored, [F.desc("score"), F.col("doc_id")], R.SEED_POOL).select(F.col("doc_id").alias("id"), "rank")
    fused = R.fuse([(vector, 1.0), (words, 0.25)], "id")
    top = R.ranked(fused, [F.desc("score"), F.col("seen")], 8)
    return longs(R.normalise(top).select("id", F.round("score", 5).alias("relevance"), "rank"), "rank")


@query("""WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 60),
b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 60),
u AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT id, 0.25::DOUBLE / (60 + rank) FROM b)
SELECT id, round(sum(s), 8) AS score FROM u GROUP BY 1""")
def rrf_weighted(spark, folder):
    """Weighted reciprocal-rank fusion of two rankings."""
    part = table(spark, folder, "part").withColumnRenamed("p_partkey", "id")
    first = R.ranked(part, [F.desc("p_retailprice"), F.col("id")], 60)
    second = R.ranked(part, [F.desc("p_size"), F.desc("p_retailprice"), F.col("id")], 60)
    return R.fuse([(first, 1.0), (second, 0.25)], "id").select("id", F.round("score", 8).alias("score"))


POOL_SQL = """pool AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part ORDER BY pos LIMIT 80),
sc AS (SELECT id, pos, 1.0::DOUBLE / (60 + pos) AS score FROM pool),
ed AS (SELECT DISTINCT x.l_partkey AS src, y.l_partkey AS dst FROM lineitem x JOIN lineitem y
       ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber WHERE x.l_partkey <> y.l_partkey)"""


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Call edges by analogy: consecutive lines of an order."""
    lines = table(spark, folder, "lineitem")
    left = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    right = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return left.join(right, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    ranked = R.ranked(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"),
                      [F.desc("p_retailprice"), F.col("id")], 80)
    return ranked.select("id", F.col("rank").alias("pos"), (F.lit(1.0) / (F.lit(60) + F.col("rank"))).alias("score"),
                         F.array().cast("array<string>").alias("reasons"))


@query(f"""WITH {POOL_SQL},
co AS (SELECT DISTINCT unnest([src, dst]) AS id FROM ed WHERE src IN (SELECT id FROM pool) AND dst IN (SELECT id FROM pool))
SELECT id, round(CASE WHEN id IN (SELECT id FROM co) THEN score * 1.35::DOUBLE ELSE score END, 8) AS score FROM sc
WHERE id IN (SELECT id FROM co) OR NOT EXISTS (SELECT 1 FROM co)
   OR score >= (SELECT score FROM sc ORDER BY pos LIMIT 1) * 0.55::DOUBLE""")
def graph_prune_boost(spark, folder):
    """Related candidates are boosted, weak unrelated ones dropped."""
    kept = R.graph_pass(_pool(spark, folder), part_edges(spark, folder), "id", [F.col("pos")])
    return kept.select("id", F.round("score", 8).alias("score"))


@query(f"""WITH {POOL_SQL},
both_ways AS (SELECT src AS seed, dst AS id FROM ed UNION ALL SELECT dst, src FROM ed),
sd AS (SELECT id AS seed, score FROM sc ORDER BY pos LIMIT 5)
SELECT b.id, round(max(sd.score) * 0.45::DOUBLE, 8) AS score FROM both_ways b JOIN sd USING (seed)
WHERE b.id NOT IN (SELECT id FROM pool) GROUP BY 1 ORDER BY max(sd.score) * 0.45::DOUBLE DESC, 1 LIMIT 6""")
def one_hop_expand(spark, folder):
    """Neighbours of the five strongest candidates."""
    grown = R.expand(_pool(spark, folder), part_edges(spark, folder), "id", [F.col("pos")])
    return grown.select("id", F.round("score", 8).alias("score"))


@query("""SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_best(spark, folder):
    """Best row per key."""
    return R.best_per_key(table(spark, folder, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"],
                          [F.desc("n_chars"), F.col("doc_id")])


@query("""SELECT doc_id, round(n_chars::DOUBLE / (SELECT CASE WHEN max(n_chars) = 0 THEN 1 ELSE max(n_chars) END FROM documents), 8) AS score FROM documents""")
def normalise_scores(spark, folder):
    """Scores relative to the best."""
    df = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return R.normalise(df).withColumn("score", F.round("score", 8))


@query("""SELECT doc_id, n_chars * (CASE WHEN lang = 'de' THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN source LIKE 'src1%' AND n_chars > 500 THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END) AS score
FROM documents WHERE starts_with(concat(source, '/', lang), 'src1')""")
def search_adjust(spark, folder):
    """Demotion of anonymous rows and tests, path scope."""
    df = table(spark, folder, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang").alias("path"), F.col("n_chars").cast("double").alias("score"),
        F.when(F.col("lang") != "de", F.col("source")).alias("symbol_qname"),
        (F.startswith("source", F.lit("src1")) & (F.col("n_chars") > 500)).alias("is_test"))
    return R.adjust(df, scope="src1").select("doc_id", "score")


COLLAPSE_SQL = """ln AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, l_extendedprice AS score FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, line) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM ln),
rest AS (SELECT l_suppkey, line, row_number() OVER (PARTITION BY l_suppkey ORDER BY line) AS k FROM rk WHERE rn > 1),
ex AS (SELECT l_suppkey, string_agg(line::VARCHAR, ',' ORDER BY line) AS extra_lines FROM rest WHERE k <= 2 GROUP BY 1)"""


@query(f"""WITH {COLLAPSE_SQL}
SELECT l_suppkey, line AS head_line, coalesce(extra_lines, '') AS extra_lines, greatest(n - 3, 0) AS hidden_count
FROM rk LEFT JOIN ex USING (l_suppkey) WHERE rn = 1""")
def collapse_by_group(spark, folder):
    """One card per group: best row, next lines, hidden rest."""
    df = table(spark, folder, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_extendedprice").alias("score"))
    folded = R.collapse(df, ["l_suppkey"], "line", [F.desc("score"), F.col("line")])
    return folded.select("l_suppkey", F.col("line").alias("head_line"), F.array_join("extra_lines", ",").alias("extra_lines"), "hidden_count")


PATH_SQL = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"
MODULE_SQL = f"""md AS (SELECT list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '') AS p, {PATH_SQL} AS path FROM pages),
mo AS (SELECT CASE WHEN len(p) > 2 THEN concat(p[1], '/', p[2]) WHEN len(p) > 0 THEN p[1] ELSE path END AS module, path FROM md)"""


def _page_paths(spark, folder) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))


@query(f"WITH {MODULE_SQL} SELECT module, count(*) AS n_matches FROM mo GROUP BY 1")
def module_rollup(spark, folder):
    """Matches per module."""
    return R.module_rollup(_page_paths(spark, folder))


@query(f"""WITH {MODULE_SQL}, tot AS (SELECT sum(ceil(length(path) / 4.0::DOUBLE * 1.15::DOUBLE)) AS cost, count(DISTINCT module) AS n FROM mo)
SELECT module, count(*) AS n_matches FROM mo CROSS JOIN tot WHERE tot.cost > 1500 AND tot.n >= 3
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def module_fallback(spark, folder):
    """When the cards do not fit, the ten largest modules, given at least three."""
    pages = _page_paths(spark, folder)
    counted = R.module_rollup(pages)
    cost = pages.agg(F.sum(T.estimate_tokens(F.col("path")))).scalar()
    modules = counted.agg(F.count(F.lit(1))).scalar()
    return counted.where((cost > 1500) & (modules >= 3)).orderBy(F.desc("n_matches"), "module").limit(10)


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*'),
  lambda w: lower(w) NOT IN ({STOP_SQL}) AND length(w) > 2) AS terms FROM conversations)
SELECT conv_id, turn, len(terms)::BIGINT AS n_terms, array_to_string(terms, ' ') AS terms FROM t""")
def lexical_terms(spark, folder):
    """Words worth matching exactly."""
    df = table(spark, folder, "conversations").select("conv_id", "turn", T.lexical_terms(F.col("text")).alias("t"))
    return df.select("conv_id", "turn", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


@query(f"""WITH t AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*'),
  lambda w: lower(w) NOT IN ({STOP_SQL}) AND length(w) > 2) AS terms FROM conversations),
nm AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark),
hit AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, lower(unnest(terms)) AS w FROM t) JOIN nm ON nm.name = w)
SELECT t.conv_id, t.turn, CASE WHEN len(terms) = 0 THEN 0.0::DOUBLE
  WHEN regexp_matches(text, '[A-Za-z_][A-Za-z0-9_]*(?:[._][A-Za-z0-9_]+)+|[a-z]+[A-Z][A-Za-z0-9_]*') THEN 1.0::DOUBLE
  WHEN hit.conv_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS weight
FROM t LEFT JOIN hit ON hit.conv_id = t.conv_id AND hit.turn = t.turn""")
def lexical_weight(spark, folder):
    """How far to trust word search, for every message as a query."""
    keys = ["conv_id", "turn"]
    asked = table(spark, folder, "conversations").select(*keys, "text", T.lexical_terms(F.col("text")).alias("terms"))
    names = table(spark, folder, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    # A message is one row on both sides; repeated words are folded before they travel.
    named = asked.select(*keys, F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(t)))).alias("w")).join(
        names, "w", "left_semi").select(*keys).distinct().withColumn("named", F.lit(True))
    weight = F.when(F.size("terms") == 0, 0.0).when(T.identifier_like(F.col("text")), 1.0).when(F.col("named"), 1.0).otherwise(0.25)
    return asked.join(named, keys, "left").select(*keys, weight.alias("weight"))


# ---------------------------------------------------------------- token budgets and cards
@query("SELECT doc_id, ceil(length(text) / 4.0::DOUBLE * 1.15::DOUBLE)::BIGINT AS tokens FROM documents")
def estimate_tokens(spark, folder):
    """Token estimate."""
    return table(spark, folder, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("""WITH c AS (SELECT doc_id, source, ceil(n_chars / 4.0::DOUBLE * 1.15::DOUBLE)::BIGINT AS cost FROM documents),
r AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY cost, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c)
SELECT source, doc_id, cost, running FROM r WHERE running <= 1500""")
def budget_prefix_by_source(spark, folder):
    """What fits a token budget, in order, per source."""
    df = table(spark, folder, "documents").select(
        "doc_id", "source", F.ceil(F.col("n_chars") / F.lit(4.0) * F.lit(1.15)).cast("long").alias("cost"))
    return budget_prefix(df, ["source"], [F.col("cost"), F.col("doc_id")], "cost", 1500, F.col("doc_id"))


CARD_SQL = """SELECT doc_id, concat(CASE WHEN lang = 'es' THEN '' ELSE lang END) AS qname, source AS path,
  (CASE WHEN lang = 'fr' THEN 0 ELSE doc_id % 97 + 1 END)::BIGINT AS s,
  (CASE WHEN lang = 'de' THEN 0 ELSE doc_id % 97 + 1 + n_chars % 5 END)::BIGINT AS e,
  CASE WHEN n_chars > 900 THEN 'long' ELSE '' END AS reason FROM documents"""


@query(f"""WITH c AS ({CARD_SQL}),
l AS (SELECT *, CASE WHEN s = 0 THEN path WHEN e <> 0 AND e <> s THEN concat(path, ':', s, '-', e) ELSE concat(path, ':', s) END AS location FROM c),
t AS (SELECT doc_id, location, concat(CASE WHEN qname <> '' THEN concat(qname, chr(10), '  ', location) ELSE location END,
   CASE WHEN reason <> '' THEN concat(chr(10), '  <- ', reason) ELSE '' END) AS card FROM l)
SELECT doc_id, location, card, ceil(length(card) / 4.0::DOUBLE * 1.15::DOUBLE)::BIGINT AS cost FROM t""")
def card_rendering(spark, folder):
    """Location, text and price of a card for every document."""
    start = F.when(F.col("lang") == "fr", 0).otherwise(F.col("doc_id") % 97 + 1)
    end = F.when(F.col("lang") == "de", 0).otherwise(F.col("doc_id") % 97 + 1 + F.col("n_chars") % 5)
    df = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("qname"), F.col("source").alias("path"),
        start.alias("start_line"), end.alias("end_line"), F.when(F.col("n_chars") > 900, "long").otherwise("").alias("reason"))
    at = T.card_location(F.col("path"), F.col("start_line"), F.col("end_line"), F.array().cast("array<int>"), F.lit(0))
    return priced(df).select("doc_id", at.alias("location"), "card", "cost")


# ---------------------------------------------------------------- evaluation
CENTROID_SQL = """pos AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1, 2),
cen AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM pos GROUP BY 1),
kn AS (SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS rank
       FROM embeddings CROSS JOIN cen)"""


def _label_questions(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """One question per label, its mean vector, against every vector."""
    vectors = table(spark, folder, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return R.knn(vectors.select("vec_id", "label", "embedding"), "embedding", ((r["label"], r["v"]) for r in means.toLocalIterator()), k, "vec_id")


@query(f"""WITH {CENTROID_SQL},
f AS (SELECT query_id, min(CASE WHEN label = query_id THEN rank END) AS first FROM kn WHERE rank <= 20 GROUP BY 1)
SELECT count(*) AS n_questions, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_1,
 round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f""")
def mrr_hit_at_k(spark, folder):
    """hit@1, hit@5 and mean reciprocal rank."""
    found = _label_questions(spark, folder, 20)
    row = E.rank_metrics(found, "query_id", "rank", F.col("label") == F.col("query_id"))
    return row.select("n_questions", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_5", "mrr")])


@query(f"""WITH {CENTROID_SQL},
r AS (SELECT query_id, vec_id FROM kn WHERE rank <= 50)
SELECT e.label AS label, count(*) AS n_expected, count(r.vec_id) AS n_found, round(count(r.vec_id)::DOUBLE / count(*), 6) AS recall
FROM embeddings e LEFT JOIN r ON r.query_id = e.label AND r.vec_id = e.vec_id GROUP BY 1""")
def recall_eval(spark, folder):
    """Share of the expected items that came back."""
    found = _label_questions(spark, folder, 50).select(F.col("query_id").cast("int").alias("label"), "vec_id")
    expected = table(spark, folder, "embeddings").select("label", "vec_id")
    return E.recall(expected, found, "label", "vec_id").withColumn("recall", F.round("recall", 6))


@query("SELECT lang, median(n_chars)::DOUBLE AS median FROM documents GROUP BY 1")
def median_by_lang(spark, folder):
    """Exact median."""
    return E.median(table(spark, folder, "documents"), ["lang"], "n_chars")


@query("""WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
m AS (SELECT * FROM l WHERE contains(line, 'tion')),
f AS (SELECT sum(length(doc_id::VARCHAR) + length(i::VARCHAR) + length(line) + 3) - 1 AS chars FROM m),
o AS (SELECT sum(ceil(length(text) / 4.0::DOUBLE * 1.15::DOUBLE)) AS t FROM documents WHERE doc_id::VARCHAR IN (SELECT DISTINCT doc_id::VARCHAR AS p FROM m ORDER BY p LIMIT 4))
SELECT (ceil(f.chars / 4.0::DOUBLE * 1.15::DOUBLE) + o.t)::BIGINT AS tokens FROM f CROSS JOIN o""")
def grep_baseline(spark, folder):
    """Evaluation baseline: price of a plain search plus the first four matching files."""
    files = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return E.grep_cost(files, "tion", 4)

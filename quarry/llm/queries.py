"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import alignment, bpe, brown, chunk_dedup, decontaminate, impact_search, line_dedup, mixture, ngram_join, token_files, topk, toxicity, warc
from quarry.llm.words import crc_remainder

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
grams AS (SELECT item_id, least(13, len(w)) AS size, unnest(list_transform(range(0, greatest(1, len(w) - 12)), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS gram FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM grams),
places AS (SELECT doc_id, size, unnest(range(0, len(w) - size + 1)) AS pos, unnest(list_transform(range(0, len(w) - size + 1), lambda i: array_to_string(w[i + 1:i + size], ' '))) AS gram FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, pos, size, item_id FROM places JOIN grams USING (size, gram)),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS i FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.digest().alias("items_sha256"), "contaminated")


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(0, greatest(1, len(w) - 2)), lambda i: array_to_string(w[i + 1:i + 3], ' '))) AS g FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.low AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id
""")
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_join(spark, table(spark, folder, "documents"))


@query()
def op3_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.fuzzy_lines(spark, table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


@query()
def op6_bpe_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(spark, table(spark, folder, "documents"), path)


@query()
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write(spark, table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
""")
def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(spark, vectors, vectors.where("vec_id % 20 = 0"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), '') AS bits FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j: CAST(bits[5 * i + j + 1] AS INT) * (16 >> CAST(j AS INT))))::INT]), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""")
def op1_warc_chain(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write(spark, table(spark, folder, "pages"))
    return warc.pages(warc.read(spark, archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_brown_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_remainder("doc_id", 5) == 1
    scored = brown.score(spark, docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op4_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = crc_remainder("doc_id", 3) == 1
    model = toxicity.train(spark, docs, labels.where(~held_out))
    return toxicity.score(spark, docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op2_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = chunk_dedup.repeated_passages(spark, table(spark, folder, "documents"))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", F.size("repeated").cast("long").alias("n_repeated"), size("repeated").alias("repeated_bytes"),
                        size("removed").alias("removed_bytes"), "repeated", "removed")


@query()
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    encoded = alignment.encode(spark, table(spark, folder, "documents"), *paths)
    return alignment.statistics(spark, encoded, *paths).withColumnRenamed("id", "doc_id")


@query()
def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(spark, table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), k AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM k),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS many FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
s AS (SELECT item_id, k.doc_id, k.r, CAST(sum(many * CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN k USING (r), c GROUP BY item_id, k.doc_id, k.r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""")
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return impact_search.search(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))

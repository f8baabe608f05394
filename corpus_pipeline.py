"""A corpus pipeline: five stages over documents, each on what its predecessor kept.

A stage takes (spark, docs, folder) and returns rows; `run` writes them as Parquet in the shared folder and gives them to the next. All
but the last return the columns of `docs`, whatever they are, so further columns pass through. Ids may be null: such rows are
kept by line dedup and by the Jaccard join. Empty tables give empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from quarry.llm.words import fresh
from quarry.session import staged

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the string-kernel model, fitted on all labels of these documents within its bound, predicts as toxic go."""
    model = toxicity.train(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"))
    if model is None:
        return docs
    mark = fresh("predicted")
    return toxicity.flagged(spark, docs, model, mark=mark).where(F.col(mark) == 0).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of near-equal lines one stays; all documents stay, with the text that is left."""
    return line_dedup.without_lines(docs, staged(spark, line_dedup.fuzzy_lines(spark, docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents with linked sets of five-word shingles, at a similarity of 0.8 or more, that with the smallest id stays."""
    found = ngram_join.jaccard_join(spark, docs, width=5, percent=80)
    own = fresh("goes")
    goes = staged(spark, found.where("component_id != doc_id").select(F.col("doc_id").alias(own)).distinct())
    return docs.join(goes, F.col("doc_id") == F.col(own), "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in benchmark windows go."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    mark = fresh("contaminated")
    return decontaminate.flagged(spark, docs, items, mark=mark).where(~F.col(mark)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document that is left."""
    encoded = bpe.encode(spark, docs, public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("bpe encoding", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(spark, stage(spark, docs, folder))
    return docs

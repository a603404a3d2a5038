"""The corpus pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and all but the last
return documents with the columns they had.  ``run`` writes each stage as Parquet in the shared folder and
reads it again, so a lost executor costs at most the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabaudit.functions.storage import materialize
from tabaudit.llm import decision_list, packing, signature_join, toxicity
from tabaudit.llm.frames import small_batches
from tabaudit.llm.tokens import vocabulary

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END_ID = 2048, 0
NEAR_WORDS, NEAR_PERCENT = 5, 80
KEPT_WORDS = 80_000  # encoded words that a Python worker keeps; it holds what earlier stages left as well


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that a learned rule rejects go."""
    small_batches(spark)
    return decision_list.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score at or above the threshold go."""
    small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    small_batches(spark)
    return signature_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary(VOCABULARY), CAPACITY, END_ID, kept=KEPT_WORDS)


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("packing", packed_sequences),
]

# Learned rules, compression and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

"""Inputs derived from the driver tables, in Spark and as SQL table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.dataset import Dataset

LINEITEM_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
DOC_FEATURES = ("n_chars", "n_words", "mean_word")
EMBEDDING_SIZE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def audit_lineitem(spark: SparkSession, sf_dir: str) -> Dataset:
    df = table(spark, sf_dir, "lineitem").select(*LINEITEM_FEATURES, "l_returnflag")
    return Dataset(df, LINEITEM_FEATURES, "l_returnflag")


# Orders as they might arrive: pending orders have no price yet, "4-NOT SPECIFIED"
# is a missing priority, and finished orders were delivered twice.
DIRTY_ORDERS_SQL = """
  marked as (
    select o_orderkey, o_custkey, o_orderstatus,
           case when o_orderstatus <> 'P' then o_totalprice end as o_totalprice,
           cast(cast(o_orderdate as date) as varchar) as o_day,
           nullif(o_orderpriority, '4-NOT SPECIFIED') as o_orderpriority
    from orders),
  dirty as (
    select * from marked
    union all
    select * from marked where o_orderstatus = 'F')
"""


def dirty_orders(spark: SparkSession, sf_dir: str, missing: Column | None = None) -> DataFrame:
    """``missing`` replaces an absent price; null when not given."""
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    if missing is not None:
        price = price.otherwise(missing)
    marked = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        price.alias("o_totalprice"),
        F.col("o_orderdate").cast("date").cast("string").alias("o_day"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
    )
    return marked.unionByName(marked.filter(F.col("o_orderstatus") == "F"))


DOC_QUALITY_SQL = """
  docs as (
    select l.doc_id, d.n_chars,
           length(d.text) - length(replace(d.text, ' ', '')) + 1 as n_words,
           cast(d.n_chars as double) / (length(d.text) - length(replace(d.text, ' ', '')) + 1) as mean_word,
           l.quality
    from labels l join documents d on l.doc_id = d.doc_id)
"""


def doc_quality(spark: SparkSession, sf_dir: str) -> Dataset:
    """Labelled documents: length, words (counted by blanks) and mean word length."""
    texts = table(spark, sf_dir, "documents").select(
        "doc_id",
        "n_chars",
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    df = texts.join(labels, "doc_id").select(
        "doc_id",
        "n_chars",
        "n_words",
        (F.col("n_chars").cast("double") / F.col("n_words")).alias("mean_word"),
        "quality",
    )
    return Dataset(df, DOC_FEATURES, "quality", "doc_id")


SCORED_SQL = f"""
  {DOC_QUALITY_SQL},
  scored as (
    select doc_id, cast(quality as double) as label,
           cast(n_chars as double) / (n_chars + 1500) as score,
           case when n_chars >= 1500 then 1.0 else 0.0 end as prediction
    from docs)
"""


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by length, marked as good from 1500 characters on."""
    return doc_quality(spark, sf_dir).df.select(
        "doc_id",
        F.col("quality").cast("double").alias("label"),
        (F.col("n_chars").cast("double") / (F.col("n_chars") + 1500)).alias("score"),
        F.when(F.col("n_chars") >= 1500, 1.0).otherwise(0.0).alias("prediction"),
    )


EMBEDDING_NAMES = tuple(f"x{i}" for i in range(EMBEDDING_SIZE))


def emb_binary(spark: SparkSession, sf_dir: str) -> Dataset:
    """Embedding entries as columns; the target is whether the label is below 5."""
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(EMBEDDING_NAMES)],
        (F.col("label") < 5).cast("int").alias("target"),
    )
    return Dataset(df, EMBEDDING_NAMES, "target", "vec_id")


EMBEDDING_ROWS_SQL = """
  entries as (
    select vec_id, case when label < 5 then 1 else 0 end as target,
           generate_subscripts(embedding, 1) - 1 as i,
           cast(unnest(embedding) as double) as x
    from embeddings)
"""

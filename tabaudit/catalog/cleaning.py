"""Queries of projections, cleaning and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog import query
from tabaudit.catalog.fixtures import DIRTY_ORDERS_SQL, dirty_orders, rounded, table
from tabaudit.dataset import Dataset, attach_by_key, attach_target, infer_target, split_target
from tabaudit.functions.columns import numeric_columns, other_columns
from tabaudit.operators import clean
from tabaudit.plans.workflow import DataPlan, prepare

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_day, o_orderpriority"


@query("select c_custkey, c_name, c_acctbal from customer")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["c_nationkey", "c_mktsegment", "c_absent"]
    return clean.drop_columns(table(spark, sf_dir, "customer"), names)


_TARGETS = {
    "customer": None, "documents": None, "embeddings": "label", "events": None, "labels": None, "lineitem": None, "orders": None,
}


@query(
    " union all ".join(
        f"select '{t}' as table_name, {f"'{y}'" if y else 'cast(null as varchar)'} as target, count(*) as n_rows,"
        f" {f'count(distinct {y})' if y else 'cast(0 as bigint)'} as n_classes from {t}"
        for t, y in _TARGETS.items()
    )
)
def target_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred target of each table, and how many classes its rows have."""
    parts = []
    for name in _TARGETS:
        df = table(spark, sf_dir, name)
        target = infer_target(df)
        classes = F.lit(0).cast("long") if target is None else F.count_distinct(target)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("n_rows"), classes.alias("n_classes")).select(
                F.lit(name).alias("table_name"), F.lit(target).cast("string").alias("target"), "n_rows", "n_classes"
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    """
    select doc_id, toxic, quality as y, 2 as n_features from labels
    """
)
def split_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    data = split_target(labels, infer_target(labels, "quality"))
    n = F.lit(len(data.features))
    return data.df.select(*data.features, F.col(data.target).alias("y"), n.alias("n_features"))


@query(
    """
    select 'c_custkey' as "column", true as is_numeric, count(c_custkey) as n from customer
    union all select 'c_name', false, count(c_name) from customer
    union all select 'c_nationkey', true, count(c_nationkey) from customer
    union all select 'c_acctbal', true, count(c_acctbal) from customer
    union all select 'c_mktsegment', false, count(c_mktsegment) from customer
    """, name="numeric_columns")
def numeric_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    kinds = {**{c: True for c in numeric_columns(df)}, **{c: False for c in other_columns(df)}}
    counted = df.agg(*[F.count(c).alias(c) for c in kinds])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("is_numeric"), F.col(c).alias("n")) for c, k in kinds.items()]
    return counted.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query("select n_chars, lang, source as target from documents", name="attach_target")
def attach_renamed_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Dataset(table(spark, sf_dir, "documents"), ("n_chars", "lang"), "source")
    return attach_target(data)


@query(
    """
    select coalesce(d.doc_id, l.doc_id) as doc_id, cast(d.n_chars as double) as n_chars,
           cast(l.quality as double) as quality
    from documents d full outer join labels l on d.doc_id = l.doc_id
    """, name="attach_by_key")
def attach_target_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return attach_by_key(x, y, "doc_id")


@query(f"with {DIRTY_ORDERS_SQL} select distinct {ORDER_COLUMNS} from dirty")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedupe(dirty_orders(spark, sf_dir))


@query(
    f"""
    with {DIRTY_ORDERS_SQL}
    select {ORDER_COLUMNS} from dirty where o_totalprice is not null and o_orderpriority is not null
    """
)
def dropna_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_missing(dirty_orders(spark, sf_dir))


@query(
    f"""
    with {DIRTY_ORDERS_SQL}, deduped as (select distinct * from dirty),
      middle as (select quantile_cont(o_totalprice, 0.5) as m from deduped)
    select o_orderkey, o_custkey, o_orderstatus, round(coalesce(o_totalprice, m), 6) as o_totalprice,
           o_day, coalesce(o_orderpriority, 'Unknown') as o_orderpriority
    from deduped, middle
    """
)
def fill_median_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.clean(dirty_orders(spark, sf_dir), "fill"), 6, "o_totalprice")


@query(
    f"""
    with {DIRTY_ORDERS_SQL}, deduped as (select distinct * from dirty)
    select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from deduped
    """
)
def clean_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(dirty_orders(spark, sf_dir), "auto", ["o_custkey", "o_day", "o_absent"])


_NULL_COUNTS = f"""
    with {DIRTY_ORDERS_SQL}, counted as (
      select 'o_orderkey' as "column", 0 as position, count(*) - count(o_orderkey) as n_nulls from dirty
      union all select 'o_custkey', 1, count(*) - count(o_custkey) from dirty
      union all select 'o_orderstatus', 2, count(*) - count(o_orderstatus) from dirty
      union all select 'o_totalprice', 3, count(*) - count(o_totalprice) from dirty
      union all select 'o_day', 4, count(*) - count(o_day) from dirty
      union all select 'o_orderpriority', 5, count(*) - count(o_orderpriority) from dirty)
"""


@query(f"{_NULL_COUNTS} select * from counted")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.null_counts(dirty_orders(spark, sf_dir))


@query(f"{_NULL_COUNTS} select * from counted order by n_nulls desc, position limit 10")
def na_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.top_null_columns(dirty_orders(spark, sf_dir, F.lit(float("nan"))))


@query(
    f"""
    with {DIRTY_ORDERS_SQL}
    select (select count(*) from dirty) - (select count(*) from (select distinct * from dirty)) as duplicates
    """
)
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.duplicate_count(dirty_orders(spark, sf_dir))


@query(
    """
    with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
    select event_id, value,
           value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) as value_outlier
    from events, q
    """
)
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.outlier_flags(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])


@query(
    f"""
    with {DIRTY_ORDERS_SQL}, deduped as (select distinct * from dirty),
      middle as (select quantile_cont(o_totalprice, 0.5) as m from deduped)
    select o_orderkey, o_custkey, round(coalesce(o_totalprice, m), 6) as o_totalprice,
           coalesce(o_orderpriority, 'Unknown') as o_orderpriority, o_orderstatus as target
    from deduped, middle
    """
)
def prepare_for_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = DataPlan(target_column="o_orderstatus", drop_columns=["o_day"], missing_strategy="fill")
    return rounded(attach_target(prepare(spark, dirty_orders(spark, sf_dir), plan)), 6, "o_totalprice")


@query(
    """
    with joined as (
      select d.doc_id as x_key, l.doc_id as y_key
      from documents d full outer join labels l on d.doc_id = l.doc_id),
    counted as (
      select least(count(*), 10) as n_checked,
             count(*) filter (where x_key is null or y_key is null) as n_unmatched
      from joined)
    select n_checked, n_checked >= 10 as enough_samples, n_unmatched,
           n_checked >= 10 and n_unmatched = 0 as ok
    from counted
    """
)
def validate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("x_key"))
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("y_key"))
    joined = x.join(y, F.col("x_key") == F.col("y_key"), "full_outer")
    return clean.validation_status(joined, x_key="x_key", y_key="y_key")

"""Queries of the audit statistics and the profile."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog import query
from tabaudit.catalog.fixtures import (
    DIRTY_ORDERS_SQL,
    EMBEDDING_ROWS_SQL,
    EMBEDDING_SIZE,
    LINEITEM_FEATURES,
    audit_lineitem,
    dirty_orders,
    doc_quality,
    emb_binary,
    rounded,
    table,
)
from tabaudit.functions.sketches import merged_sketches, quantile_sketches, rank_error, sketch_quantiles
from tabaudit.functions.storage import materialize
from tabaudit.operators import audit, profile

_FEATURES = ", ".join(LINEITEM_FEATURES)
_PAIRS_SQL = " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, abs(corr({a}, {b})) as abs_corr from lineitem"
    for a, b in combinations(LINEITEM_FEATURES, 2)
)


@query("select count(*) as n_samples, cast(5 as bigint) as n_features from lineitem")
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.shape(audit_lineitem(spark, sf_dir))


_ORDER_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_day": "string",
    "o_orderpriority": "string",
}
_ORDER_PROFILE = " union all ".join(
    f"""select '{c}' as "column", {i} as position, '{kind}' as type, count(*) as n,
        count(*) - count({c}) as n_nulls, count(distinct {c}) as n_distinct from dirty"""
    for i, (c, kind) in enumerate(_ORDER_TYPES.items())
)
_ORDER_KIND = """case when type in ('bigint', 'double') and n_distinct >= 0.1 * n
    then 'numeric' else 'categorical' end"""


@query(
    f"""
    with {DIRTY_ORDERS_SQL}, counted as ({_ORDER_PROFILE})
    select "column", position, n as n_rows, 6 as n_columns, n_nulls,
           "column" = 'o_orderstatus' as is_target, {_ORDER_KIND} as semantic_type
    from counted
    """
)
def analyze_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.analyze_raw(dirty_orders(spark, sf_dir), target="o_orderstatus")


@query(
    """
    with counted as (
      select count(*) as n, count(distinct l_quantity) as a, count(distinct l_extendedprice) as b,
             count(distinct l_orderkey) as c, count(distinct l_linenumber) as d from lineitem)
    select 'l_quantity' as "column", case when a >= 0.1 * n then 'numeric' else 'categorical' end as semantic_type from counted
    union all select 'l_extendedprice', case when b >= 0.1 * n then 'numeric' else 'categorical' end from counted
    union all select 'l_orderkey', case when c >= 0.1 * n then 'numeric' else 'categorical' end from counted
    union all select 'l_linenumber', case when d >= 0.1 * n then 'numeric' else 'categorical' end from counted
    union all select 'l_returnflag', 'categorical'
    union all select 'l_shipdate', 'categorical'
    """
)
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag", "l_shipdate"]
    return audit.infer_types(table(spark, sf_dir, "lineitem").select(*names))


@query(
    f"""
    with pairs as ({_PAIRS_SQL} union all
      select c, 'k', cast(null as double) from (values {", ".join(f"('{c}')" for c in LINEITEM_FEATURES)}) t(c))
    select column_a, column_b, round(abs_corr, 6) as abs_corr from pairs
    """
)
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant column is part of the table and has no correlation."""
    df = audit_lineitem(spark, sf_dir).x.withColumn("k", F.lit(1.0))
    return rounded(audit.corr_pairs(df), 6, "abs_corr")


@query(
    f"""
    with {EMBEDDING_ROWS_SQL}
    select 'x' || a.i as column_a, 'x' || b.i as column_b, round(abs(corr(a.x, b.x)), 6) as abs_corr
    from entries a join entries b on a.vec_id = b.vec_id and a.i < b.i
    group by a.i, b.i
    """
)
def corr_pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.corr_pairs(emb_binary(spark, sf_dir).x), 6, "abs_corr")


@query(
    f"""
    with {EMBEDDING_ROWS_SQL},
    holed as (
      select vec_id, i, case when i % 4 = 0 and (vec_id + i) % 7 = 3 then null when i % 5 = 1 then x * 1e-8 else x end as x from entries)
    select 'x' || a.i as column_a, 'x' || b.i as column_b, round(abs(corr(a.x, b.x)), 6) as abs_corr
    from holed a join holed b on a.vec_id = b.vec_id and a.i < b.i
    where a.x is not null and b.x is not null
    group by a.i, b.i
    """
)
def corr_pairs_holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen columns with nulls, others scaled to 1e-8."""
    x = emb_binary(spark, sf_dir).df
    columns = []
    for i in range(EMBEDDING_SIZE):
        value = F.col(f"x{i}")
        if i % 5 == 1:
            value = value * 1e-8
        if i % 4 == 0:
            value = F.when((F.col("vec_id") + i) % 7 != 3, value)
        columns.append(value.alias(f"x{i}"))
    return rounded(audit.corr_pairs(x.select(*columns)), 6, "abs_corr")


@query(f"select round(max(abs_corr), 6) as max_abs_corr from ({_PAIRS_SQL}) p")
def max_abs_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.max_abs_corr(audit_lineitem(spark, sf_dir).x), 6, "max_abs_corr")


@query(
    """
    select l_returnflag as class, count(*) as n,
           round(cast(count(*) as double) / (select count(l_returnflag) from lineitem), 6) as share
    from lineitem where l_returnflag is not null group by l_returnflag
    """
)
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.class_distribution(table(spark, sf_dir, "lineitem"), "l_returnflag"), 6, "share")


@query(
    """
    with docs as (
      select d.n_chars, length(d.text) - length(replace(d.text, ' ', '')) + 1 as n_words, l.quality
      from labels l join documents d on l.doc_id = d.doc_id),
    measured as (select *, cast(n_chars as double) / n_words as mean_word from docs),
    facts as (
      select count(*) as n,
             greatest(abs(corr(n_chars, n_words)), abs(corr(n_chars, mean_word)), abs(corr(n_words, mean_word))) as r,
             (select max(c) from (select count(*) as c from measured group by quality)) / count(*) as top
      from measured)
    select 'needs_scaling' as flag, true as raised
    union all select 'high_dimensional', n < 15 from facts
    union all select 'class_imbalance', top >= 0.8 from facts
    union all select 'high_collinearity', r >= 0.95 from facts
    """
)
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_flags(doc_quality(spark, sf_dir))


_SUMMARY_SQL = f"""
    with pairs as ({_PAIRS_SQL}),
    classes as (select l_returnflag as c, cast(count(*) as double) / (select count(*) from lineitem) as share
                from lineitem group by l_returnflag),
    facts as (select count(*) as n, (select max(abs_corr) from pairs) as r from lineitem),
    summary as (
      select 'shape' as section, 'n_samples' as key, cast(n as double) as value from facts
      union all select 'shape', 'n_features', 5
      {" ".join(f"union all select 'na_top10', '{c}', count(*) - count({c}) from lineitem" for c in LINEITEM_FEATURES)}
      union all select 'duplicates', 'duplicates',
        (select count(*) from lineitem) - (select count(*) from (select distinct {_FEATURES} from lineitem))
      union all select 'features', 'numeric_features', 5
      union all select 'features', 'max_abs_corr_offdiag', r from facts
      union all select 'y_distribution', c, share from classes
      union all select 'flags', 'needs_scaling', 1
      union all select 'flags', 'high_dimensional', case when n < 25 then 1 else 0 end from facts
      union all select 'flags', 'high_collinearity', case when r >= 0.95 then 1 else 0 end from facts
      union all select 'flags', 'class_imbalance', case when max(share) >= 0.8 then 1 else 0 end from classes)
    select section, key, round(value, 6) as value from summary
"""


@query(_SUMMARY_SQL)
def eda_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.eda_summary(audit_lineitem(spark, sf_dir)), 6, "value")


@query(
    f"""
    with {DIRTY_ORDERS_SQL}
    select cast(5 as bigint) as features_count, count(*) as samples_count, true as has_target,
           count(distinct o_orderpriority) + max(case when o_orderpriority is null then 1 else 0 end) as target_classes
    from dirty
    """
)
def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabaudit.dataset import split_target

    return audit.dataset_metadata(split_target(dirty_orders(spark, sf_dir), "o_orderpriority"))


@query(
    f"""
    with {DIRTY_ORDERS_SQL}, counted as ({_ORDER_PROFILE})
    select "column", type, n, n_nulls, round(cast(n_nulls as double) / n, 6) as null_share, n_distinct
    from counted
    """
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.profile_columns(dirty_orders(spark, sf_dir)), 6, "null_share")


_NUMERIC_SQL = " union all ".join(
    f"""select '{c}' as "column", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
        cast(min({c}) as double) as min,
        {", ".join(f"round(quantile_cont({c}, {p}), 6) as p{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))},
        cast(max({c}) as double) as max, count(*) filter (where {c} = 0) as zeros from lineitem"""
    for c in LINEITEM_FEATURES
)


@query(_NUMERIC_SQL)
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.profile_numeric(audit_lineitem(spark, sf_dir).x)
    return rounded(rounded(found, 4, "mean", "std"), 6, "p05", "p25", "p50", "p75", "p95")


@query(
    f"""
    with {DIRTY_ORDERS_SQL}, long as (
      select 'o_orderstatus' as "column", o_orderstatus as value from dirty
      union all select 'o_day', o_day from dirty
      union all select 'o_orderpriority', o_orderpriority from dirty),
    counted as (select "column", value, count(*) as n from long where value is not null group by 1, 2),
    ranked as (
      select *, cast(row_number() over (partition by "column" order by n desc, value) as int) as rank from counted)
    select *, round(cast(n as double) / (select count(*) from dirty), 6) as share from ranked where rank <= 10
    """
)
def profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.profile_topk(dirty_orders(spark, sf_dir)), 6, "share")


_HISTOGRAM_SQL = " union all ".join(
    f"""select '{c}' as "column", cast(least(floor(({c} - low) / w), 9) as int) as bin,
        round(low + least(floor(({c} - low) / w), 9) * w, 6) as lower,
        round(low + (least(floor(({c} - low) / w), 9) + 1) * w, 6) as upper, count(*) as n
        from lineitem, (select cast(min({c}) as double) as low, (cast(max({c}) as double) - min({c})) / 10 as w from lineitem)
        group by all"""
    for c in ("l_quantity", "l_extendedprice", "l_linenumber")
)


@query(_HISTOGRAM_SQL)
def profile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_linenumber"]
    found = profile.profile_histogram(table(spark, sf_dir, "lineitem").select(*names))
    return rounded(found, 6, "lower", "upper")


_PROFILED = (*LINEITEM_FEATURES, "l_returnflag")


@query(
    " union all ".join(
        [f"select 'columns' as part, '{c}' as item, (count(*) - count({c}))::double as value from lineitem" for c in _PROFILED]
        + [f"select 'numeric', '{c}', (count(*) filter (where {c} = 0))::double from lineitem" for c in LINEITEM_FEATURES]
        + ["select 'values', 'l_returnflag', count(l_returnflag)::double from lineitem"]
        + [f"select 'histogram', '{c}', count({c})::double from lineitem" for c in LINEITEM_FEATURES]
        + [f"select 'correlation', column_a || ' ' || column_b, round(abs_corr, 6) from ({_PAIRS_SQL}) p"]
    )
)
def profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a full profile: nulls, zeros, rows of the top values and bins, correlations."""
    parts = profile.full_profile(audit_lineitem(spark, sf_dir).df)
    column = F.col("column").alias("item")
    rows = {
        "columns": parts["columns"].select(column, F.col("n_nulls").cast("double").alias("value")),
        "numeric": parts["numeric"].select(column, F.col("zeros").cast("double").alias("value")),
        "values": parts["values"].groupBy(column).agg(F.sum("n").cast("double").alias("value")),
        "histogram": parts["histogram"].groupBy(column).agg(F.sum("n").cast("double").alias("value")),
        "correlation": parts["correlation"].select(
            F.concat_ws(" ", "column_a", "column_b").alias("item"), F.round("abs_corr", 6).alias("value")
        ),
    }
    return reduce(DataFrame.unionByName, [r.select(F.lit(n).alias("part"), "item", "value") for n, r in rows.items()])


@query(
    """
    with long as (
      select 'l_quantity' as "column", l_returnflag, l_quantity as v from lineitem
      union all select 'l_extendedprice', l_returnflag, l_extendedprice from lineitem
      union all select 'l_discount', l_returnflag, l_discount from lineitem),
    wanted as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]) as p)
    select "column", p::double as p, count(*) as n, min(v)::double as low, max(v)::double as high, true as near from long, wanted group by all
    """
)
def sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each return flag, stored, merged and asked; ``near``: the true rank of every answer is within the error."""
    names, probabilities = ["l_quantity", "l_extendedprice", "l_discount"], [0.05, 0.25, 0.5, 0.75, 0.95]
    lines = table(spark, sf_dir, "lineitem")
    stored = materialize(quantile_sketches(lines, names, ["l_returnflag"]), "sketches")
    answers = sketch_quantiles(merged_sketches(stored), probabilities)
    asked = answers.select("column", "n", "low", "high", F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in probabilities]).alias("p"), F.col("quantiles").alias("q"))).alias("a"))
    asked = asked.select("column", "n", "low", "high", F.col("a.p").alias("p"), F.col("a.q").alias("q"))
    values = lines.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])).alias("e")).select("e.*")
    # Fifteen answers, so few that Spark may send them to the rows.
    ranked = values.join(asked, "column").groupBy("column", "p", "n", "low", "high").agg(
        F.count_if(F.col("v") < F.col("q")).alias("below"), F.count_if(F.col("v") <= F.col("q")).alias("upto")
    )
    slack = F.col("n") * 2 * rank_error()
    near = (F.col("below") - slack <= F.col("p") * F.col("n")) & (F.col("p") * F.col("n") <= F.col("upto") + slack)
    return ranked.select("column", "p", "n", "low", "high", near.alias("near"))

"""Queries of the report table and the end-to-end run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog import query
from tabaudit.catalog.evaluation import _BEST_SQL, _BOTH_SQL, BY_CHARS, BY_WORDS, SCORING, _cv_sql
from tabaudit.catalog.fixtures import dirty_orders, doc_quality
from tabaudit.operators.audit import eda_summary
from tabaudit.operators.report import report_table as build_report
from tabaudit.operators.search import compare, leaderboard
from tabaudit.plans.specs import CvPlan
from tabaudit.plans.workflow import DataPlan, RunPlan
from tabaudit.plans.workflow import run_all as run_plan

_REPORT_SQL = f"""
    {_cv_sql(_BOTH_SQL)},
    best as ({_BEST_SQL}),
    placed as (select *, cast(row_number() over (order by best_score desc, name) as int) as place from best),
    facts as (
      select count(*) as n,
             greatest(abs(corr(n_chars, n_words)), abs(corr(n_chars, mean_word)), abs(corr(n_words, mean_word))) as r,
             (select max(c) from (select count(*) as c from docs group by quality)) / count(*) as top,
             (select count(*) from docs)
               - (select count(*) from (select distinct n_chars, n_words, mean_word from docs)) as dup
      from docs)
    select 'shape' as section, 2 as position, 'n_samples' as key, cast(n as varchar) as value from facts
    union all select 'shape', 1, 'n_features', '3'
    union all select 'duplicates', 1, 'duplicates', cast(dup as varchar) from facts
    union all select 'features', 1, 'max_abs_corr_offdiag', printf('%.3f', r) from facts
    union all select 'features', 2, 'numeric_features', '3'
    union all select 'flags', 1, 'class_imbalance', case when top >= 0.8 then 'True' else 'False' end from facts
    union all select 'flags', 2, 'high_collinearity', case when r >= 0.95 then 'True' else 'False' end from facts
    union all select 'flags', 3, 'high_dimensional', case when n < 15 then 'True' else 'False' end from facts
    union all select 'flags', 4, 'needs_scaling', 'True'
    union all select 'results', place, name || '.best_score', printf('%.6f', best_score) from placed
    union all select 'results', place, name || '.params', best_params from placed
    union all select 'results', place, name || '.elapsed_sec', '0.0' from placed
"""


@query(_REPORT_SQL)
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit and comparison of the labelled documents; times are left out as 0."""
    data = doc_quality(spark, sf_dir)
    board = leaderboard(compare(data, [BY_CHARS, BY_WORDS], CvPlan.from_dict(SCORING)), spark)
    return build_report(spark, eda_summary(data), board.withColumn("elapsed_sec", F.lit(0.0)))


@query(
    """
    select stage, ok, n_samples from (values
      ('data', true), ('audit', true), ('compare', false), ('report', true)) t(stage, ok),
      (select count(*) as n_samples from orders)
    """
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric that does not exist fails the comparison, not the report after it."""
    plan = RunPlan(
        data=DataPlan(target_column="o_orderstatus"),
        cv={"cv_folds": 5, "scoring": "no_such_metric"},
        profile_minimal=True,
    )
    outcome = run_plan(spark, plan, raw=dirty_orders(spark, sf_dir))
    n = outcome.summary.filter(F.col("key") == "n_samples").first()["value"]
    return outcome.status_table(spark).select("stage", "ok", F.lit(int(n)).cast("long").alias("n_samples"))


@query(_REPORT_SQL)
def run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the labelled documents, down to the report; times are left out as 0."""
    plan = RunPlan(specs=[BY_CHARS, BY_WORDS], cv=SCORING)
    outcome = run_plan(spark, plan, data=doc_quality(spark, sf_dir))
    timed = F.col("key").endswith(".elapsed_sec")
    return outcome.report.withColumn("value", F.when(timed, F.lit("0.0")).otherwise(F.col("value")))

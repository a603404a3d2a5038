"""Queries of splitters, metrics and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog import query
from tabaudit.catalog.fixtures import (
    DOC_QUALITY_SQL,
    SCORED_SQL,
    doc_quality,
    emb_binary,
    rounded,
    scored_docs,
    table,
)
from tabaudit.operators import metrics, search, splits
from tabaudit.operators.prep import PrepSpec
from tabaudit.plans.specs import CvPlan, ModelSpec

# Document lengths around the 5, 50 and 95 % points.
CUTOFFS = (200, 500, 1000, 2000)
BY_CHARS = ModelSpec("by_chars", "threshold", {"column": "n_chars", "cutoff": list(CUTOFFS)})
BY_WORDS = ModelSpec("by_words", "threshold", {"column": "n_words", "cutoff": [50, 100]})
SCORING = {"cv_folds": 5, "scoring": ["f1", "balanced_accuracy", "average_precision"]}


@query(
    """
    with classes as (
      select quality, sum(count(*)) over (order by quality) - count(*) as start from labels group by quality),
    ranked as (
      select *, row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) as rn from labels)
    select doc_id, r.quality, cast((start + rn - 1) % 5 as int) as fold
    from ranked r join classes c on r.quality = c.quality
    """
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return splits.stratified_folds(labels, "quality", "doc_id")


@query(
    """
    with classes as (select l_returnflag, count(*) as n from lineitem group by l_returnflag),
    wanted as (select sum(n) as total, ceil(0.2 * sum(n)) as test from classes),
    exact as (select l_returnflag, n * test / total as e, test from classes, wanted),
    placed as (
      select *, test - sum(floor(e)) over () as missing,
             row_number() over (order by e - floor(e) desc, l_returnflag) as place from exact),
    quota as (select l_returnflag, floor(e) + case when place <= missing then 1 else 0 end as q from placed),
    keyed as (select l_orderkey * 10 + l_linenumber as line_id, l_returnflag from lineitem),
    ranked as (
      select *, row_number() over (partition by l_returnflag order by md5('42:' || line_id), line_id) as rn from keyed)
    select line_id, r.l_returnflag, rn <= q as is_test
    from ranked r join quota q on r.l_returnflag = q.l_returnflag
    """
)
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_returnflag"
    )
    return splits.stratified_holdout(lines, "l_returnflag", "line_id")


@query(
    """
    with sizes as (select user_id, count(*) as n from events group by user_id),
    ranked as (select *, row_number() over (order by n desc, md5('42:' || user_id), user_id) as rn from sizes)
    select event_id, e.user_id, cast((rn - 1) % 5 as int) as fold
    from events e join ranked r on e.user_id = r.user_id
    """
)
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return splits.group_folds(events, "user_id")


@query(
    """
    with recursive sizes as (
      select l_suppkey as g, count(*) as n, md5('42:' || l_suppkey) as mark from lineitem group by l_suppkey),
    whole as (select sum(n) as total from sizes),
    large as (
      select g, n, row_number() over (order by n desc, mark, g) as place from sizes, whole where n * 100 > total),
    placed(place, g, n, fold, loads) as (
      select 0::bigint, null::bigint, 0::bigint, 0, [0, 0, 0, 0, 0]::bigint[]
      union all
      select l.place, l.g, l.n, list_position(p.loads, list_min(p.loads)) - 1,
             list_transform(p.loads, lambda x, i: case when i = list_position(p.loads, list_min(p.loads)) then x + l.n else x end)
      from placed p join large l on l.place = p.place + 1),
    final as (select loads from placed order by place desc limit 1),
    folds as (select i as fold, loads[i + 1] as load from final, (select unnest(range(5)) as i)),
    rest as (select coalesce(sum(n), 0) as rows from sizes, whole where n * 100 <= total),
    level as (
      select min((rows + filled) / k::double) as level
      from (select row_number() over (order by load) as k, sum(load) over (order by load rows unbounded preceding) as filled from folds), rest),
    ends as (
      select fold, floor(sum(greatest(level - load, 0.0)) over (order by fold) + 1e-6) as upto from folds, level),
    small as (
      select g, sum(n) over (order by mark, g) - n as first from sizes, whole where n * 100 <= total),
    table_ as (
      select g, fold from placed where place > 0
      union all
      select g, (select count(*) from ends where fold < 4 and upto <= first) from small)
    select l_orderkey, l_linenumber, l_suppkey, cast(fold as int) as fold from lineitem join table_ on g = l_suppkey
    """
)
def balanced_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as groups: the larger ones one by one, the others along a line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return splits.balanced_group_folds(lines, "l_suppkey")


@query(
    """
    select event_id, cast(ntile(6) over (order by ts, md5('42:' || event_id), event_id) - 1 as int) as block
    from events
    """
)
def time_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", micros.alias("at"))
    return splits.time_blocks(events, "at", "event_id").select("event_id", "block")


# -- metrics ----------------------------------------------------------------------------

_CELLS_SQL = f"""
    with {SCORED_SQL},
    cells as (
      select count(*) filter (where label = 1 and prediction = 1) as tp,
             count(*) filter (where label = 0 and prediction = 1) as fp,
             count(*) filter (where label = 1 and prediction = 0) as fn,
             count(*) filter (where label = 0 and prediction = 0) as tn
      from scored)
"""


# Three classes: the flag of a line item, guessed from quantity and line number.
_GUESS_SQL = """
    guessed as (
      select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label,
             case when l_quantity > 25 then 1 when l_linenumber % 3 = 0 then 2 else 0 end as prediction
      from lineitem)
"""


@query(
    f"""
    with {_GUESS_SQL},
    sides as (
      select label as c, cast(label = prediction as int) as hit from guessed
      union all select prediction, cast(label = prediction as int) from guessed),
    classes as (select c, sum(hit)::double / count(*) as f1 from sides group by c)
    select round(avg(f1), 6) as value from classes
    """
)
def metric_f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    scored = table(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("label"),
        F.when(F.col("l_quantity") > 25, 1)
        .when(F.col("l_linenumber") % 3 == 0, 2)
        .otherwise(0)
        .alias("prediction"),
    )
    return rounded(metrics.f1_macro(scored), 6, "value")


@query(f"{_CELLS_SQL} select round(2.0::double * tp / (2 * tp + fp + fn), 6) as value from cells")
def metric_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.f1(scored_docs(spark, sf_dir)), 6, "value")


@query(
    f"""
    {_CELLS_SQL}
    select round((tp::double / (tp + fn) + tn::double / (tn + fp)) / 2, 6) as value from cells
    """
)
def metric_balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.balanced_accuracy(scored_docs(spark, sf_dir)), 6, "value")


_CURVE_SQL = f"""
    with {SCORED_SQL},
    by_score as (select score, sum(label) as pos, count(*) as n from scored group by score),
    running as (
      select score, pos, n, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as seen,
             sum(pos) over () as p from by_score)
"""


@query(f"{_CURVE_SQL} select round(sum(pos / p * (tp / seen)), 6) as value from running")
def metric_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(scored_docs(spark, sf_dir)), 6, "value")


def _specificity(label: Column, prediction: Column, n: Column) -> Column:
    right = F.sum(F.when((label == 0) & (prediction == 0), n).otherwise(0))
    return F.try_divide(right.cast("double"), F.sum(F.when(label == 0, n).otherwise(0)))


@query(f"{_CELLS_SQL} select round(tn::double / (tn + fp), 6) as value from cells")
def custom_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric that a user defines over the confusion table: specificity."""
    return rounded(metrics.custom(_specificity)(scored_docs(spark, sf_dir)), 6, "value")


@query(
    f"""
    {_CURVE_SQL}
    select round(score, 6) as score, round(tp / seen, 6) as precision, round(tp / p, 6) as recall,
           round((pos / p) * (tp / seen + coalesce((tp - pos) / nullif(seen - n, 0), 1)) / 2, 8) as area
    from running
    """
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.pr_curve(scored_docs(spark, sf_dir))
    return rounded(rounded(curve, 6, "score", "precision", "recall"), 8, "area")


@query(
    f"""
    with {SCORED_SQL}
    select cast(least(floor(score * 10), 9) as int) as bin, round(avg(score), 6) as mean_score,
           round(avg(label), 6) as positive_share, count(*) as n
    from scored group by 1
    """
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration(scored_docs(spark, sf_dir)), 6, "mean_score", "positive_share")


# -- comparison -------------------------------------------------------------------------


def _cv_sql(rules: str) -> str:
    """Cross-validated scores of threshold rules ``(name, cand_id, x, cutoff)``."""
    return f"""
    with {DOC_QUALITY_SQL},
    classes as (
      select quality, sum(count(*)) over (order by quality) - count(*) as start from docs group by quality),
    folded as (
      select d.*, cast((start + rn - 1) % 5 as int) as fold
      from (select *, row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) as rn from docs) d
      join classes c on d.quality = c.quality),
    rules as ({rules}),
    scored as (
      select name, cand_id, fold, quality as label, case when x > cutoff then 1 else 0 end as prediction, x as score
      from rules),
    cells as (
      select name, cand_id, fold, count(*) filter (where label = 1 and prediction = 1)::double as tp,
             count(*) filter (where label = 0 and prediction = 1)::double as fp,
             count(*) filter (where label = 1 and prediction = 0)::double as fn,
             count(*) filter (where label = 0 and prediction = 0)::double as tn
      from scored group by all),
    by_score as (
      select name, cand_id, fold, score, sum(label)::double as pos, count(*)::double as n from scored group by all),
    running as (
      select *, sum(pos) over w as tp, sum(n) over w as seen, sum(pos) over (partition by name, cand_id, fold) as p
      from by_score window w as (partition by name, cand_id, fold order by score desc)),
    fold_scores as (
      select name, cand_id, fold, 'f1' as metric, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as value from cells
      union all
      select name, cand_id, fold, 'balanced_accuracy', (tp / (tp + fn) + tn / (tn + fp)) / 2 from cells
      union all
      select name, cand_id, fold, 'average_precision', sum(pos / p * (tp / seen)) from running group by name, cand_id, fold),
    summary as (
      select name, cand_id, metric, avg(value) as mean, stddev_pop(value) as std
      from fold_scores group by name, cand_id, metric),
    ranking as (
      select *, cast(rank() over (partition by name, metric order by round(mean, 12) desc) as int) as rank from summary)
    """


def _rule_sql(name: str, column: str, cutoffs: tuple[int, ...]) -> str:
    values = ", ".join(f"({i}, {c})" for i, c in enumerate(cutoffs))
    return (
        f"select '{name}' as name, cand_id, fold, quality, {column} as x, cutoff"
        f" from folded, (values {values}) t(cand_id, cutoff)"
    )


_CHARS_SQL = _rule_sql("by_chars", "n_chars", CUTOFFS)
_BOTH_SQL = f"{_CHARS_SQL} union all {_rule_sql('by_words', 'n_words', (50, 100))}"
_BEST_SQL = """
    select name, '{"estimator__column":"' || case name when 'by_chars' then 'n_chars' else 'n_words' end
             || '","estimator__cutoff":"' || cutoff || '"}' as best_params,
           round(mean, 6) as best_score, metric as refit_metric
    from (select r.*, c.cutoff, row_number() over (partition by r.name order by rank, r.cand_id) as place
          from ranking r join (select distinct name, cand_id, cutoff from rules) c
            on c.name = r.name and c.cand_id = r.cand_id
          where metric = 'f1')
    where place = 1
"""


@query(
    f"""
    {_cv_sql(_CHARS_SQL)}
    select cand_id, metric, round(mean, 6) as mean, round(std, 6) as std, rank from ranking
    """
)
def grid_search_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates, folds and metrics with a rule that SQL can replay."""
    found = search.grid_search(doc_quality(spark, sf_dir), BY_CHARS, CvPlan.from_dict(SCORING))
    return rounded(found.ranking, 6, "mean", "std")


@query(f"{_cv_sql(_CHARS_SQL)} {_BEST_SQL}")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.grid_search(doc_quality(spark, sf_dir), BY_CHARS, CvPlan.from_dict(SCORING))
    return _best_columns(search.best_rows([found], spark))


@query(f"{_cv_sql(_BOTH_SQL)} {_BEST_SQL}")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.compare(doc_quality(spark, sf_dir), [BY_CHARS, BY_WORDS], CvPlan.from_dict(SCORING))
    return _best_columns(search.leaderboard(found, spark))


def _best_columns(best: DataFrame) -> DataFrame:
    return best.select(
        "name", F.to_json("best_params").alias("best_params"), F.round("best_score", 6).alias("best_score"), "refit_metric"
    )


@query()
def cv_linear_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impute, scale, select, reduce and fit a linear machine on each of three folds, all fits together."""
    spec = ModelSpec(
        "linear_pca_svc",
        "svc",
        {"kernel": "linear", "C": [0.1, 1]},
        PrepSpec(imputer="simple", scaler="standard", select_k_best=32),
        "pca",
        {"n_components": [0.8]},
    )
    scoring = {"cv_folds": 3, "scoring": SCORING["scoring"]}
    return search.grid_search(emb_binary(spark, sf_dir), spec, CvPlan.from_dict(scoring), refit=False).ranking


@query()
def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of three random chains, halved over rungs, and the holdout score of the best one."""
    found = search.model_search(emb_binary(spark, sf_dir), max_candidates=3, cv=CvPlan(folds=2))
    winner = F.when((F.col("name") == found.best.name) & (F.col("share") == 1.0), F.lit(found.holdout_score))
    return found.rungs.withColumn("holdout_score", winner)


# Rules that halve in three rungs, each on a hash sample three times as large as the one before.
HALVED_CUTOFFS = (50, 200, 350, 500, 700, 1000, 1400, 2000, 4000)


def _rung_sql() -> str:
    """Rung by rung: the mean F1 over the folds of the sample, places, and who goes on."""
    values = ", ".join(f"({i}, {c})" for i, c in enumerate(HALVED_CUTOFFS))
    parts = []
    for rung, (share, kept) in enumerate(((1 / 9, 3), (1 / 3, 1), (1.0, 0))):
        alive = "rules" if rung == 0 else f"(select c.* from rules c join rung{rung - 1} r on r.cand_id = c.cand_id and r.promoted)"
        parts.append(f"""
    sample{rung} as (select * from folded where cast('0x' || substr(md5('43:' || doc_id), 1, 8) as bigint) < {int(share * 2**32)}),
    rung{rung} as (
      select {rung} as rung, {share!r}::double as share, (select count(*) from sample{rung}) as n_rows, cand_id, score, place, place <= {kept} as promoted
      from (select *, cast(row_number() over (order by round(score, 12) desc, cand_id) as int) as place
            from (select cand_id, avg(f1) as score
                  from (select c.cand_id, s.fold,
                               coalesce(2 * sum(cast(quality = 1 and n_chars > cutoff as int))
                                 / nullif(sum(cast(quality = 1 as int)) + sum(cast(n_chars > cutoff as int)), 0)::double, 0) as f1
                        from sample{rung} s, {alive} c group by c.cand_id, s.fold)
                  group by cand_id)))""")
    return f"""
    with {DOC_QUALITY_SQL},
    classes as (
      select quality, sum(count(*)) over (order by quality) - count(*) as start from docs group by quality),
    folded as (
      select d.*, cast((start + rn - 1) % 3 as int) as fold
      from (select *, row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) as rn from docs) d
      join classes c on d.quality = c.quality),
    rules as (select * from (values {values}) t(cand_id, cutoff)), {",".join(parts)}
    select rung, round(share, 6) as share, n_rows, cand_id, round(score, 6) as score, place, promoted
    from (select * from rung0 union all select * from rung1 union all select * from rung2)
    """


@query(_rung_sql())
def halving_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine rules on a ninth of the documents, three on a third, one on all; every score of every rung."""
    spec = ModelSpec("by_chars", "threshold", {"column": "n_chars", "cutoff": list(HALVED_CUTOFFS)})
    cv = CvPlan(folds=3)
    rows, features, n_classes = search.labelled(doc_quality(spark, sf_dir))
    found = search.successive_halving(search.fold_table(rows, cv), features, n_classes, [spec], cv, least_rows=1)
    return rounded(found.rungs.drop("name"), 6, "share", "score")

"""Grid search with cross-validation, comparison of specs, and a budgeted search."""

from __future__ import annotations

import random
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from itertools import product
from typing import Any

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.dataset import Dataset
from tabaudit.functions.columns import col, missing_to_null, numeric_columns, order_hash
from tabaudit.functions.storage import materialize
from tabaudit.operators import block_linear, sampling
from tabaudit.operators.metrics import METRICS, check_classes, score_all
from tabaudit.operators.models import (
    DEFAULT_C,
    DEFAULT_KERNEL,
    FOURIER,
    FOURIER_FEATURES,
    SVC,
    THRESHOLD,
    check_params,
    fit_classifier,
    fourier_weights,
    kernel_width,
    positive_score,
    threshold_prediction,
)
from tabaudit.operators.prep import (
    MAX_CLASSES,
    FittedPrep,
    PrepSpec,
    PrepStatistics,
    centred,
    components_kept,
    fit_pca,
)
from tabaudit.operators.smote import smote
from tabaudit.operators.splits import stratified_folds, stratified_holdout
from tabaudit.plans.specs import AutoSpec, Candidate, CvPlan, ModelSpec
from tabaudit.sources.tables import write_artifact

# Fits that run at once while a training set has at most SMALL_VALUES doubles.  A
# larger one keeps the cluster busy alone, and its fits cache it one after another.
PARALLEL_FITS = 8
SMALL_VALUES = 50_000_000
# Doubles that one training task should hold at least; fewer tasks mean less
# waiting in each of the many short jobs of an optimiser.
TASK_VALUES = 2_000_000
RANK_DIGITS = 12

_KEY, _LABEL, _FOLD, _VECTOR, _FEATURES = "__key", "label", "fold", "__vector", "features"


@dataclass(frozen=True)
class SearchResult:
    """Outcome of one spec: fold scores, ranking table, best candidate and its refit."""

    name: str
    candidates: Sequence[Candidate]
    cv_scores: DataFrame
    ranking: DataFrame
    best: Candidate
    best_score: float
    refit_metric: str
    elapsed_sec: float
    model: PipelineModel | None
    cv_results_path: str | None = None


# -- labels and folds -------------------------------------------------------------------


def labelled(data: Dataset) -> tuple[DataFrame, list[str], int]:
    """Frame ``(key, label, features)``, feature names and class count.

    The needed columns are written once, as all later steps read them.  Labels 0
    and 1 stay; other targets become their position among the sorted values.  A
    feature that is not numeric and a null target are errors, as no classifier takes
    either.
    """
    data = data.keyed()
    features = numeric_columns(data.df, data.features)
    other = [c for c in data.features if c not in set(features)]
    if other:
        raise ValueError(f"features must be numeric: {', '.join(other)}")
    chosen = [col(data.key).alias(_KEY), col(data.target).alias(_LABEL), *[col(c) for c in features]]
    rows = materialize(missing_to_null(data.df).select(*chosen), "labelled")
    found = [r[0] for r in rows.select(_LABEL).distinct().limit(MAX_CLASSES + 1).collect()]
    if None in found:
        raise ValueError(f"missing values in {data.target}")
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{data.target} has more than {MAX_CLASSES} classes")
    if set(found) <= {0, 1}:
        return rows.withColumn(_LABEL, F.col(_LABEL).cast("double")), features, 2
    position = F.lit(None).cast("double")
    for i, value in enumerate(sorted(found)):
        position = F.when(F.col(_LABEL) == F.lit(value), F.lit(float(i))).otherwise(position)
    return rows.withColumn(_LABEL, position), features, len(found)


def fold_table(rows: DataFrame, cv: CvPlan) -> DataFrame:
    """The labelled rows with a fold, written once and partitioned by fold.

    Training reads all partitions but one and scoring reads only that one.
    """
    return materialize(stratified_folds(rows, _LABEL, _KEY, cv.folds, cv.seed, _FOLD), "folds", [_FOLD])


# -- fitting ----------------------------------------------------------------------------


def _sampled(
    spec: ModelSpec, train: DataFrame, vector: str, seed: int
) -> tuple[DataFrame, int | None]:
    """Balance training rows ``(key, label, vector)``; the row count if it changed."""
    if spec.sampler is None:
        return train, None
    if spec.sampler == "under":
        balanced = sampling.undersample(train, _LABEL, _KEY, seed)
    elif spec.sampler == "over":
        balanced = sampling.oversample(train, _LABEL, _KEY, seed).drop("copy")
    else:
        balanced = smote(train, _LABEL, _KEY, vector, seed)
    balanced = materialize(balanced, "sampled")
    return balanced, balanced.count()


@dataclass(frozen=True)
class _FittedFold:
    """Shared preparation and the fitted tail of each candidate."""

    shared: PipelineModel
    tails: Sequence[tuple[Candidate, PipelineModel]]

    def full(self, position: int = 0) -> PipelineModel:
        return PipelineModel([*self.shared.stages, *self.tails[position][1].stages])


def _is_small(n_rows: int, width: int) -> bool:
    return n_rows * width <= SMALL_VALUES


def _fit_fold(
    spec: ModelSpec,
    candidates: Sequence[Candidate],
    prep: FittedPrep,
    train: DataFrame,
    n_classes: int,
    seed: int,
    pool: ThreadPoolExecutor,
) -> _FittedFold:
    """Fit all candidates on one training set; they share its preparation."""
    if spec.reduction == "pca":
        prep = centred(prep, train)
    stages = prep.stages(_VECTOR)
    width, vector = len(prep.features), _VECTOR
    rows = PipelineModel(stages).transform(train).select(_KEY, _LABEL, vector)
    kept: dict[int, int] = {}
    if spec.reduction == "pca":
        vector = "__components"
        model = fit_pca(rows, _VECTOR, vector, width)
        stages.append(model)
        rows = model.transform(rows).select(_KEY, _LABEL, vector)
        explained = model.explainedVariance.toArray()
        for c in candidates:
            kept[c.cand_id] = components_kept(explained, c.step("reduction").get("n_components"))
    rows, resampled = _sampled(spec, rows, vector, seed)
    n_rows = prep.n_rows if resampled is None else resampled
    rows = rows.coalesce(n_rows * width // TASK_VALUES + 1)

    def fit(candidate: Candidate) -> tuple[Candidate, PipelineModel]:
        size = kept.get(candidate.cand_id, width)
        cut = VectorSlicer(inputCol=vector, outputCol=_FEATURES, indices=list(range(size)))
        fitted = fit_classifier(
            spec.estimator,
            candidate.step("estimator"),
            cut.transform(rows).select(_LABEL, _FEATURES),
            n_rows,
            size,
            seed,
            _FEATURES,
            _LABEL,
            n_classes,
        )
        return candidate, PipelineModel([cut, *fitted.stages])

    shared = PipelineModel(stages)
    if not _is_small(n_rows, width):
        return _FittedFold(shared, [fit(c) for c in candidates])
    rows = rows.persist()
    try:
        return _FittedFold(shared, list(pool.map(fit, candidates)))
    finally:
        rows.unpersist()


def _scored_candidates(
    spec: ModelSpec, fitted: _FittedFold, test: DataFrame, n_classes: int
) -> DataFrame:
    """Rows ``(cand_id, label, prediction, score)`` of all candidates on one test set."""
    prepared = fitted.shared.transform(test)
    parts = []
    for candidate, tail in fitted.tails:
        score = F.lit(None).cast("double") if n_classes > 2 else positive_score(spec.estimator)
        parts.append(
            tail.transform(prepared).select(
                F.lit(candidate.cand_id).alias("cand_id"), _LABEL, "prediction", score.alias("score")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _threshold_scores(spec: ModelSpec, candidates: Sequence[Candidate], rows: DataFrame) -> DataFrame:
    """The threshold rule needs no fit: all candidates are scored in one projection."""
    scored = []
    for c in candidates:
        p = c.step("estimator")
        value = col(p["column"]).cast("double")
        scored.append(
            F.struct(
                F.lit(c.cand_id).alias("cand_id"),
                threshold_prediction(value, F.lit(float(p["cutoff"]))).alias("prediction"),
                value.alias("score"),
            )
        )
    return rows.select(_FOLD, _LABEL, F.explode(F.array(*scored)).alias("s")).select(
        _FOLD, _LABEL, "s.cand_id", "s.prediction", "s.score"
    )


def _is_block_fit(spec: ModelSpec, candidates: Sequence[Candidate]) -> bool:
    """Machines on unsampled rows are fitted together; samplers change the rows of each training set."""
    if spec.estimator != SVC or spec.sampler is not None:
        return False
    steps = [c.step("estimator") for c in candidates]
    return all(s.get("kernel", DEFAULT_KERNEL) in ("linear", "rbf") and s.get("approximation", FOURIER) == FOURIER for s in steps)


def _block_scores(
    spec: ModelSpec,
    candidates: Sequence[Candidate],
    folded: DataFrame,
    preps: Mapping[int | None, FittedPrep],
    features: Sequence[str],
    n_classes: int,
    cv: CvPlan,
) -> DataFrame:
    """Rows ``(cand_id, fold, label, prediction, score)`` of machines; scans do not grow with candidates or folds."""
    for c in candidates:
        check_params(spec.estimator, c.step("estimator"))
    if spec.prep.imputer is None:
        used = sorted({c for i in range(cv.folds) for c in preps[i].features})
        holes = reduce(lambda a, b: a | b, [col(c).isNull() for c in used], F.lit(False))
        if folded.where(holes).limit(1).count():
            raise ValueError("missing values need an imputer")
    n_rows = sum(preps[i].n_rows for i in range(cv.folds)) // max(cv.folds - 1, 1)
    rows = folded.coalesce(n_rows * max(len(features), 1) // TASK_VALUES + 1)
    blocks = block_linear.pack(rows, features, _LABEL, _FOLD)
    views = [block_linear.Prepared.of(preps[i], i, features) for i in range(cv.folds)]
    sizes = {(c.cand_id, i): v.width for c in candidates for i, v in enumerate(views)}
    if spec.reduction == "pca":
        counts = [c.step("reduction").get("n_components") for c in candidates]
        if all(isinstance(n, int) and not isinstance(n, bool) for n in counts):
            # Numbers of components are found without a covariance of all columns.
            found = [(a.axes, a.variances) for a in block_linear.leading_rotations(blocks, views, max(counts), seed=cv.seed)]
        else:
            found = block_linear.rotations(blocks, views)
        # Components are not centred without a scaler, which moves intercepts and phases only.
        views = [replace(v, rotation=axes) for v, (axes, _) in zip(views, found)]
        extents = [e for _, e in found]
        for c in candidates:
            for i, variance in enumerate(extents):
                shares = variance / variance.sum() if variance.sum() > 0 else variance
                sizes[c.cand_id, i] = components_kept(shares, c.step("reduction").get("n_components"))
    variances: list[dict[int, float]] = []
    if any(c.step("estimator").get("kernel", DEFAULT_KERNEL) == "rbf" and c.step("estimator").get("gamma", "scale") in (None, "scale") for c in candidates):
        if spec.reduction == "pca":
            # Components are centred, so the variance of the first ones is the mean of theirs.
            variances = [{k + 1: v for k, v in enumerate(np.cumsum(sizes_) / np.arange(1, len(sizes_) + 1))} for sizes_ in extents]
        else:
            variances = [{views[i].width: v} for i, v in enumerate(block_linear.spreads(blocks, views))]
    positives = [1.0] if n_classes <= 2 else [float(i) for i in range(n_classes)]
    lifts: dict[tuple[int, int, float], block_linear.Lift] = {}

    def lift(candidate: Candidate, fold: int) -> block_linear.Lift | None:
        params, size = candidate.step("estimator"), sizes[candidate.cand_id, fold]
        if params.get("kernel", DEFAULT_KERNEL) == "linear":
            return None
        asked = params.get("gamma", "scale")
        gamma = kernel_width(asked, size, variances[fold][size] if asked in (None, "scale") else 0.0)
        key = (fold, size, gamma)
        if key not in lifts:
            lifts[key] = block_linear.Lift(*fourier_weights(size, FOURIER_FEATURES, gamma, cv.seed))
        return lifts[key]

    fits = []
    for c in candidates:
        for i, v in enumerate(views):
            lifted = lift(c, i)
            width = sizes[c.cand_id, i] if lifted is None else FOURIER_FEATURES
            ridge = 1.0 / (float(c.step("estimator").get("C", DEFAULT_C)) * max(v.n_rows, 1))
            fits += [block_linear.Fit(c.cand_id, v, width, ridge, positive, lifted) for positive in positives]
    machines = block_linear.fit_machines(blocks, fits)
    return block_linear.score_held_out(blocks, machines, positives if n_classes > 2 else [0.0, 1.0])


# -- search -----------------------------------------------------------------------------


def cross_validate(
    spec: ModelSpec,
    candidates: Sequence[Candidate],
    folded: DataFrame,
    statistics: PrepStatistics,
    n_classes: int,
    cv: CvPlan,
) -> DataFrame:
    """Rows ``(cand_id, fold, metric, value)``, each fit on all folds but the scored one."""
    check_classes(cv.metrics, n_classes)
    if spec.estimator == THRESHOLD:
        scored = _threshold_scores(spec, candidates, folded)
    elif _is_block_fit(spec, candidates):
        scored = _block_scores(spec, candidates, folded, statistics.fit(spec.prep), statistics.features, n_classes, cv)
    else:
        preps = statistics.fit(spec.prep)

        def fold_scores(i: int) -> DataFrame:
            train, test = folded.filter(F.col(_FOLD) != i), folded.filter(F.col(_FOLD) == i)
            fitted = _fit_fold(spec, candidates, preps[i], train, n_classes, cv.seed, pool)
            return _scored_candidates(spec, fitted, test, n_classes).withColumn(_FOLD, F.lit(i))

        # Folds wait for their fits in threads of their own, so the pool cannot block.
        at_once = cv.folds if _is_small(preps[0].n_rows, len(statistics.features)) else 1
        with ThreadPoolExecutor(PARALLEL_FITS) as pool, ThreadPoolExecutor(at_once) as waiting:
            scored = reduce(DataFrame.unionByName, waiting.map(fold_scores, range(cv.folds)))
    # Every metric reads the scores, and the models would run again for each.
    scored = materialize(scored, "scores")
    return score_all(scored, cv.metrics, ["cand_id", _FOLD])


def rank_candidates(cv_scores: DataFrame) -> DataFrame:
    """Rows ``(cand_id, metric, mean, std, rank)``: population deviation, rank 1 is best.

    Means that differ only by the order of summation share a rank.
    """
    summary = cv_scores.groupBy("cand_id", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    best_first = Window.partitionBy("metric").orderBy(F.desc(F.round("mean", RANK_DIGITS)))
    return summary.withColumn("rank", F.rank().over(best_first))


def pivoted_results(result: SearchResult) -> DataFrame:
    """One row per candidate with its parameters, all scores and those of each fold, for export."""
    params = [(c.cand_id, c.as_text()) for c in result.candidates]
    names = result.ranking.sparkSession.createDataFrame(params, "cand_id int, params map<string,string>")
    scores = result.ranking.groupBy("cand_id").pivot("metric").agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("rank").alias("rank")
    )
    place = F.concat(F.lit("split"), F.col(_FOLD).cast("string"), F.lit("_"), F.col("metric"))
    folds = result.cv_scores.withColumn("place", place).groupBy("cand_id").pivot("place").agg(F.first("value"))
    return names.join(scores, "cand_id").join(folds, "cand_id").withColumn("params", F.to_json("params"))


def grid_search(data: Dataset, spec: ModelSpec, cv: CvPlan, refit: bool = True) -> SearchResult:
    """Score every candidate on every fold, pick the best and fit it on all rows."""
    return compare(data, [spec], cv, refit)[0]


def fold_statistics(folded: DataFrame, features: Sequence[str], cv: CvPlan) -> PrepStatistics:
    """Statistics of each training set and of all rows, shared by every spec."""
    return PrepStatistics(folded, features, _LABEL, _FOLD, [*range(cv.folds), None])


def _search(
    folded: DataFrame,
    statistics: PrepStatistics,
    n_classes: int,
    spec: ModelSpec,
    candidates: Sequence[Candidate],
    cv: CvPlan,
    refit: bool,
) -> SearchResult:
    start = time.time()
    # Candidates x folds x metrics rows: small, and read by all that follows.
    scores = cross_validate(spec, candidates, folded, statistics, n_classes, cv)
    cv_scores = materialize(scores.coalesce(1), "cv")
    ranking = rank_candidates(cv_scores)
    best = ranking.filter(F.col("metric") == cv.refit).orderBy("rank", "cand_id").first()
    winner = next(c for c in candidates if c.cand_id == best["cand_id"])
    model = None
    if refit and spec.estimator != THRESHOLD:
        model = refit_on_all(spec, winner, folded, statistics, n_classes, cv.seed).full()
    elapsed = time.time() - start
    return SearchResult(
        spec.name, candidates, cv_scores, ranking, winner, best["mean"], cv.refit, elapsed, model
    )


def refit_on_all(
    spec: ModelSpec,
    winner: Candidate,
    rows: DataFrame,
    statistics: PrepStatistics,
    n_classes: int,
    seed: int,
) -> _FittedFold:
    prep = statistics.fit(spec.prep)[None]
    with ThreadPoolExecutor(1) as pool:
        return _fit_fold(spec, [winner], prep, rows, n_classes, seed, pool)


# -- comparison -------------------------------------------------------------------------

BEST_SCHEMA = (
    "name string, best_params map<string,string>, best_score double, refit_metric string, elapsed_sec double,"
    " cv_results_path string"
)


def best_rows(results: Sequence[SearchResult], spark: Any) -> DataFrame:
    rows = [(r.name, r.best.as_text(), r.best_score, r.refit_metric, r.elapsed_sec, r.cv_results_path) for r in results]
    by_name = F.map_from_entries(F.array_sort(F.map_entries("best_params")))
    return spark.createDataFrame(rows, BEST_SCHEMA).withColumn("best_params", by_name)


def compare(
    data: Dataset,
    specs: Sequence[ModelSpec | AutoSpec],
    cv: CvPlan,
    refit: bool = True,
    enabled: bool = True,
    out_dir: str | None = None,
    now: datetime | None = None,
) -> list[SearchResult]:
    """Search each spec on the same folds; nothing when disabled.

    An ``AutoSpec`` runs the budgeted search instead, and its score is that of the holdout.  With ``out_dir`` the
    table of each spec's candidates is written there and the result names its path.
    """
    if not enabled or not specs:
        return []
    results = []
    declared = [s for s in specs if isinstance(s, ModelSpec)]
    if declared:
        rows, features, n_classes = labelled(data)
        folded = fold_table(rows, cv)
        statistics = fold_statistics(folded, features, cv)
    for spec in specs:
        if isinstance(spec, ModelSpec):
            found = _search(folded, statistics, n_classes, spec, spec.candidates(), cv, refit)
        else:
            found = automated(data, spec, cv.seed, out_dir)
        if out_dir is not None:
            path = write_artifact(pivoted_results(found), out_dir, f"cv_{found.name}", ".csv", now)
            found = replace(found, cv_results_path=path)
        results.append(found)
    return results


def leaderboard(results: Sequence[SearchResult], spark: Any) -> DataFrame:
    return best_rows(results, spark).orderBy(F.desc("best_score"), "name")


# -- budgeted search --------------------------------------------------------------------

# The space of the budgeted search.
SEARCH_SPACE: tuple[tuple[str, Mapping[str, Sequence[Any]]], ...] = (
    (SVC, {"kernel": ["linear"], "C": [0.01, 0.1, 1.0, 10.0]}),
    (SVC, {"kernel": ["rbf"], "C": [0.1, 1.0, 10.0], "gamma": ["scale"]}),
    ("random_forest", {"n_estimators": [20, 50, 100], "max_depth": [5, 10]}),
)
SELECTIONS: tuple[Mapping[str, Any], ...] = ({}, {"select_percentile": 50}, {"select_percentile": 75})
PCA_RATIOS = (0.8, 0.9, 0.95)
# Of the candidates of a rung one in HALVING goes on, with HALVING times as many rows.
HALVING = 3
# Rows that the first rung should hold at least, for each fold and class.
RUNG_ROWS = 20


def _chains() -> list[dict[str, Any]]:
    """Every chain of the search space once."""
    found = []
    for estimator, space in SEARCH_SPACE:
        reductions = [None, *PCA_RATIOS] if estimator == SVC else [None]
        for values, selection, ratio in product(product(*space.values()), SELECTIONS, reductions):
            found.append({"estimator": estimator, "params": dict(zip(space, values)), "selection": selection, "ratio": ratio})
    return found


def random_specs(count: int, seed: int) -> list[ModelSpec]:
    """Chains in a seeded order, each with one parameter combination and none twice; at most all there are."""
    chains = _chains()
    specs = []
    for i, c in enumerate(random.Random(seed).sample(chains, min(count, len(chains)))):
        specs.append(
            ModelSpec(
                name=f"candidate_{i}",
                estimator=c["estimator"],
                params=c["params"],
                prep=PrepSpec(imputer="simple", scaler="standard", **c["selection"]),
                reduction=None if c["ratio"] is None else "pca",
                reduction_params={} if c["ratio"] is None else {"n_components": c["ratio"]},
            )
        )
    return specs


@dataclass(frozen=True)
class Halving:
    """Outcome of successive halving: the scores of every rung, and of the last one the results, best first, share and statistics."""

    rungs: DataFrame
    results: list[tuple[ModelSpec, SearchResult]]
    statistics: PrepStatistics
    share: float


RUNG_SCHEMA = "rung int, share double, n_rows long, name string, cand_id int, score double, place int, promoted boolean"


def rung_shares(candidates: int, n_rows: int, least_rows: int, factor: int = HALVING) -> list[float]:
    """Shares of the rows, rung by rung: all rows at last, as many rungs as candidates and rows allow."""
    rungs = 1
    while factor**rungs <= candidates and n_rows >= least_rows * factor**rungs:
        rungs += 1
    return [1.0 / factor ** (rungs - 1 - r) for r in range(rungs)]


def in_share(key: str, seed: int, share: float) -> Column:
    """Whether a row belongs to the hash sample of this share; larger samples hold the smaller ones.

    The hash is another one than that of folds and holdout, which would leave the first rows out.
    """
    return F.conv(F.substring(order_hash(key, seed + 1), 1, 8), 16, 10).cast("long") < F.lit(int(share * 2**32))


def successive_halving(
    folded: DataFrame,
    features: Sequence[str],
    n_classes: int,
    specs: Sequence[ModelSpec],
    cv: CvPlan,
    factor: int = HALVING,
    least_rows: int | None = None,
    deadline: float | None = None,
) -> Halving:
    """Cross-validate all candidates of ``specs`` on a small hash sample, the best on a larger one, and so on.

    A rung keeps the best ``ceil(n / factor)`` candidates by the refit metric (of equal ones the first) and the next
    has ``factor`` times the rows; the last one has all.  Rows keep their fold in every sample.  The
    clock is read between specs: when ``deadline`` has passed, the rung is finished with what was scored so far, and
    at least one spec is always scored.
    """
    spark = folded.sparkSession
    entries = [(spec, c) for spec in specs for c in spec.candidates()]
    n_rows = folded.count()
    shares = rung_shares(len(entries), n_rows, least_rows or RUNG_ROWS * cv.folds * n_classes, factor)
    rows, results, late = [], [], False
    for rung, share in enumerate(shares):
        sample = folded if share == 1.0 else materialize(folded.where(in_share(_KEY, cv.seed, share)), "rung", [_FOLD])
        statistics = fold_statistics(sample, features, cv)
        size = n_rows if share == 1.0 else sample.count()
        scored: list[tuple[float, int, ModelSpec, Candidate]] = []
        found: dict[str, SearchResult] = {}
        for spec in specs:
            mine = [c for s, c in entries if s is spec]
            if not mine:
                continue
            if late and scored:
                break
            result = _search(sample, statistics, n_classes, spec, mine, cv, refit=False)
            found[spec.name] = result
            means = {r["cand_id"]: r["mean"] for r in result.ranking.filter(F.col("metric") == cv.refit).collect()}
            scored += [(means[c.cand_id], i, spec, c) for i, (s, c) in enumerate(entries) if s is spec]
            late = deadline is not None and time.time() > deadline
        ranked = sorted(scored, key=lambda r: (-round(r[0], RANK_DIGITS), r[1]))
        last = late or rung == len(shares) - 1
        kept = 0 if last else -(-len(ranked) // factor)
        for place, (score, _, spec, c) in enumerate(ranked, 1):
            rows.append((rung, share, size, spec.name, c.cand_id, score, place, place <= kept))
        order = {spec.name: place for place, (_, _, spec, _) in reversed(list(enumerate(ranked)))}
        results = sorted(((s, found[s.name]) for s in specs if s.name in found), key=lambda r: order[r[0].name])
        if last:
            break
        chosen = sorted(ranked[:kept], key=lambda r: r[1])
        entries = [(spec, c) for _, _, spec, c in chosen]
    return Halving(spark.createDataFrame(rows, RUNG_SCHEMA), results, statistics, share)


@dataclass(frozen=True)
class ModelSearch:
    """Outcome of a budgeted search: what reached the last rung, every rung, the winner and its holdout score."""

    tried: DataFrame
    rungs: DataFrame
    best: SearchResult
    holdout_score: float
    model: PipelineModel


def model_search(
    data: Dataset,
    max_candidates: int = 50,
    max_seconds: float | None = None,
    cv: CvPlan | None = None,
    seed: int = 42,
    export_path: str | None = None,
    specs: Sequence[ModelSpec] | None = None,
) -> ModelSearch:
    """Successive halving of random chains on 80 % of the rows under a budget, scored on the other 20 %."""
    cv = cv or CvPlan(seed=seed)
    rows, features, n_classes = labelled(data)
    split = materialize(stratified_holdout(rows, _LABEL, _KEY, seed=seed), "holdout", ["is_test"])
    folded = fold_table(split.filter(~F.col("is_test")).drop("is_test"), cv)
    test = split.filter("is_test").drop("is_test")
    deadline = None if max_seconds is None else time.time() + max_seconds
    tried = random_specs(max_candidates, seed) if specs is None else list(specs)
    found = successive_halving(folded, features, n_classes, tried, cv, deadline=deadline)
    spec, best = found.results[0]
    # A last rung with all rows has their medians and moments already.
    statistics = found.statistics if found.share == 1.0 else fold_statistics(folded, features, cv)
    fitted = refit_on_all(spec, best.best, folded, statistics, n_classes, seed)
    scored = _scored_candidates(spec, fitted, test, n_classes)
    model = fitted.full()
    holdout = cv.metrics[cv.refit](scored, ()).first()["value"]
    if export_path is not None:
        model.write().overwrite().save(export_path)
    last = best_rows([r for _, r in found.results], data.df.sparkSession)
    return ModelSearch(last, found.rungs, best, holdout, model)


def automated(data: Dataset, spec: AutoSpec, seed: int, out_dir: str | None = None) -> SearchResult:
    """The budgeted search of a declared entry, as a result like others; its score is that of the holdout."""
    start = time.time()
    cv = CvPlan(spec.folds, {spec.metric: METRICS[spec.metric]}, spec.metric, seed if spec.seed is None else spec.seed)
    export = spec.export_path
    if export is not None and out_dir is not None and "/" not in export:
        export = f"{out_dir.rstrip('/')}/{export}"
    found = model_search(data, spec.max_candidates, spec.max_seconds, cv, cv.seed, export)
    return replace(
        found.best, name=spec.name, best_score=found.holdout_score, elapsed_sec=time.time() - start, model=found.model
    )

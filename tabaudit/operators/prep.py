"""Model preparation fitted on training rows: imputing, scaling, selection, PCA.

A fit collects one small statistics table (folds x classes x features) and turns
it into plain SQL expressions, so applying it is a projection without a join.
All folds of a cross-validation are fitted by the same few jobs: the statistics
are taken per fold, and each training set merges the folds it contains.  What the F tests need of the
classes is summed in Spark, so the target may have any number of them.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.feature import PCA, PCAModel, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col, missing_to_null, quote
from tabaudit.functions.quantiles import exact_quantiles

# Classes that a classifier may tell apart.
MAX_CLASSES = 1_000

_DECOMPOSITION = threading.Lock()


@dataclass(frozen=True)
class PrepSpec:
    """Which steps to fit, in this order; a variance threshold wins over the F tests."""

    imputer: str | None = None
    scaler: str | None = None
    variance_threshold: float | None = None
    select_k_best: int | str | None = None
    select_percentile: float | None = None

    @property
    def needs_f(self) -> bool:
        return self.variance_threshold is None and (
            self.select_k_best is not None or self.select_percentile is not None
        )


@dataclass(frozen=True)
class FittedPrep:
    """Fitted steps: kept features and their SQL expressions."""

    features: tuple[str, ...]
    medians: Mapping[str, float] = field(default_factory=dict)
    means: Mapping[str, float] = field(default_factory=dict)
    scales: Mapping[str, float] = field(default_factory=dict)
    scores: Mapping[str, float | None] = field(default_factory=dict)
    n_rows: int = 0

    def expression(self, name: str) -> str:
        text = f"CAST({quote(name)} AS DOUBLE)"
        if name in self.medians:
            text = f"coalesce({text}, {_literal(self.medians[name])})"
        if name in self.means:
            text = f"({text} - {_literal(self.means[name])}) / {_literal(self.scales[name])}"
        return text

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The kept features, transformed under their own names, after ``keep``."""
        df = missing_to_null(df)
        made = [F.expr(self.expression(c)).alias(c) for c in self.features]
        return df.select(*[col(c) for c in keep], *made)

    def stages(self, output: str, prefix: str = "__f") -> list[Transformer]:
        """The same as Spark ML stages that add the vector column ``output``."""
        names = [f"{prefix}{i}" for i in range(len(self.features))]
        made = ", ".join(f"{self.expression(c)} AS {n}" for c, n in zip(self.features, names))
        return [
            SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"),
            VectorAssembler(inputCols=names, outputCol=output),
        ]


def _literal(value: float) -> str:
    return f"({float(value)!r}D)"


# -- moments ----------------------------------------------------------------------------


@dataclass
class _Moments:
    """Count, mean and squared deviations of all features, mergeable."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    def merge(self, other: _Moments) -> _Moments:
        n = self.n + other.n
        safe = np.where(n > 0, n, 1.0)
        delta = other.mean - self.mean
        mean = self.mean + delta * other.n / safe
        m2 = self.m2 + other.m2 + delta**2 * self.n * other.n / safe
        return _Moments(n, mean, m2)

    @property
    def variance(self) -> np.ndarray:
        return self.m2 / np.where(self.n > 0, self.n, 1.0)


@dataclass
class _Cell:
    """Moments of one fold, and its rows with those whose value is missing."""

    fold: int | None
    rows: int
    moments: _Moments

    def imputed(self, medians: np.ndarray) -> _Moments:
        missing = self.rows - self.moments.n
        filled = _Moments(missing, np.where(missing > 0, medians, 0.0), np.zeros_like(missing))
        return self.moments.merge(filled)


def _moment_columns(features: Sequence[str]) -> list[Column]:
    asked = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(features):
        v = col(c).cast("double")
        asked += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")]
    return asked


def _collect_cells(df: DataFrame, features: Sequence[str], fold: str | None) -> list[_Cell]:
    """A cell for each fold."""
    grouped = df.groupBy(*([col(fold)] if fold else [])).agg(*_moment_columns(features)).collect()
    cells = []
    for r in grouped:
        n = np.array([r[f"n{i}"] for i in range(len(features))], dtype=float)
        mean = np.array([r[f"m{i}"] or 0.0 for i in range(len(features))], dtype=float)
        var = np.array([r[f"v{i}"] or 0.0 for i in range(len(features))], dtype=float)
        cells.append(_Cell(r[fold] if fold else None, r["rows"], _Moments(n, mean, var * n)))
    return cells


def _merged(parts: Sequence[_Moments], p: int) -> _Moments:
    total = _Moments(np.zeros(p), np.zeros(p), np.zeros(p))
    for part in parts:
        total = total.merge(part)
    return total


def _class_sums(
    df: DataFrame, features: Sequence[str], target: str, fold: str | None, centres: Sequence[tuple[int | None, np.ndarray, np.ndarray | None]]
) -> DataFrame:
    """Rows ``(set, position, groups, between, within)``: sums of squares of each training set, with any number of classes.

    An entry of ``centres`` is a training set: the fold it leaves out, the means of its features, and what its missing
    values become.  Classes are counted per fold once; each training set merges the folds of its classes.
    """
    spark = df.sparkSession
    keys = [col(target).alias("class"), (col(fold) if fold else F.lit(None).cast("int")).alias("part")]
    counted = df.groupBy(*keys).agg(*_moment_columns(features))
    values = [F.struct(F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i in range(len(features))]
    taken = [F.when(F.lit(held_out is None) | F.coalesce(F.col("part") != F.lit(held_out), F.lit(False)), F.lit(k)) for k, (held_out, _, _) in enumerate(centres)]
    cells = counted.select("class", "rows", F.explode(F.array_compact(F.array(*taken))).alias("set"), F.array(*values).alias("values"))
    cells = cells.select("class", "rows", "set", F.posexplode("values").alias("position", "x")).select("class", "rows", "set", "position", "x.*")
    facts = [
        (k, i, float(mean[i]), None if filler is None else float(filler[i]))
        for k, (_, mean, filler) in enumerate(centres)
        for i in range(len(features))
    ]
    cells = cells.join(spark.createDataFrame(facts, "set int, position int, centre double, filler double"), ["set", "position"])
    # Values are told from the mean of the training set, so large means lose no digits.
    missing = F.when(F.col("filler").isNotNull(), F.col("rows") - F.col("n")).otherwise(F.lit(0))
    own, fill = F.coalesce(F.col("m"), F.lit(0.0)) - F.col("centre"), F.coalesce("filler", F.lit(0.0)) - F.col("centre")
    total = F.col("n") + missing
    mean = F.when(missing == 0, own).when(F.col("n") == 0, fill).otherwise((F.col("n") * own + missing * fill) / total)
    spread = F.coalesce(F.col("v"), F.lit(0.0)) * F.col("n")
    spread = spread + F.when((missing > 0) & (F.col("n") > 0), (own - fill) * (own - fill) * F.col("n") * missing / total).otherwise(0.0)
    cells = cells.select("set", "position", "class", total.alias("n"), mean.alias("d"), spread.alias("m2")).where(F.col("n") > 0)
    per_class = cells.groupBy("set", "position", "class").agg(
        F.sum("n").alias("n"),
        F.sum("m2").alias("m2"),
        F.sum(F.col("n") * F.col("d")).alias("s"),
        F.min("d").alias("low"),
        F.max("d").alias("high"),
        F.collect_list(F.struct("n", "d")).alias("parts"),  # one for each fold
    )
    per_class = per_class.withColumn("d", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("s") / F.col("n")))
    between_folds = F.aggregate("parts", F.lit(0.0), lambda done, x: done + x["n"] * (x["d"] - F.col("d")) * (x["d"] - F.col("d")))
    return per_class.groupBy("set", "position").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") * F.col("d") * F.col("d")).alias("between"),
        F.sum(F.col("m2") + between_folds).alias("within"),
    )


def _f_score(n: float, groups: int, between: float, within: float) -> float | None:
    """One-way ANOVA F; ``None`` where the feature is constant."""
    if groups < 2 or n <= groups or (within == 0 and between == 0):
        return None
    if within == 0:
        return float("inf")
    return float((between / (groups - 1)) / (within / (n - groups)))


# -- selection --------------------------------------------------------------------------


def k_best(scores: Sequence[float | None], k: int | str) -> list[int]:
    """Positions of the ``k`` largest scores; on ties the later column wins."""
    if k == "all":
        return list(range(len(scores)))
    ranked = sorted(range(len(scores)), key=lambda i: (_ordered(scores[i]), i))
    return sorted(ranked[max(len(ranked) - int(k), 0) :])


def best_percentile(scores: Sequence[float | None], percentile: float) -> list[int]:
    """Positions above the score quantile, and ties in column order up to the share."""
    p = len(scores)
    if percentile >= 100:
        return list(range(p))
    if percentile <= 0:
        return []
    values = [_ordered(s) for s in scores]
    cut = float(np.percentile(values, 100 - percentile))
    above = [i for i in range(p) if values[i] > cut]
    room = max(int(p * percentile / 100) - len(above), 0)
    ties = [i for i in range(p) if values[i] == cut]
    return sorted(above + ties[:room])


def _ordered(score: float | None) -> float:
    return -np.finfo(float).max if score is None else score


def _select(spec: PrepSpec, variances: np.ndarray, scores: Sequence[float | None]) -> list[int]:
    if spec.variance_threshold is not None:
        kept = [i for i, v in enumerate(variances) if v > spec.variance_threshold]
        if not kept:
            raise ValueError(f"no feature has a variance above {spec.variance_threshold}")
        return kept
    if spec.select_k_best is not None:
        return k_best(scores, spec.select_k_best)
    if spec.select_percentile is not None:
        return best_percentile(scores, spec.select_percentile)
    return list(range(len(variances)))


# -- fitting ----------------------------------------------------------------------------


class PrepStatistics:
    """Statistics of all training sets, taken once and shared by the specs fitted from them.

    An entry of ``folds`` is the fold that its training set leaves out; ``None``
    stands for all rows.  Medians and moments are computed when first needed.
    """

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str],
        target: str | None,
        fold: str | None,
        folds: Sequence[int | None],
    ) -> None:
        self.df, self.features, self.target = missing_to_null(df), list(features), target
        self.fold, self.folds = fold, list(folds)
        self._f: dict[bool, dict[int | None, list[float | None]]] = {}

    @cached_property
    def _medians(self) -> dict[tuple[int | None, str], float | None]:
        return _fold_medians(self.df, self.features, self.fold, self.folds)

    @cached_property
    def _cells(self) -> list[_Cell]:
        return _collect_cells(self.df, self.features, self.fold)

    def _total(self, held_out: int | None, imputed: bool) -> tuple[_Moments, np.ndarray | None]:
        """Moments of a training set, and what its missing values become."""
        train = [c for c in self._cells if held_out is None or c.fold != held_out]
        if not imputed:
            return _merged([c.moments for c in train], len(self.features)), None
        found = [self._medians[(held_out, c)] for c in self.features]
        filler = np.array([0.0 if m is None else m for m in found])
        return _merged([c.imputed(filler) for c in train], len(self.features)), filler

    def _scores(self, imputed: bool) -> dict[int | None, list[float | None]]:
        """F scores of all training sets from one job, kept for later specs."""
        if imputed not in self._f:
            totals = [self._total(held_out, imputed) for held_out in self.folds]
            centres = [(held_out, total.mean, filler) for held_out, (total, filler) in zip(self.folds, totals)]
            scores = {held_out: [None] * len(self.features) for held_out in self.folds}
            for r in _class_sums(self.df, self.features, self.target, self.fold, centres).collect():
                n = float(totals[r["set"]][0].n[r["position"]])
                scores[self.folds[r["set"]]][r["position"]] = _f_score(n, r["groups"], r["between"], r["within"])
            self._f[imputed] = scores
        return self._f[imputed]

    def fit(self, spec: PrepSpec) -> dict[int | None, FittedPrep]:
        """The steps of ``spec`` fitted on each training set."""
        if spec.needs_f and self.target is None:
            raise ValueError("selection by F needs a target")
        return {held_out: self._fit_one(spec, held_out) for held_out in self.folds}

    def _fit_one(self, spec: PrepSpec, held_out: int | None) -> FittedPrep:
        names = self.features
        imputed = spec.imputer == "simple"
        total, _ = self._total(held_out, imputed)
        found = [self._medians[(held_out, c)] if imputed else None for c in names]
        # A feature without any value cannot be imputed and is left out.
        usable = [i for i, m in enumerate(found) if not imputed or m is not None]
        scores = self._scores(imputed)[held_out] if spec.needs_f else [None] * len(names)
        deviation = np.sqrt(total.variance)
        # A constant feature is only centred.
        constant = deviation <= 1e-12 * np.maximum(np.abs(total.mean), 1.0)
        scale = np.where(constant, 1.0, deviation)
        variances = total.variance
        if spec.scaler == "standard":
            variances = np.where(constant, 0.0, 1.0)
        kept = [usable[i] for i in _select(spec, variances[usable], [scores[i] for i in usable])]
        scaled = kept if spec.scaler == "standard" else []
        return FittedPrep(
            features=tuple(names[i] for i in kept),
            medians={names[i]: found[i] for i in kept if found[i] is not None},
            means={names[i]: float(total.mean[i]) for i in scaled},
            scales={names[i]: float(scale[i]) for i in scaled},
            scores={n: scores[i] for i, n in enumerate(names)},
            n_rows=sum(c.rows for c in self._cells if held_out is None or c.fold != held_out),
        )


def fit_prep_folds(
    df: DataFrame,
    features: Sequence[str],
    spec: PrepSpec,
    target: str | None,
    fold: str | None,
    folds: Sequence[int | None],
) -> list[FittedPrep]:
    """For each entry of ``folds`` the steps fitted on the rows outside that fold."""
    wanted = target if spec.needs_f else None
    fitted = PrepStatistics(df, features, wanted, fold, folds).fit(spec)
    return [fitted[f] for f in folds]


def _fold_medians(
    df: DataFrame, features: Sequence[str], fold: str | None, folds: Sequence[int | None]
) -> dict[tuple[int | None, str], float | None]:
    """Medians of all training sets in one search: one masked column per fold."""
    keys = {f"{i}:{c}": (held_out, c) for i, held_out in enumerate(folds) for c in features}
    masked = {}
    for label, (held_out, c) in keys.items():
        value = col(c)
        masked[label] = value if held_out is None else F.when(col(fold) != held_out, value)
    return {keys[k]: v[0] for k, v in exact_quantiles(df, masked, [0.5]).items()}


def fit_prep(
    df: DataFrame, features: Sequence[str], spec: PrepSpec, target: str | None = None
) -> FittedPrep:
    return fit_prep_folds(df, features, spec, target, None, [None])[0]


def anova_f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows ``(feature, position, f_score)``."""
    fitted = fit_prep(df, features, PrepSpec(select_k_best="all"), target)
    rows = [(c, i, fitted.scores[c]) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, position int, f_score double")


# -- reduction --------------------------------------------------------------------------


def fit_pca(vectors: DataFrame, column: str, output: str, p: int) -> PCAModel:
    """All principal components; the covariance is summed by the executors.

    ``column`` must be centred, as Spark projects vectors as they are.  One fit at
    a time: the driver's decomposition of the p x p matrix is not thread-safe.
    """
    with _DECOMPOSITION:
        return PCA(k=p, inputCol=column, outputCol=output).fit(vectors)


def components_kept(explained: Sequence[float], wanted: int | float | None) -> int:
    """All components, a fixed number, or the fewest whose share exceeds a ratio."""
    p = len(explained)
    if wanted is None:
        return p
    if isinstance(wanted, float) and 0 < wanted < 1:
        cumulative = np.cumsum(explained)
        return min(int(np.searchsorted(cumulative, wanted, side="right")) + 1, p)
    return min(int(wanted), p)


def centred(prep: FittedPrep, df: DataFrame) -> FittedPrep:
    """``prep`` with the means taken out, as a reduction needs; no change after a scaler."""
    if prep.means:
        return prep
    applied = prep.apply(df)
    row = applied.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(prep.features)]).first()
    means = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(prep.features)}
    return FittedPrep(
        prep.features, prep.medians, means, {c: 1.0 for c in means}, prep.scores, prep.n_rows
    )

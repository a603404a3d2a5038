"""Metrics over scored rows ``(label, prediction, score)`` for any groups at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.ranking import running_totals

POSITIVE = 1.0

# A scorer is an aggregate over the confusion table: it gets the label, the
# prediction and the number of rows of each cell.
Scorer = Callable[[Column, Column, Column], Column]


def confusion(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows ``(groups, label, prediction, n)``; the base of all threshold metrics."""
    return scored.groupBy(*[col(g) for g in groups], "label", "prediction").agg(
        F.count(F.lit(1)).alias("n")
    )


def _positive(value: Column) -> Column:
    return value.cast("double") == POSITIVE


def f1_scorer(label: Column, prediction: Column, n: Column) -> Column:
    """2 tp / (2 tp + fp + fn) of the positive class, 0 if undefined."""
    hits = F.sum(F.when(_positive(label) & _positive(prediction), n).otherwise(0))
    marks = F.sum(
        n * (_positive(label).cast("long") + _positive(prediction).cast("long"))
    )
    return F.coalesce(F.try_divide((2 * hits).cast("double"), marks), F.lit(0.0))


def accuracy_scorer(label: Column, prediction: Column, n: Column) -> Column:
    right = F.sum(F.when(label.cast("double") == prediction.cast("double"), n).otherwise(0))
    return F.try_divide(right.cast("double"), F.sum(n))


def _scored(scorer: Scorer, scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    cells = confusion(scored, groups)
    value = scorer(F.col("label"), F.col("prediction"), F.col("n"))
    return cells.groupBy(*[col(g) for g in groups]).agg(value.alias("value"))


def f1(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return _scored(f1_scorer, scored, groups)


def f1_macro(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean of 2 tp / (2 tp + fp + fn) over the classes that occur as label or prediction."""
    cells = confusion(scored, groups)
    keys = [col(g) for g in groups]
    right = F.when(F.col("label").cast("double") == F.col("prediction").cast("double"), F.col("n")).otherwise(0)
    sides = [
        cells.select(*keys, F.col(side).cast("double").alias("class"), "n", right.alias("right"))
        for side in ("label", "prediction")
    ]
    # A right answer is counted on both sides, as 2 tp asks for.
    by_class = reduce(DataFrame.unionByName, sides).groupBy(*keys, "class")
    value = F.sum("right").cast("double") / F.sum("n")
    return by_class.agg(value.alias("f1")).groupBy(*keys).agg(F.avg("f1").alias("value"))


def check_classes(metrics: Mapping[str, Metric], n_classes: int) -> None:
    """Metrics of one positive class are undefined for more than two classes."""
    binary = [name for name, metric in metrics.items() if metric in (f1, average_precision)]
    if n_classes > 2 and binary:
        raise ValueError(f"{', '.join(binary)} needs two classes, the target has {n_classes}; use f1_macro")


def custom(scorer: Scorer) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Turn a scorer into a metric."""
    return lambda scored, groups=(): _scored(scorer, scored, groups)


def balanced_accuracy(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur."""
    right = F.col("label").cast("double") == F.col("prediction").cast("double")
    recall = F.sum(F.when(right, F.col("n")).otherwise(0)).cast("double") / F.sum("n")
    by_class = confusion(scored, groups).groupBy(*[col(g) for g in groups], "label")
    return by_class.agg(recall.alias("recall")).groupBy(*[col(g) for g in groups]).agg(
        F.avg("recall").alias("value")
    )


def _ranked_counts(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per score, from high to low: its positives and rows, and their running totals."""
    by_score = scored.groupBy(*[col(g) for g in groups], "score").agg(
        F.count_if(_positive(F.col("label"))).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    return running_totals(by_score, groups, "score", {"tp": "pos", "seen": "n"}, descending=True)


def average_precision(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the gain in recall, over the distinct scores."""
    ranked = _ranked_counts(scored, groups)
    gained = F.sum(F.col("pos") * (F.col("tp").cast("double") / F.col("seen")))
    value = F.coalesce(F.try_divide(gained, F.sum("pos")), F.lit(0.0))
    return ranked.groupBy(*[col(g) for g in groups]).agg(value.alias("value"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """Rows ``(score, precision, recall, area)``; the areas add up to the trapezoid AUC.

    The curve starts at recall 0, precision 1.  The point before is known from
    the running totals, so no look-behind over the whole table is needed.
    """
    ranked = _ranked_counts(scored, ())
    total = scored.agg(F.count_if(_positive(F.col("label"))).alias("p")).scalar()
    tp, seen = F.col("tp").cast("double"), F.col("seen")
    tp_before, seen_before = tp - F.col("pos"), seen - F.col("n")
    before = F.coalesce(F.try_divide(tp_before, seen_before), F.lit(1.0))
    gain = F.try_divide(F.col("pos").cast("double"), total)
    return ranked.select(
        "score",
        (tp / seen).alias("precision"),
        F.try_divide(tp, total).alias("recall"),
        (gain * (tp / seen + before) / 2).alias("area"),
    )


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Rows ``(bin, mean_score, positive_share, n)`` for scores in [0, 1]."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(place.alias("bin")).agg(
        F.avg("score").alias("mean_score"),
        F.avg(_positive(F.col("label")).cast("double")).alias("positive_share"),
        F.count(F.lit(1)).alias("n"),
    )


Metric = Callable[[DataFrame, Sequence[str]], DataFrame]

METRICS: dict[str, Metric] = {
    "f1": f1,
    "f1_macro": f1_macro,
    "balanced_accuracy": balanced_accuracy,
    "average_precision": average_precision,
    "accuracy": custom(accuracy_scorer),
}


def score_all(scored: DataFrame, metrics: Mapping[str, Metric], groups: Sequence[str]) -> DataFrame:
    """Rows ``(groups, metric, value)``."""
    parts = [
        metric(scored, groups).select(*[col(g) for g in groups], F.lit(name).alias("metric"), "value")
        for name, metric in metrics.items()
    ]
    return reduce(DataFrame.unionByName, parts)

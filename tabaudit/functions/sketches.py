"""Quantile sketches that are stored once and merged without reading the data again.

A sketch holds a bounded number of values whatever the column holds, so one for each part of a table (a day, a
file, a fold) is a small row.  Sketches of any parts are merged into that of their union; a quantile of it has about the
right rank, within ``rank_error`` of the rows with 99 % confidence.  Exact quantiles are in ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col, missing_to_null

# Size parameter: values kept in the widest level of a sketch.
SKETCH_SIZE = 800


def rank_error(size: int = SKETCH_SIZE) -> float:
    """The normalised rank error of a single quantile at 99 % confidence, as the sketch's authors state it."""
    return 2.296 / size**0.9021


def quantile_sketches(df: DataFrame, names: Sequence[str], parts: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """Rows ``(*parts, column, n, low, high, sketch)``, one for each part and numeric column.

    Nulls and NaN are left out; a column without values in a part has a null sketch.  Values are sketched in
    tasks before the shuffle, so a part may hold any share of the rows.
    """
    rows = missing_to_null(df)
    made = []
    for i, name in enumerate(names):
        value = col(name).cast("double")
        made += [
            F.count(value).alias(f"n{i}"), F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}"),
            F.kll_sketch_agg_double(value, F.lit(size)).alias(f"sketch{i}"),
        ]
    found = rows.groupBy(*[col(p) for p in parts]).agg(*made)
    entries = [
        F.struct(
            F.lit(name).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"),
            F.when(F.col(f"n{i}") > 0, F.col(f"sketch{i}")).alias("sketch"),
        )
        for i, name in enumerate(names)
    ]
    return found.select(*[col(p) for p in parts], F.explode(F.array(*entries)).alias("e")).select(*[col(p) for p in parts], "e.*")


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, column, n, low, high, sketch)`` of the union of stored parts."""
    return sketches.groupBy(*[col(c) for c in by], "column").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketch_quantiles(sketches: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Rows of ``sketches`` with ``quantiles``, an array in the order of ``probabilities``; 0 and 1 are exact."""

    def at(p: float) -> Column:
        if p <= 0:
            return F.col("low")
        if p >= 1:
            return F.col("high")
        return F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))

    found = F.when(F.col("n") > 0, F.array(*[at(p) for p in probabilities]))
    return sketches.withColumn("quantiles", found)


def sketch_rank(sketch: Column, value: Column) -> Column:
    """The share of a sketch's rows at or below ``value``, nearly."""
    return F.kll_sketch_get_rank_double(sketch, value)

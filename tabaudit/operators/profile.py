"""Column profile: counts, numeric statistics, frequent values and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import (
    col,
    missing_to_null,
    numeric_columns,
    other_columns,
    stacked,
    unpivoted,
)
from tabaudit.functions.quantiles import exact_quantiles
from tabaudit.operators.audit import corr_pairs, distinct_counts
from tabaudit.operators.frequent import frequent_values

# The quantiles, list length and bins of a profile.
PROFILE_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
TOP_VALUES = 10
HISTOGRAM_BINS = 10


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows ``(column, type, n, n_nulls, null_share, n_distinct)``."""
    names = df.columns
    df = missing_to_null(df)
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
    )
    entries = [
        (F.lit(i), F.lit(c), F.lit(df.schema[c].dataType.simpleString()), F.col("n"), F.col(f"n{i}"))
        for i, c in enumerate(names)
    ]
    base = unpivoted(counted, ["position", "column", "type", "n", "n_nulls"], entries)
    share = F.try_divide(F.col("n_nulls").cast("double"), F.col("n"))
    return (
        base.join(distinct_counts(df, names, approx), "position", "left")
        .withColumn("null_share", share)
        .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
        .select("column", "type", "n", "n_nulls", "null_share", "n_distinct")
    )


def profile_numeric(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of mean, sample deviation, min, quantiles, max and zero count per numeric column."""
    df = missing_to_null(df)
    numeric = numeric_columns(df, names)
    labels = [f"p{round(p * 100):02d}" for p in PROFILE_QUANTILES]
    fields = ["column", "mean", "std", "min", *labels, "max", "zeros"]
    if not numeric:
        kinds = ", ".join(f"{f} double" for f in fields[1:-1])
        return df.sparkSession.createDataFrame([], f"column string, {kinds}, zeros long")
    quantiles = exact_quantiles(df, {c: col(c) for c in numeric}, PROFILE_QUANTILES)
    row = df.agg(
        *[
            f(col(c).cast("double")).alias(f"{label}{i}")
            for i, c in enumerate(numeric)
            for label, f in (
                ("mean", F.avg),
                ("std", F.stddev_samp),
                ("min", F.min),
                ("max", F.max),
                ("zeros", lambda v: F.count_if(v == 0)),
            )
        ]
    )
    entries = [
        (
            F.lit(c),
            F.col(f"mean{i}"),
            F.col(f"std{i}"),
            F.col(f"min{i}"),
            *[F.lit(q).cast("double") for q in quantiles[c]],
            F.col(f"max{i}"),
            F.col(f"zeros{i}"),
        )
        for i, c in enumerate(numeric)
    ]
    return unpivoted(row, fields, entries)


def profile_topk(
    df: DataFrame, names: Sequence[str] | None = None, k: int = TOP_VALUES
) -> DataFrame:
    """The ``k`` most frequent values of each non-numeric column, ties by value.

    Summaries of tasks tell which values can win, so only nearly unique columns are shuffled whole
    (``operators/frequent.py``).  The rank filter is applied before the last shuffle as well.
    """
    names = other_columns(df, names)
    if not names:
        schema = "column string, value string, n long, rank int, share double"
        return df.sparkSession.createDataFrame([], schema)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = frequent_values(df, names, k)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("share", F.col("n") / total)
    )


def profile_histogram(
    df: DataFrame, names: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Rows ``(column, bin, lower, upper, n)`` of equal-width bins on [min, max]."""
    df = missing_to_null(df)
    numeric = numeric_columns(df, names)
    limits = df.agg(
        *[
            f(col(c).cast("double")).alias(f"{label}{i}")
            for i, c in enumerate(numeric)
            for label, f in (("low", F.min), ("high", F.max))
        ]
    ).first()
    known = [(i, c) for i, c in enumerate(numeric) if limits[f"low{i}"] is not None]
    schema = "column string, bin int, lower double, upper double, n long"
    if not known:
        return df.sparkSession.createDataFrame([], schema)
    rows, edges = [], F.lit(None)
    for i, c in known:
        low, width = limits[f"low{i}"], (limits[f"high{i}"] - limits[f"low{i}"]) / bins
        value = col(c).cast("double")
        place = F.floor((value - low) / width) if width else F.when(value.isNotNull(), 0)
        rows.append((F.lit(c), F.least(place.cast("int"), F.when(value.isNotNull(), bins - 1))))
        edge = F.struct(F.lit(low).alias("low"), F.lit(width).alias("width"))
        edges = F.when(F.col("column") == c, edge).otherwise(edges)
    counts = (
        stacked(df, ["column", "bin"], rows)
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("edge", edges)
    )
    lower = F.col("edge.low") + F.col("bin") * F.col("edge.width")
    upper = F.col("edge.low") + (F.col("bin") + 1) * F.col("edge.width")
    return counts.select("column", "bin", lower.alias("lower"), upper.alias("upper"), "n")


def full_profile(df: DataFrame, minimal: bool = False) -> dict[str, DataFrame]:
    """The parts of a profile; ``minimal`` leaves out values, histograms and pairs."""
    parts = {"columns": profile_columns(df), "numeric": profile_numeric(df)}
    if not minimal:
        parts["values"] = profile_topk(df)
        parts["histogram"] = profile_histogram(df)
        parts["correlation"] = corr_pairs(df)
    return parts

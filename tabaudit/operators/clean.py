"""Cleaning: duplicates, missing values, outlier flags and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.columns import (
    col,
    missing_to_null,
    numeric_columns,
    unpivoted,
)
from tabaudit.functions.quantiles import exact_quantiles
from tabaudit.functions.storage import materialize

# The defaults of the cleaning rules.
UNKNOWN = "Unknown"
MIN_SAMPLES = 10
STRATEGIES = ("auto", "drop", "fill")
IQR_FACTOR = 1.5


def dedupe(df: DataFrame) -> DataFrame:
    """Remove rows equal in every column; nulls are equal to each other.

    A hash aggregate: copies of one row are merged before the shuffle, however
    many there are.
    """
    return df.dropDuplicates()


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the columns that exist and ignore the other names."""
    dropped = set(names)
    return df.select(*[col(c) for c in df.columns if c not in dropped])


def column_medians(df: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    found = exact_quantiles(df, {c: col(c) for c in names}, [0.5])
    return {c: v[0] for c, v in found.items()}


def fill_missing(df: DataFrame) -> DataFrame:
    """Numeric nulls become the column median, string nulls become "Unknown".

    One cheap count finds the columns with nulls; only these need a median.  An
    integer column that gets a median becomes double.
    """
    numeric = numeric_columns(df)
    holes: list[str] = []
    if numeric:
        counts = df.agg(*[F.max(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(numeric)])
        row = counts.first()
        holes = [c for i, c in enumerate(numeric) if row[f"n{i}"]]
    medians = column_medians(df, holes)

    def filled(field: T.StructField) -> Column:
        c = col(field.name)
        if medians.get(field.name) is not None:
            return F.coalesce(c.cast("double"), F.lit(medians[field.name])).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(c, F.lit(UNKNOWN)).alias(field.name)
        return c

    return df.select(*[filled(f) for f in df.schema.fields])


def clean(df: DataFrame, strategy: str = "auto", drop: Sequence[str] = ()) -> DataFrame:
    """Dedupe, treat missing values by ``strategy``, then drop columns.

    Duplicates and nulls are judged on all columns, also on those dropped later.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown missing-value strategy: {strategy}")
    result = dedupe(missing_to_null(df))
    if strategy == "drop":
        result = drop_missing(result)
    elif strategy == "fill":
        # Read by the null scan, the medians and the result: dedupe only once.
        result = fill_missing(materialize(result, "deduped"))
    return drop_columns(result, drop)


def null_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(column, position, n_nulls)`` from one aggregate over the table."""
    names = list(df.columns if names is None else names)
    counted = missing_to_null(df.select(*[col(c) for c in names])).agg(
        *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]
    )
    return unpivoted(
        counted,
        ["column", "position", "n_nulls"],
        [(F.lit(c), F.lit(i), F.col(f"n{i}")) for i, c in enumerate(names)],
    )


def top_null_columns(df: DataFrame, names: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The columns with most nulls, ties in column order."""
    return null_counts(df, names).orderBy(F.desc("n_nulls"), "position").limit(n)


def duplicate_count(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows equal an earlier one in all given columns."""
    names = list(df.columns if names is None else names)
    rows = missing_to_null(df.select(*[col(c) for c in names]))
    groups = rows.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("__copies"))
    return groups.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicates"))


def outlier_flags(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Add ``<column>_outlier``: outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR. Deletes nothing."""
    df = missing_to_null(df)
    numeric = numeric_columns(df, names)
    quartiles = exact_quantiles(df, {c: col(c) for c in numeric}, [0.25, 0.75])

    def flag(name: str) -> Column:
        first, third = quartiles[name]
        if first is None:
            return F.lit(False).alias(f"{name}_outlier")
        reach = IQR_FACTOR * (third - first)
        inside = col(name).between(F.lit(first - reach), F.lit(third + reach))
        return F.coalesce(~inside, F.lit(False)).alias(f"{name}_outlier")

    return df.select("*", *[flag(c) for c in numeric])


def validation_status(
    df: DataFrame, min_samples: int = MIN_SAMPLES, x_key: str | None = None, y_key: str | None = None
) -> DataFrame:
    """One row ``(n_checked, enough_samples, n_unmatched, ok)``.

    Counting stops at ``min_samples`` rows.  With ``x_key`` and ``y_key``, the two
    key columns of an outer join, rows with only one side count as unmatched.
    """
    counted = df.limit(min_samples).agg(F.count(F.lit(1)).alias("n_checked"))
    unmatched = F.lit(0).cast("long")
    if x_key is not None and y_key is not None:
        one_sided = df.agg(F.count_if(col(x_key).isNull() | col(y_key).isNull()).alias("n"))
        unmatched = one_sided.scalar()
    enough = F.col("n_checked") >= min_samples
    return counted.select("n_checked", enough.alias("enough_samples"), unmatched.alias("n_unmatched")).withColumn(
        "ok", F.col("enough_samples") & (F.col("n_unmatched") == 0)
    )


def validate(df: DataFrame, min_samples: int = MIN_SAMPLES) -> None:
    """Raise ``ValueError`` on fewer than ``min_samples`` rows."""
    n = df.limit(min_samples).count()
    if n < min_samples:
        raise ValueError(f"{n} rows are too few, at least {min_samples} are needed")

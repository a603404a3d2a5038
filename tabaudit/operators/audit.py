"""Audit statistics: shape, types, correlation, class balance and warning flags."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.dataset import Dataset
from tabaudit.functions.columns import (
    col,
    missing_to_null,
    numeric_columns,
    stacked,
    unpivoted,
)
from tabaudit.functions.storage import materialize
from tabaudit.operators.clean import duplicate_count

# Thresholds of the audit.
CATEGORICAL_RATIO = 0.1
HIGH_CORRELATION = 0.95
IMBALANCE_SHARE = 0.8
SAMPLES_PER_FEATURE = 5
TOP_NULLS = 10


def shape(data: Dataset) -> DataFrame:
    return data.df.agg(
        F.count(F.lit(1)).alias("n_samples"), F.lit(len(data.features)).cast("long").alias("n_features")
    )


# -- distinct values and semantic types -------------------------------------------------


def _typed_slots(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """The value in one of three typed slots, so unlike columns share one shuffle."""
    kind = df.schema[name].dataType
    none = F.lit(None)
    as_long, as_double, as_text = none.cast("long"), none.cast("double"), none.cast("string")
    if isinstance(kind, T.IntegralType):
        as_long = col(name).cast("long")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        as_double = col(name).cast("double")
    elif isinstance(kind, T.StringType):
        # Long texts are compared by digest, so they are not shuffled whole.
        digest = F.concat(F.lit("sha256:"), F.sha2(col(name), 256))
        as_text = F.when(F.length(col(name)) > 64, digest).otherwise(col(name))
    else:
        as_text = col(name).cast("string")
    return as_long, as_double, as_text


def distinct_counts(df: DataFrame, names: Sequence[str], approx: bool = False) -> DataFrame:
    """Rows ``(position, n_distinct)``: distinct non-null values of each column.

    Exact: all columns go through one shuffle of distinct ``(column, value)``
    pairs, merged before the shuffle.  ``approx`` uses one sketch per column.
    """
    df = missing_to_null(df.select(*[col(c) for c in names]))
    if approx:
        row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(names)])
        entries = [(F.lit(i), F.col(f"d{i}")) for i in range(len(names))]
        return unpivoted(row, ["position", "n_distinct"], entries)
    slots = ["position", "as_long", "as_double", "as_text"]
    rows = [(F.lit(i), *_typed_slots(df, c)) for i, c in enumerate(names)]
    values = stacked(df, slots, rows).groupBy(*slots).agg(F.lit(1).alias("seen"))
    present = F.col("as_long").isNotNull() | F.col("as_double").isNotNull() | F.col("as_text").isNotNull()
    return values.groupBy("position").agg(F.count_if(present).alias("n_distinct"))


def infer_types(
    df: DataFrame, threshold: float = CATEGORICAL_RATIO, approx: bool = False
) -> DataFrame:
    """Rows ``(column, semantic_type)``.

    Numeric columns whose share of distinct values reaches ``threshold`` are
    "numeric", all others "categorical"; only numeric columns are counted.
    """
    numeric = numeric_columns(df)
    names = F.array(*[F.lit(c) for c in numeric])
    plain = [c for c in df.columns if c not in set(numeric)]
    parts = []
    if numeric:
        total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        ratio = F.try_divide(F.col("n_distinct").cast("double"), total)
        kind = F.when(ratio >= threshold, "numeric").otherwise("categorical")
        counts = distinct_counts(df, numeric, approx)
        parts.append(
            counts.select(
                F.element_at(names, F.col("position") + 1).alias("column"), kind.alias("semantic_type")
            )
        )
    if plain:
        rows = [(c, "categorical") for c in plain]
        parts.append(df.sparkSession.createDataFrame(rows, "column string, semantic_type string"))
    return reduce(DataFrame.unionByName, parts)


def analyze_raw(
    df: DataFrame,
    threshold: float = CATEGORICAL_RATIO,
    target: str | None = None,
) -> DataFrame:
    """Rows ``(column, position, n_rows, n_columns, semantic_type, n_nulls, is_target)``."""
    names = df.columns
    clean = missing_to_null(df)
    counted = clean.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
    )
    fields = ["column", "position", "n_rows", "n_columns", "n_nulls", "is_target"]
    entries = [
        (F.lit(c), F.lit(i), F.col("n"), F.lit(len(names)), F.col(f"n{i}"), F.lit(c == target))
        for i, c in enumerate(names)
    ]
    return unpivoted(counted, fields, entries).join(infer_types(clean, threshold), "column")


# -- correlation ------------------------------------------------------------------------

# Columns whose sums one task holds at once: 64 * (2 * COLUMN_BLOCK)**2 bytes.
COLUMN_BLOCK = 512
ROW_BLOCK = 4096

_SUMS = ("n", "u", "v", "uu", "vv", "uv")
_EXTENTS = ("low_u", "high_u", "low_v", "high_v")
_PAIR_SUMS = "i int, j int, " + ", ".join(f"{c} double" for c in (*_SUMS, *_EXTENTS))


@dataclass(frozen=True)
class _ColumnFacts:
    """Rows of the table, and per column its nulls and the extent of its values."""

    n: int
    nulls: dict[str, int]
    mean: dict[str, float | None]
    extent: dict[str, float]


def _column_facts(df: DataFrame, names: Sequence[str], numeric: Sequence[str]) -> _ColumnFacts:
    """One aggregate over the table; ``df`` holds nulls, no NaN."""
    asked = [F.count(F.lit(1)).alias("n")]
    asked += [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]
    for i, c in enumerate(numeric):
        v = col(c).cast("double")
        asked += [F.avg(v).alias(f"m{i}"), (F.max(v) - F.min(v)).alias(f"e{i}")]
    row = df.agg(*asked).first()
    return _ColumnFacts(
        row["n"],
        {c: row["n"] - row[f"n{i}"] for i, c in enumerate(names)},
        {c: row[f"m{i}"] for i, c in enumerate(numeric)},
        {c: row[f"e{i}"] or 0.0 for i, c in enumerate(numeric)},
    )


class _PairSums:
    """Sums over the rows where both columns of a pair are present, for all pairs at once."""

    def __init__(self, p: int) -> None:
        self.n, self.u, self.uu, self.uv = (np.zeros((p, p)) for _ in range(4))
        # Entry (i, j) is the extent of column i over the rows where j is present.
        self.low, self.high = np.full((p, p), np.inf), np.full((p, p), -np.inf)

    def add(self, x: np.ndarray) -> None:
        present = ~np.isnan(x)
        mask, z = present.astype(float), np.where(present, x, 0.0)
        self.n += mask.T @ mask
        self.u += z.T @ mask
        self.uu += (z * z).T @ mask
        self.uv += z.T @ z
        low, high = np.where(present, x, np.inf), np.where(present, x, -np.inf)
        whole = present.all(0)
        self.low[:, whole] = np.minimum(self.low[:, whole], low.min(0)[:, None])
        self.high[:, whole] = np.maximum(self.high[:, whole], high.max(0)[:, None])
        for j in np.flatnonzero(~whole):
            rows = present[:, j]
            if rows.any():
                self.low[:, j] = np.minimum(self.low[:, j], low[rows].min(0))
                self.high[:, j] = np.maximum(self.high[:, j], high[rows].max(0))

    def batch(self, names: Sequence[int], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        values = (self.n[i, j], self.u[i, j], self.u[j, i], self.uu[i, j], self.uu[j, i], self.uv[i, j])
        values += (self.low[i, j], self.high[i, j], self.low[j, i], self.high[j, i])
        places = [pa.array(np.asarray(names, np.int32)[k]) for k in (i, j)]
        return pa.RecordBatch.from_arrays(
            [*places, *[pa.array(v) for v in values]], names=["i", "j", *_SUMS, *_EXTENTS]
        )


def _pair_sums(df: DataFrame, numeric: Sequence[str], facts: _ColumnFacts, places: Sequence[int], split: int) -> DataFrame:
    """Sums of every pair of the columns at ``places`` from one scan, a row for each pair and task.

    With ``split`` only pairs across the first ``split`` columns and the others are returned.
    Values are centred and divided by their extent, so neither large means nor tiny scales lose digits.
    """
    centred = []
    for i in places:
        c = numeric[i]
        scale = facts.extent[c] if 0 < facts.extent[c] < math.inf else 1.0
        value = col(c).cast("double") - F.lit(facts.mean[c] or 0.0)
        centred.append((value / F.lit(scale)).alias(f"c{i}"))
    p = len(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _PairSums(p)
        with np.errstate(all="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, ROW_BLOCK):
                    part = batch.slice(at, ROW_BLOCK)
                    sums.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]))
        i, j = np.triu_indices(p, 1)
        if split:
            across = (i < split) & (j >= split)
            i, j = i[across], j[across]
        yield sums.batch(places, i, j)

    return df.select(*centred).mapInArrow(run, _PAIR_SUMS)


def _pair_frame(df: DataFrame, numeric: Sequence[str], facts: _ColumnFacts) -> DataFrame:
    """Rows ``(column_a, column_b, abs_corr)`` of all pairs, by one rule for any number of columns.

    Tasks sum all pairs of their rows, and Spark adds up the tasks.  Tables with more columns than a
    task can hold are scanned once for each pair of column blocks.
    """
    spark = df.sparkSession
    blocks = [range(at, min(at + COLUMN_BLOCK, len(numeric))) for at in range(0, len(numeric), COLUMN_BLOCK)]
    if len(blocks) <= 2:
        parts = [_pair_sums(df, numeric, facts, range(len(numeric)), 0)]
    else:
        parts = [_pair_sums(df, numeric, facts, b, 0) for b in blocks]
        parts += [_pair_sums(df, numeric, facts, [*a, *b], len(a)) for a, b in combinations(blocks, 2)]
    # Every pair has a row, also in a table without rows.
    last = len(numeric) - 1
    firsts = spark.range(last).select(F.col("id").cast("int").alias("i"))
    empty = firsts.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(last))).alias("j"))
    nothing = [F.lit(0.0).alias(c) for c in _SUMS] + [F.lit(None).cast("double").alias(c) for c in _EXTENTS]
    parts.append(empty.select("i", "j", *nothing))
    total = reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        *[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in _EXTENTS],
    )
    n, flat = F.col("n"), (F.col("low_u") >= F.col("high_u")) | (F.col("low_v") >= F.col("high_v"))
    product = F.abs(F.col("uv") - F.col("u") * F.col("v") / n)
    spread = F.sqrt(F.greatest(F.col("uu") - F.col("u") * F.col("u") / n, F.lit(0.0)))
    spread = spread * F.sqrt(F.greatest(F.col("vv") - F.col("v") * F.col("v") / n, F.lit(0.0)))
    value = F.when((n > 0) & ~flat & (spread > 0), product / spread)
    value = F.when(~F.isnan(value), F.when(value > 1, 1.0).otherwise(value))
    names = F.array(*[F.lit(c) for c in numeric])
    return total.select(
        F.element_at(names, F.col("i") + 1).alias("column_a"),
        F.element_at(names, F.col("j") + 1).alias("column_b"),
        value.alias("abs_corr"),
    )


def corr_pairs(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(column_a, column_b, abs_corr)`` for each pair of numeric columns.

    Pearson over the rows where both are present; NULL when one is constant there.
    """
    df = missing_to_null(df)
    numeric = numeric_columns(df, names)
    if len(numeric) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, abs_corr double")
    return _pair_frame(df, numeric, _column_facts(df, numeric, numeric))


def max_abs_corr(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row: the largest absolute correlation; 0.0 without numeric columns."""
    if not numeric_columns(df, names):
        return df.sparkSession.range(1).select(F.lit(0.0).alias("max_abs_corr"))
    return corr_pairs(df, names).agg(F.max("abs_corr").alias("max_abs_corr"))


# -- target -----------------------------------------------------------------------------


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows ``(class, n, share)`` over the non-null target values."""
    labels = missing_to_null(df.select(col(target).alias("class")))
    total = labels.agg(F.count("class").alias("n")).scalar()
    counts = labels.filter(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total)


def dataset_metadata(data: Dataset) -> DataFrame:
    """One row of feature count, sample count and number of target values, null included."""
    base = [
        F.lit(len(data.features)).cast("long").alias("features_count"),
        F.lit(data.target is not None).alias("has_target"),
    ]
    if data.target is None:
        return data.df.agg(
            F.count(F.lit(1)).alias("samples_count"), *base, F.lit(None).cast("long").alias("target_classes")
        )
    values = missing_to_null(data.y).groupBy(col(data.target)).agg(F.count(F.lit(1)).alias("n"))
    return values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples_count"),
        *base,
        F.count(F.lit(1)).alias("target_classes"),
    )


# -- summary ----------------------------------------------------------------------------

SUMMARY_SCHEMA = "section string, key string, value double"
_SUMMARY = ["section", "key", "value"]


def _table_rows(data: Dataset) -> list[tuple[str, str, float | None]]:
    """The facts that aggregates over the features tell: a row per fact."""
    df = missing_to_null(data.x)
    names, numeric = list(data.features), numeric_columns(data.x)
    facts = _column_facts(df, names, numeric)
    strongest = 0.0 if not numeric else None
    if len(numeric) > 1:
        strongest = _pair_frame(df, numeric, facts).agg(F.max("abs_corr")).first()[0]
    worst = sorted(names, key=lambda c: -facts.nulls[c])[:TOP_NULLS]
    high = strongest is not None and strongest >= HIGH_CORRELATION
    rows = [
        ("shape", "n_samples", facts.n),
        ("shape", "n_features", len(names)),
        *[("na_top10", c, facts.nulls[c]) for c in worst],
        ("features", "numeric_features", len(numeric)),
        ("features", "max_abs_corr_offdiag", strongest),
        ("flags", "needs_scaling", True),
        ("flags", "high_dimensional", facts.n < SAMPLES_PER_FEATURE * len(names)),
        ("flags", "high_collinearity", high),
    ]
    return [(s, k, None if v is None else float(v)) for s, k, v in rows]


def eda_summary(data: Dataset) -> DataFrame:
    """The audit record as long rows ``(section, key, value)``.

    Sections: ``shape``, ``na_top10``, ``features``, ``duplicates``,
    ``y_distribution`` and ``flags`` (1 is true).  Passes over the needed columns:
    one aggregate, one scan of pair sums, one duplicate count, and the class counts with their total.
    """
    spark = data.df.sparkSession
    parts = [spark.createDataFrame(_table_rows(data), SUMMARY_SCHEMA)]
    copies = duplicate_count(data.x)
    parts.append(_summary_rows(copies, "duplicates", F.lit("duplicates"), F.col("duplicates")))
    if data.target is None:
        parts.append(spark.createDataFrame([("flags", "class_imbalance", 0.0)], SUMMARY_SCHEMA))
    else:
        # The counts feed the shares and the flag; a target may have too many classes for one row.
        classes = materialize(class_distribution(data.df, data.target), "classes")
        parts.append(_summary_rows(classes, "y_distribution", F.col("class").cast("string"), F.col("share")))
        top = classes.agg(F.max("share").alias("top"))
        imbalanced = F.coalesce((F.col("top") >= IMBALANCE_SHARE).cast("int"), F.lit(0))
        parts.append(_summary_rows(top, "flags", F.lit("class_imbalance"), imbalanced))
    return reduce(DataFrame.unionByName, parts)


def _summary_rows(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
    columns = (F.lit(section), key, value.cast("double"))
    return df.select(*[c.alias(n) for n, c in zip(_SUMMARY, columns)])


def audit_flags(data: Dataset) -> DataFrame:
    """Rows ``(flag, raised)`` of the four warning flags."""
    return (
        eda_summary(data)
        .filter(F.col("section") == "flags")
        .select(F.col("key").alias("flag"), (F.col("value") == 1).alias("raised"))
    )

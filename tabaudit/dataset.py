"""The dataset handed from stage to stage: one frame and the roles of its columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tabaudit.functions.columns import col, content_key, missing_to_null

# Column names taken as the target when none is configured.
TARGET_NAMES = ("target", "label", "class", "y", "Target", "Label")

ROW_KEY = "__row_key"


@dataclass(frozen=True)
class Dataset:
    """Features and target are columns of the same frame, never two joined frames."""

    df: DataFrame
    features: tuple[str, ...]
    target: str | None = None
    key: str | None = None

    @property
    def x(self) -> DataFrame:
        return self.df.select(*[col(c) for c in self.features])

    @property
    def y(self) -> DataFrame | None:
        return None if self.target is None else self.df.select(col(self.target))

    def keyed(self) -> Dataset:
        """Same dataset with a row key; made from the content when none is set."""
        if self.key is not None:
            return self
        df = self.df.withColumn(ROW_KEY, content_key(self.df.columns))
        return Dataset(df, self.features, self.target, ROW_KEY)


def from_rows(spark: SparkSession, raw: Any, schema: Any = None) -> DataFrame:
    """A frame as it is, a mapping as one row, a sequence of mappings as many rows."""
    if isinstance(raw, DataFrame):
        return missing_to_null(raw)
    if isinstance(raw, Mapping):
        raw = [raw]
    if not isinstance(raw, Sequence) or isinstance(raw, (str, bytes)):
        raise ValueError(f"rows must be a frame, a mapping or a sequence of mappings, not {type(raw).__name__}")
    if schema is None and raw and all(isinstance(r, Mapping) for r in raw):
        schema = list(dict.fromkeys(name for r in raw for name in r))
        columns = [_widened([r.get(name) for r in raw]) for name in schema]
        if any(all(v is None for v in c) for c in columns):
            # A column without any value is text.
            types = spark.createDataFrame(
                [tuple(next((v for v in c if v is not None), "") for c in columns)], schema
            ).schema
            schema = types
        raw = list(zip(*columns))
    return missing_to_null(spark.createDataFrame(list(raw), schema))


def _widened(values: list[Any]) -> list[Any]:
    """Integers become floats where a column holds both."""
    numbers = [v for v in values if v is not None]
    mixed = {type(v) for v in numbers} == {int, float}
    return [float(v) if mixed and v is not None else v for v in values]


def infer_target(
    df: DataFrame, target_column: str | None = None, auto_detect: bool = True
) -> str | None:
    """The configured target if present, else the first column with a known target name."""
    if target_column and target_column in df.columns:
        return target_column
    if auto_detect:
        return next((c for c in df.columns if c in TARGET_NAMES), None)
    return None


def split_target(df: DataFrame, target: str | None, key: str | None = None) -> Dataset:
    """All columns but the target and the row key become features."""
    features = tuple(c for c in df.columns if c not in (target, key))
    return Dataset(df, features, target, key)


def attach_target(data: Dataset, name: str = "target") -> DataFrame:
    """Features and the target, renamed to ``name``."""
    if data.target is None:
        return data.x
    return data.df.select(*[col(c) for c in data.features], col(data.target).alias(name))


def attach_by_key(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """Align features and target that come apart; unmatched rows are kept."""
    return x.join(y, key, "full_outer")

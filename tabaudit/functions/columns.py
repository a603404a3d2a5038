"""Column helpers: quoting, type tests, missing values and stable row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_SEPARATOR = "\x1f"
NULL_MARK = "\x00"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, dots and blanks included."""
    return F.col(quote(name))


def all_columns(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def numeric_columns(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    """Numeric columns in table order; booleans are not numeric."""
    wanted = None if names is None else set(names)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and (wanted is None or f.name in wanted)
    ]


def other_columns(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    """The columns that :func:`numeric_columns` leaves out."""
    numeric = set(numeric_columns(df))
    return [c for c in (df.columns if names is None else names) if c not in numeric]


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL, so that both count as the same missing value."""
    floating = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c)
            for c in df.columns
        ]
    )


def content_key(names: Sequence[str]) -> Column:
    """Row key from the row's content; unique once full duplicates are gone."""
    parts = [F.coalesce(col(c).cast("string"), F.lit(NULL_MARK)) for c in names]
    return F.md5(F.concat_ws(FIELD_SEPARATOR, *parts))


def order_hash(key: str, seed: int) -> Column:
    """Seeded pseudo-random order of the rows that any engine can replay."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def stacked(df: DataFrame, names: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """One output row per entry of ``rows`` for each input row."""
    flat = [c for row in rows for c in row]
    return df.select(F.stack(F.lit(len(rows)), *flat).alias(*names))


def unpivoted(row: DataFrame, names: Sequence[str], entries: Sequence[Sequence[Column]]) -> DataFrame:
    """Turn a one-row aggregate into a long table, one struct per entry."""
    structs = [F.struct(*[c.alias(n) for n, c in zip(names, e)]) for e in entries]
    return row.select(F.explode(F.array(*structs)).alias("e")).select(
        *[F.col("e").getField(n).alias(n) for n in names]
    )

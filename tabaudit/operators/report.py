"""The report table: audit record, flags, profile location and compared models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import unpivoted

_FIELDS = ["section", "position", "key", "value"]
# The audit sections of a report, and the number format of the correlation.
AUDIT_SECTIONS = ("shape", "duplicates", "features", "flags")
CORRELATION_FORMAT = "%.3f"
WHOLE_SECTIONS = ("shape", "duplicates")


def _fact_text() -> Column:
    """A summary value as text, by section."""
    value = F.col("value")
    whole = F.col("section").isin(*WHOLE_SECTIONS) | (F.col("key") == "numeric_features")
    return (
        F.when(F.col("section") == "flags", F.when(value == 1, "True").otherwise("False"))
        .when(whole, value.cast("long").cast("string"))
        .otherwise(F.format_string(CORRELATION_FORMAT, value))
    )


def report_table(
    spark: SparkSession,
    summary: DataFrame | None = None,
    results: DataFrame | None = None,
    profile_path: str | None = None,
) -> DataFrame:
    """Rows ``(section, position, key, value)``; a part that is absent adds no rows.

    ``summary`` has rows ``(section, key, value)``; ``results`` the columns ``name``,
    ``best_score``, ``best_params`` and ``elapsed_sec`` of the compared models.
    """
    parts = []
    if summary is not None:
        order = Window.partitionBy("section").orderBy("key")
        parts.append(
            summary.filter(F.col("section").isin(*AUDIT_SECTIONS)).select(
                "section",
                F.row_number().over(order).cast("int").alias("position"),
                "key",
                F.when(F.col("value").isNotNull(), _fact_text()).alias("value"),
            )
        )
    if profile_path is not None:
        row = [("profile", 1, "path", profile_path)]
        parts.append(spark.createDataFrame(row, "section string, position int, key string, value string"))
    if results is not None:
        parts.append(_result_rows(results))
    if not parts:
        return spark.createDataFrame([], "section string, position int, key string, value string")
    return reduce(DataFrame.unionByName, parts)


def _result_rows(results: DataFrame) -> DataFrame:
    """One block of rows per compared model, best first; as many models as were declared."""
    best_first = Window.orderBy(F.desc("best_score"), "name")
    numbered = results.withColumn("__place", F.row_number().over(best_first).cast("int"))
    texts = [
        ("best_score", F.format_string("%.6f", F.col("best_score"))),
        ("params", F.to_json("best_params")),
        ("elapsed_sec", F.format_string("%.1f", F.col("elapsed_sec"))),
    ]
    entries = [
        (F.lit("results"), F.col("__place"), F.concat_ws(".", F.col("name"), F.lit(k)), v) for k, v in texts
    ]
    return unpivoted(numbered, _FIELDS, entries)

"""Run index: an append-only table of finished runs and their artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, `when` timestamp_ntz, artifacts array<string>, project string"


def append_runs(runs: DataFrame, path: str) -> None:
    """Append rows of :data:`RUN_SCHEMA`; earlier runs are neither read nor rewritten."""
    runs.write.mode("append").partitionBy("project").parquet(path)


def append_run(
    spark: SparkSession, path: str, project: str, run_id: str, when: object, artifacts: Sequence[str]
) -> None:
    append_runs(spark.createDataFrame([(run_id, when, list(artifacts), project)], RUN_SCHEMA), path)


def load_runs(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """All runs in time order; no rows if nothing was written yet."""
    try:
        runs = spark.read.schema(RUN_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        runs = spark.createDataFrame([], RUN_SCHEMA)
    if project is not None:
        runs = runs.filter(F.col("project") == project)
    return runs.orderBy("when", "run_id")

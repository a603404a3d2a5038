"""Shared scratch folder: where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tabaudit.functions.columns import all_columns

_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder.  A cluster must
    name a folder that all executors share, since written tables outlive them.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tabaudit-")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tabaudit/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Used where a costly frame (deduplicated, folded, scored) feeds several jobs.
    A written table survives lost executors and later scans prune its columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*all_columns(df))

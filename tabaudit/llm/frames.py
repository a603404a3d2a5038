"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.functions.columns import col

Batches = Iterator[pa.RecordBatch]


def text_bytes(name: str) -> Column:
    """The UTF-8 bytes of a text column; Python decodes them itself, so bad bytes cannot break a batch."""
    return col(name).cast("string").cast("binary").alias(name)


def decoded(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(docs: DataFrame, id_column: str, text_column: str, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """Run ``function`` over Arrow batches of (id, text as bytes); other columns are not read."""
    return docs.select(col(id_column), text_bytes(text_column)).mapInArrow(function, schema)


# Rows of whole texts in one Arrow batch: Spark's default of 10,000 rows is made for narrow rows.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let jobs over texts send few rows at a time to Python, which bounds the buffers of both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)


def sliced(batches: Batches, rows: int = 500) -> Batches:
    """The same rows in batches of at most ``rows``, so that what Python makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker stays for later stages


def each_text(texts: pa.Array, rows: int = 500) -> Iterator[str]:
    """The decoded texts of an array, few at a time."""
    for at in range(0, len(texts), rows):
        for value in texts.slice(at, rows).to_pylist():
            yield decoded(value)


def id_type(docs: DataFrame, name: str) -> str:
    return docs.select(col(name)).schema[0].dataType.simpleString()


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until no column of ``docs`` has them."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
        taken.add(name.lower())
    return found


def hash_cell(cells: int, *names: str) -> Column:
    return F.pmod(F.xxhash64(*[col(n) for n in names]), F.lit(cells)).cast("int")

"""CSV files cut into records by many tasks, also when quoted fields hold line breaks.

A range of a file cannot know whether it starts inside a quoted field, but the number of quotes before it tells: the field
is open when that is odd.  So quotes are counted by range first; sums over the ranges of a file give every
range its state at the start.  Then each task cuts its lines into records.  What belongs to a record of the range before, and
what is open at the end, leaves the task as a fragment, at most two for each range, and fragments
of one record are joined by their places.

Quotes are doubled inside quoted fields and do not occur in others, as in RFC 4180.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
_PIECES = "file string, start long, kind string, first boolean, record string"
# Kinds of pieces: a whole record; the end of an earlier one; one that goes on; the middle of a record.
WHOLE, HEAD, TAIL, MIDDLE = "whole", "head", "tail", "middle"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order inside a task, with the range that they come from."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def open_ranges(lines: DataFrame) -> DataFrame:
    """Rows ``(file, start, inside)``: whether a range starts inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    counted = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Range:
    """Lines of one range of a file so far, and the lines of the record that is open."""

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start, self.inside = file, start, inside
        self.held: list[str] = []
        self.fresh = not inside  # whether what is held began in this range
        self.first = start == 0

    def cut(self, values: pa.Array) -> pa.RecordBatch:
        """The records that end in these lines."""
        odd = pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False) % 2
        closed = (np.cumsum(odd) + self.inside) % 2 == 0  # no field is open after the line
        texts, found = values.to_pylist(), []
        at = 0
        for end in np.flatnonzero(closed):
            part = texts[at : end + 1]
            at = end + 1
            if self.held:
                part = self.held + part
                self.held = []
            found.append((WHOLE if self.fresh else HEAD, "\n".join(part).removesuffix("\r")))
            self.fresh = True
        self.held += texts[at:]
        self.inside = bool((odd.sum() + self.inside) % 2)
        return self._batch(found)

    def end(self) -> pa.RecordBatch:
        """What is left open at the end of the range."""
        found = [(TAIL if self.fresh else MIDDLE, "\n".join(self.held))] if self.held else []
        return self._batch(found)

    def _batch(self, found: list[tuple[str, str]]) -> pa.RecordBatch:
        n = len(found)
        first = np.zeros(n, bool)
        if n and self.first:
            first[0], self.first = True, False
        columns = [
            pa.array([self.file] * n, pa.string()), pa.array(np.full(n, self.start, np.int64)),
            pa.array([k for k, _ in found], pa.string()), pa.array(first), pa.array([r for _, r in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "first", "record"])


def _cut(inside: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        for batch in batches:
            files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
            changes = [i for i in range(batch.num_rows) if i == 0 or files[i] != files[i - 1] or starts[i] != starts[i - 1]]
            for at, end in zip(changes, [*changes[1:], batch.num_rows]):
                if now is None or (now.file, now.start) != (files[at], starts[at]):
                    if now is not None:
                        yield now.end()
                    now = _Range(files[at], starts[at], (files[at], starts[at]) in inside.value)
                yield now.cut(batch.column("value").slice(at, end - at))
        if now is not None:
            yield now.end()

    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(file, record, first)``: every record of the files below ``path``, ``first`` for the first of a file."""
    lines = _lines(spark, path)
    # Ranges that start inside a field: at most a row for each range, that is for each maxPartitionBytes of input.
    opened = open_ranges(lines).where("inside").select("file", "start").collect()
    inside = spark.sparkContext.broadcast({(r["file"], r["start"]) for r in opened})
    pieces = lines.select("value", "file", "start").mapInArrow(_cut(inside), _PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "record", "first")
    if not opened:
        # Every range starts outside fields, so no record crosses ranges but an unclosed last one.
        return whole.unionByName(pieces.where(F.col("kind") == TAIL).select("file", "record", "first"))
    parts = pieces.where(F.col("kind") != WHOLE)
    # A tail opens a chain; middles and a head belong to the last tail before them.  A range's head comes before its tail.
    place = F.struct("start", (F.col("kind") == TAIL).alias("late"))
    chain = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy(place))
    joined = parts.select("file", chain.alias("chain"), F.struct("start", "record").alias("part"), "first")
    joined = joined.groupBy("file", "chain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["record"]), "\n").alias("record"), F.max("first").alias("first")
    )
    return whole.unionByName(joined.select("file", "record", "first"))


# Types that a column without a declared type may have, the narrowest first.
_KINDS = ("int", "bigint", "double", "date", "timestamp", "boolean")


def narrowest_types(texts: DataFrame) -> DataFrame:
    """Text columns cast to the narrowest type that holds all of their values; one aggregate for all columns."""
    names = texts.columns
    fits = [F.every(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").try_cast(k).isNotNull()).alias(f"{i}_{k}") for i, n in enumerate(names) for k in _KINDS]
    some = [F.count(F.col(f"`{n}`")).alias(f"{i}_n") for i, n in enumerate(names)]
    row = texts.agg(*fits, *some).first()
    made = []
    for i, name in enumerate(names):
        kind = next((k for k in _KINDS if row[f"{i}_n"] and row[f"{i}_{k}"]), "string")
        made.append(F.col(f"`{name}`").cast(kind).alias(name))
    return texts.select(*made)

"""Most frequent values of many columns: a summary per task first, then exact counts of what can win.

Each task keeps at most ``capacity`` values of a column with a lower bound of their counts.  When it has more, the
count of the first that has no room is taken off all and added to the column's *error*.  Sums over tasks stay valid:
a value's count lies between its bound and its bound plus the error, and a value that no task kept has at
most the error.  So if the k-th largest bound is above the error, the k most frequent values are among those
whose bound plus the error reaches it, and one more scan counts these exactly.  Without any error the bounds are the counts.
Only columns that no summary decides (nearly unique ones, whose order is that of their values) shuffle all their values.

Nulls are no values.  Ties are for the caller to order: every value with at least the k-th count is returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import col, stacked
from tabaudit.functions.storage import materialize

CAPACITY = 1_000
# Candidates of one column that may be sent to all tasks.
CANDIDATES = 10_000

_COUNTS = "column string, value string, n long"


class Summary:
    """At most ``capacity`` values with lower bounds of their counts, and the error."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.low: Counter[str] = Counter()
        self.error = 0

    def add(self, values: pa.Array) -> None:
        counted = pc.value_counts(values.drop_null())
        self.low.update(dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist())))
        if len(self.low) > self.capacity:
            first_out = sorted(self.low.values(), reverse=True)[self.capacity]
            self.error += first_out
            self.low = Counter({v: n - first_out for v, n in self.low.items() if n > first_out})


def summaries(df: DataFrame, names: Sequence[str], capacity: int = CAPACITY) -> DataFrame:
    """Rows ``(column, value, low)`` from one scan; the row with a null ``value`` has the column's error."""
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Summary(capacity) for _ in names]
        for batch in batches:
            for summary, values in zip(kept, batch.columns):
                summary.add(values)
        for name, summary in zip(names, kept):
            entries = [(None, summary.error), *summary.low.items()]
            values, low = zip(*entries)
            columns = [pa.array([name] * len(entries)), pa.array(values, pa.string()), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["column", "value", "low"])

    parts = df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    found = parts.mapInArrow(run, "column string, value string, low long")
    return found.groupBy("column", "value").agg(F.sum("low").alias("low"))


@dataclass
class Decision:
    """Columns whose bounds are counts, columns with their least bound of a candidate, and columns without a decision."""

    exact: list[str] = field(default_factory=list)
    least: dict[str, int] = field(default_factory=dict)
    open: list[str] = field(default_factory=list)


def decide(found: DataFrame, names: Sequence[str], k: int, candidates: int = CANDIDATES) -> Decision:
    """How the top ``k`` of each column can be had from a written table of ``summaries``."""
    errors = {r["column"]: r["low"] for r in found.where(F.col("value").isNull()).collect()}
    bounds = found.where(F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("low"), "value"))
    ranked = bounds.withColumn("place", place).where(F.col("place") == k)
    reached = {r["column"]: r["low"] for r in ranked.collect()}
    decision = Decision()
    for name in names:
        error = errors.get(name, 0)
        if not error:
            decision.exact.append(name)
        elif reached.get(name, 0) > error:
            decision.least[name] = reached[name] - error
        else:
            decision.open.append(name)
    if decision.least:
        many = _above(bounds, decision.least).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        for r in many.where(F.col("n") > candidates).collect():
            del decision.least[r["column"]]
            decision.open.append(r["column"])
    return decision


def _above(bounds: DataFrame, least: dict[str, int]) -> DataFrame:
    wanted = reduce(lambda a, b: a | b, ((F.col("column") == c) & (F.col("low") >= n) for c, n in least.items()))
    return bounds.where(wanted)


def _counted(df: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [(F.lit(c), col(c).cast("string")) for c in names]
    return stacked(df, ["column", "value"], rows).where(F.col("value").isNotNull())


def frequent_values(
    df: DataFrame, names: Sequence[str], k: int, capacity: int = CAPACITY, candidates: int = CANDIDATES
) -> DataFrame:
    """Rows ``(column, value, n)`` with at least the ``k`` most frequent values of each column and all ties with them."""
    names = list(names)
    if not names or k < 1:
        return df.sparkSession.createDataFrame([], _COUNTS)
    found = materialize(summaries(df, names, capacity), "frequent")
    decision = decide(found, names, k, candidates)
    parts = []
    if decision.exact:
        exact = found.where(F.col("column").isin(decision.exact) & F.col("value").isNotNull())
        parts.append(exact.select("column", "value", F.col("low").alias("n")))
    if decision.least:
        # At most ``candidates`` rows a column, counted by ``decide``.
        chosen = _above(found.where(F.col("value").isNotNull()), decision.least).select("column", "value")
        parts.append(_counted(df, list(decision.least)).join(F.broadcast(chosen), ["column", "value"], "left_semi"))
    if decision.open:
        parts.append(_counted(df, decision.open))
    counted = [p if "n" in p.columns else p.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")) for p in parts]
    return reduce(DataFrame.unionByName, counted)

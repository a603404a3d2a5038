"""Exact quantiles (linear interpolation) of many columns at any size.

Spark's ``percentile`` keeps every distinct value of a column in one task, so it is
used for few values only.  Beyond that the value at a wanted rank is searched by
counting: each round splits the interval that holds the rank into equal bins, counts
the rows per bin, and goes on inside the bin of the rank.  All columns and quantiles
share the same scans, counts are merged before the shuffle, and no step sorts or
gathers a column.  A value held by a large part of the rows ends its search early.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values in all columns together up to which one task per column may hold them.
SMALL_VALUES = 4_000_000
# Rows in an interval from which on its values are counted one by one.
INTERVAL_ROWS = 50_000
BINS = 1_024

Interval = tuple[str, float, float]


@dataclass
class _Search:
    """One wanted quantile: its ranks, and the interval of values that holds them."""

    column: str
    position: float
    low: float
    high: float
    below: int
    inside: int
    first_value: float | None = None
    second_value: float | None = None

    def __post_init__(self) -> None:
        self.first, self.second = math.floor(self.position), math.ceil(self.position)
        self.settle()

    def settle(self) -> None:
        if self.low == self.high:
            self.first_value = self.second_value = self.low

    @property
    def interval(self) -> Interval:
        return self.column, self.low, self.high

    @property
    def found(self) -> bool:
        return self.first_value is not None

    @property
    def value(self) -> float:
        share = self.position - self.first
        if not share:
            return self.first_value
        return (1 - share) * self.first_value + share * self.second_value


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    small_values: int = SMALL_VALUES,
    interval_rows: int = INTERVAL_ROWS,
    bins: int = BINS,
) -> dict[str, list[float | None]]:
    """Quantiles of each named column expression, nulls ignored."""
    if not columns:
        return {}
    probabilities = [float(p) for p in probabilities]
    slots = {name: f"q{i}" for i, name in enumerate(columns)}
    values = df.select(*[c.cast("double").alias(slots[n]) for n, c in columns.items()])
    if values.count() * len(columns) <= small_values:
        wanted = F.array(*[F.lit(p) for p in probabilities])
        row = values.agg(*[F.percentile(F.col(s), wanted).alias(s) for s in slots.values()]).first()
        empty = [None] * len(probabilities)
        return {n: list(row[s]) if row[s] is not None else list(empty) for n, s in slots.items()}
    found = _search(values, list(slots.values()), probabilities, interval_rows, bins)
    return {n: found[s] for n, s in slots.items()}


def _search(
    values: DataFrame, slots: list[str], probabilities: list[float], interval_rows: int, bins: int
) -> dict[str, list[float | None]]:
    asked = [f(F.col(s)).alias(f"{k}_{s}") for s in slots for k, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    row = values.agg(*asked).first()
    searches = {
        (s, i): _Search(s, (row[f"n_{s}"] - 1) * p, row[f"low_{s}"], row[f"high_{s}"], 0, row[f"n_{s}"])
        for s in slots
        if row[f"n_{s}"]
        for i, p in enumerate(probabilities)
    }
    while wide := [x for x in searches.values() if not x.found and x.inside > interval_rows]:
        _split(values, wide, bins)
    if narrow := [x for x in searches.values() if not x.found]:
        _count_values(values, narrow)
    return {
        s: [searches[(s, i)].value if (s, i) in searches else None for i in range(len(probabilities))]
        for s in slots
    }


def _members(values: DataFrame, intervals: Sequence[Interval]) -> DataFrame:
    """Rows ``(i, v)``: the values of each interval's column that lie in it."""
    entries = []
    for i, (column, low, high) in enumerate(intervals):
        value = F.col(column)
        inside = (value >= F.lit(low)) & (value <= F.lit(high))
        entries.append(F.when(inside, F.struct(F.lit(i).alias("i"), value.alias("v"))))
    hits = F.explode(F.array_compact(F.array(*entries)))
    return values.select(hits.alias("e")).select("e.i", "e.v")


def _at_rank(intervals: Sequence[Interval], searches: Sequence[_Search]) -> Column:
    """Whether a counted part, rows ``upto - n`` to ``upto`` of its interval, holds a wanted rank."""
    places = {interval: i for i, interval in enumerate(intervals)}
    wanted: list[set[int]] = [set() for _ in intervals]
    for x in searches:
        wanted[places[x.interval]].update((x.first - x.below, x.second - x.below))
    listed = F.get(F.lit([sorted(ranks) for ranks in wanted]).cast("array<array<bigint>>"), F.col("i"))
    return F.exists(listed, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))


def _bin_of(intervals: Sequence[Interval], bins: int) -> Column:
    """The bin of a value ``v`` in its interval ``i``.

    Ends are looked up by ``i``, so the work for a value does not grow with the number of intervals.
    """
    starts, widths = [], []
    for _, low, high in intervals:
        # Infinite ends are cut to the largest double; halves avoid an overflow.
        half_low = max(low, -sys.float_info.max) / 2
        half_width = min(high, sys.float_info.max) / 2 - half_low
        starts.append(half_low)
        widths.append(half_width or sys.float_info.min)
    finite = F.least(F.greatest(F.col("v"), F.lit(-sys.float_info.max)), F.lit(sys.float_info.max))
    share = (finite / 2 - F.get(F.lit(starts), F.col("i"))) / F.get(F.lit(widths), F.col("i"))
    place = F.least(F.floor(F.greatest(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    # The infinities get bins of their own.
    return F.when(F.col("v") == -math.inf, -1).when(F.col("v") == math.inf, bins).otherwise(place)


def _split(values: DataFrame, searches: list[_Search], bins: int) -> None:
    """One round: bin the open intervals and go on inside the bins of the wanted ranks."""
    intervals = list(dict.fromkeys(x.interval for x in searches))
    counted = (
        _members(values, intervals)
        .groupBy("i", _bin_of(intervals, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("bin")))
    )
    rows = counted.filter(_at_rank(intervals, searches)).collect()
    places = {interval: i for i, interval in enumerate(intervals)}
    for x in searches:
        mine = [r for r in rows if r["i"] == places[x.interval]]
        at_first, at_second = (
            next(r for r in mine if r["upto"] - r["n"] <= rank - x.below < r["upto"])
            for rank in (x.first, x.second)
        )
        if at_first["bin"] != at_second["bin"]:
            # Neighbouring ranks in two bins: the last of one, the first of the other.
            x.first_value, x.second_value = at_first["high"], at_second["low"]
        else:
            x.low, x.high = at_first["low"], at_first["high"]
            x.below, x.inside = x.below + at_first["upto"] - at_first["n"], at_first["n"]
            x.settle()


def _count_values(values: DataFrame, searches: list[_Search]) -> None:
    """Count the few values left in each interval and take the wanted ranks."""
    intervals = list(dict.fromkeys(x.interval for x in searches))
    counted = (
        _members(values, intervals)
        .groupBy("i", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
    )
    rows = counted.filter(_at_rank(intervals, searches)).collect()
    places = {interval: i for i, interval in enumerate(intervals)}
    for x in searches:
        mine = [r for r in rows if r["i"] == places[x.interval]]
        x.first_value, x.second_value = (
            next(r["v"] for r in mine if r["upto"] - r["n"] <= rank - x.below < r["upto"])
            for rank in (x.first, x.second)
        )

"""Exact ranks and running totals without one task per group.

A plain ``row_number() over (partition by class ...)`` sends a whole class to one
task.  Here every group is cut into cells that follow the wanted order: hash
prefixes for hash order, sketched split points for numeric order.  Rows are
numbered inside a cell and moved by the number of rows in earlier cells, which
gives the same numbers with tasks of even size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import all_columns, col

STRATUM = "__stratum"
_CELL, _HASH, _SIZE, _EARLIER = "__cell", "__hash", "__size", "__earlier"


def hash_digits(spark: SparkSession) -> int:
    """Hex digits of a hash prefix, so that a group has many cells per task."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    digits = 1
    while 16**digits < wanted and digits < 5:
        digits += 1
    return digits


def range_buckets(spark: SparkSession) -> int:
    return min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 16), 4096)


def hash_rank(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    key: str,
    rank: str = "rn",
    across_groups: bool = False,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Add ``rank``: the 1-based position in the group by ``order`` (a hex hash), ``key``.

    ``per_group`` has a row of further columns for each ``STRATUM`` (a struct of the
    groups).  They reach the rows with the offsets of the cells, so rows are never moved by group.

    Hash prefixes spread any group, hot or not, over cells of even size.  With
    ``across_groups`` the count goes on from group to group, in group order; the
    cells are then ordered in one task, so use it for few groups (classes).
    """
    digits = hash_digits(df.sparkSession)
    cell = F.struct(*[col(g) for g in groups], F.substring(order, 1, digits).alias("prefix"))
    rows = df.withColumn(_HASH, order).withColumn(_CELL, cell)
    sizes = df.select(cell.alias(_CELL)).groupBy(_CELL).agg(F.count(F.lit(1)).alias(_SIZE))
    before = Window.orderBy(_CELL)
    if not across_groups:
        before = Window.partitionBy(*[F.col(_CELL)[g] for g in groups]).orderBy(F.col(_CELL)["prefix"])
    earlier = F.sum(_SIZE).over(before) - F.col(_SIZE)
    offsets = sizes.select(_CELL, earlier.alias(_EARLIER))
    further = []
    if per_group is not None:
        stratum = F.struct(*[F.col(_CELL)[g].alias(g) for g in groups])
        offsets = offsets.withColumn(STRATUM, stratum).join(per_group, STRATUM).drop(STRATUM)
        further = [c for c in per_group.columns if c != STRATUM]
    inside = Window.partitionBy(_CELL).orderBy(_HASH, col(key))
    numbered = rows.withColumn(rank, F.row_number().over(inside)).join(offsets, _CELL)
    return numbered.withColumn(rank, F.col(rank) + F.col(_EARLIER)).select(*all_columns(df), rank, *further)


def spread_sum(df: DataFrame, mark: str, key: str, amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before this one in order of ``mark`` (a hex hash), ``key``."""
    prefix = F.substring(F.col(mark), 1, hash_digits(df.sparkSession))
    rows = df.withColumn(_CELL, prefix)
    sizes = rows.groupBy(_CELL).agg(F.sum(amount).alias(_SIZE))
    # Bounded by the number of prefixes.
    offsets = sizes.select(_CELL, (F.sum(_SIZE).over(Window.orderBy(_CELL)) - F.col(_SIZE)).alias(_EARLIER))
    inside = Window.partitionBy(_CELL).orderBy(mark, col(key))
    summed = rows.withColumn(name, F.sum(amount).over(inside) - F.col(amount)).join(offsets, _CELL)
    return summed.withColumn(name, F.col(name) + F.col(_EARLIER)).select(*all_columns(df), name)


def split_points(df: DataFrame, column: str, buckets: int) -> tuple[list[float], list[float]]:
    """Sketched quantiles of ``column`` and the values that span several of them.

    Both lists have at most ``buckets`` entries; they only steer the layout, so
    the sketch error moves work between tasks and never changes a result.
    """
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketch = F.percentile_approx(col(column).cast("double"), points, 10 * buckets)
    found = df.agg(sketch.alias("p")).first()["p"] or []
    unique = sorted(set(found))
    hot = [v for v in unique if found.count(v) > 1]
    return unique, hot


def with_bucket(df: DataFrame, column: str, points: Sequence[float], bucket: str) -> DataFrame:
    """Add the range bucket of ``column``: values of one bucket lie between two points."""
    splits = [float("-inf"), *points, float("inf")]
    if len(splits) == 2:
        return df.withColumn(bucket, F.lit(0))
    binned = Bucketizer(splits=splits, inputCol="__value", outputCol=bucket).transform(
        df.withColumn("__value", col(column).cast("double"))
    )
    return binned.withColumn(bucket, F.col(bucket).cast("int")).drop("__value")


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    totals: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums per group by a numeric order; one row per group and value.

    ``totals`` maps the new column to the summed column.  Call it on frames that
    are already aggregated by ``(groups, order)``, so no single value is hot.
    """
    points, _ = split_points(df, order, range_buckets(df.sparkSession))
    rows = with_bucket(df, order, points, "__bucket")
    rows = rows.withColumn(_CELL, F.struct(*[col(g) for g in groups], F.col("__bucket")))

    def directed(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    sizes = rows.groupBy(_CELL).agg(*[F.sum(col(s)).alias(t) for t, s in totals.items()])
    by_bucket = (
        Window.partitionBy(*[F.col(_CELL)[g] for g in groups]) if groups else Window.partitionBy()
    ).orderBy(directed(f"{_CELL}.__bucket"))
    offsets = sizes.select(
        _CELL,
        *[(F.sum(t).over(by_bucket) - F.col(t)).alias(f"__before_{t}") for t in totals],
    )
    inside = Window.partitionBy(_CELL).orderBy(directed(order))
    summed = rows
    for total, source in totals.items():
        summed = summed.withColumn(total, F.sum(col(source)).over(inside))
    summed = summed.join(offsets, _CELL)
    for total in totals:
        summed = summed.withColumn(total, F.col(total) + F.col(f"__before_{total}"))
    return summed.select(*all_columns(df), *totals)


def global_rank(
    df: DataFrame, order: str, tie_break: Column, key: str, rank: str = "rn"
) -> DataFrame:
    """Add ``rank``: the 1-based position in the whole table by ``order``, ``tie_break``, ``key``.

    A value of ``order`` that holds many rows is cut further by hash prefix.
    """
    spark = df.sparkSession
    points, hot = split_points(df, order, range_buckets(spark))
    # A hot value is a split point, hence the smallest value of its bucket; its
    # prefixes sort before the mark of the other rows of the bucket.
    prefix = F.substring(F.col(_HASH), 1, hash_digits(spark))
    is_hot = col(order).cast("double").isin(hot) if hot else F.lit(False)
    rows = with_bucket(df.withColumn(_HASH, tie_break), order, points, "__bucket")
    rows = rows.withColumn(
        _CELL, F.struct(F.col("__bucket"), F.when(is_hot, prefix).otherwise("~").alias("prefix"))
    )
    sizes = rows.groupBy(_CELL).agg(F.count(F.lit(1)).alias(_SIZE))
    # Bounded by buckets x prefixes, whatever the table holds.
    earlier = F.sum(_SIZE).over(Window.orderBy(_CELL)) - F.col(_SIZE)
    offsets = sizes.select(_CELL, earlier.alias(_EARLIER))
    inside = Window.partitionBy(_CELL).orderBy(col(order), _HASH, col(key))
    numbered = rows.withColumn(rank, F.row_number().over(inside)).join(offsets, _CELL)
    return numbered.withColumn(rank, F.col(rank) + F.col(_EARLIER)).select(*all_columns(df), rank)

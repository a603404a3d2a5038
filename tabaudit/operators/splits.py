"""Splitters: stratified folds and holdout, group folds and time blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import all_columns, col, order_hash
from tabaudit.functions.joins import join_hot_keys
from tabaudit.functions.ranking import STRATUM, global_rank, hash_rank, spread_sum
from tabaudit.functions.storage import materialize

# Defaults of the splitters.
SEED = 42
FOLDS = 5
TEST_SHARE = 0.2
# Groups of which fewer than folds * LARGE_PARTS fit in a table are placed one by one.
LARGE_PARTS = 20


def _class_sizes(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))


def stratified_folds(
    df: DataFrame, target: str, key: str, folds: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Add a fold 0..folds-1: each class is dealt out in seeded hash order.

    Dealing goes on from class to class, so the folds differ by at most one row,
    in total and per class.
    """
    ranked = hash_rank(df, [target], order_hash(key, seed), key, "__rn", across_groups=True)
    fold = ((F.col("__rn") - 1) % folds).cast("int")
    return ranked.select(*all_columns(df), fold.alias(name))


def stratified_holdout(
    df: DataFrame,
    target: str,
    key: str,
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    name: str = "is_test",
) -> DataFrame:
    """Add a flag for ceil(share * n) test rows, spread over classes by largest remainder."""
    sizes = _class_sizes(df, target)
    total = F.sum("__n").over(Window.partitionBy())
    wanted = F.ceil(F.lit(test_share) * total)
    exact = F.col("__n") * wanted / total
    shares = sizes.select("__class", exact.alias("__exact"), wanted.alias("__wanted")).withColumn(
        "__whole", F.floor("__exact")
    )
    missing = F.col("__wanted") - F.sum("__whole").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("__exact") - F.col("__whole")), "__class"))
    quota = F.col("__whole") + F.when(place <= missing, 1).otherwise(0)
    quotas = shares.select(F.struct(F.col("__class").alias(target)).alias(STRATUM), quota.alias("__quota"))
    ranked = hash_rank(df, [target], order_hash(key, seed), key, "__rn", per_group=quotas)
    return ranked.select(*all_columns(df), (F.col("__rn") <= F.col("__quota")).alias(name))


def group_fold_table(df: DataFrame, group: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Rows ``(group, n, fold)``: groups from large to small are dealt out in turn.

    Groups of one size are ordered by seeded hash and ranked in hash cells.  Only
    the table of distinct sizes, at most sqrt(2 n) rows, is ordered as a whole.
    """
    sizes = df.groupBy(col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    per_size = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("__groups"))
    earlier = F.sum("__groups").over(Window.orderBy(F.desc("n"))) - F.col("__groups")
    starts = per_size.select("n", earlier.alias("__start"))
    ranked = hash_rank(sizes, ["n"], order_hash("group", seed), "group", "__rn")
    fold = ((F.col("__start") + F.col("__rn") - 1) % folds).cast("int")
    return ranked.join(starts, "n").select("group", "n", fold.alias("fold"))


def group_folds(
    df: DataFrame, group: str, folds: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Add a fold such that no group crosses folds."""
    table = materialize(group_fold_table(df, group, folds, seed), "group-folds")
    table = table.select(F.struct("group").alias("__group"), F.col("fold").alias(name), "n")
    rows = df.withColumn("__group", F.struct(col(group).alias("group")))
    return join_hot_keys(rows, table, "__group", "n").select(*all_columns(df), name)


def _levels(loads: Sequence[int], rows: int) -> list[int]:
    """Where the folds end on a line of ``rows`` rows that fills them all to one level, as far as their loads allow."""
    filled, level = 0, math.inf
    for k, load in enumerate(sorted(loads), 1):
        filled += load
        level = min(level, (rows + filled) / k)
    ends, at = [], 0.0
    for load in loads:
        at += max(level - load, 0.0)
        ends.append(math.floor(at + 1e-6))
    return ends


def balanced_group_table(df: DataFrame, group: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Rows ``(group, n, fold)`` with folds of even size.

    Groups above ``1 / (folds * LARGE_PARTS)`` of the rows, at most that many by definition, go one by one to the
    emptiest fold, largest first (Graham 1969).  The others lie in seeded hash order on a line, which is cut
    so that every fold comes up to one level; a group belongs to the fold in which it starts.  So folds differ
    from the level by less than one small group, unless a single group is larger than it.
    """
    sizes = materialize(df.groupBy(col(group).alias("group")).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    is_large = F.col("n") * (folds * LARGE_PARTS) > total
    mark = F.coalesce(order_hash("group", seed), F.lit(""))
    large = sizes.filter(is_large).orderBy(F.desc("n"), mark, "group").collect()
    loads, places = [0] * folds, []
    for row in large:
        fold = loads.index(min(loads))
        loads[fold] += row["n"]
        places.append((row["group"], row["n"], fold))
    first = spread_sum(sizes.filter(~is_large).withColumn("__mark", mark), "__mark", "group", "n", "__first")
    fold = F.lit(0)
    for end in _levels(loads, total - sum(loads))[:-1]:
        fold = fold + (F.col("__first") >= end).cast("int")
    small = first.select("group", "n", fold.alias("fold"))
    kind = sizes.schema["group"].dataType.simpleString()
    return df.sparkSession.createDataFrame(places, f"group {kind}, n long, fold int").unionByName(small)


def balanced_group_folds(
    df: DataFrame, group: str, folds: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Add a fold such that no group crosses folds and folds are even; null is a group."""
    table = materialize(balanced_group_table(df, group, folds, seed), "balanced-folds")
    table = table.select(F.struct("group").alias("__group"), F.col("fold").alias(name), "n")
    rows = df.withColumn("__group", F.struct(col(group).alias("group")))
    return join_hot_keys(rows, table, "__group", "n").select(*all_columns(df), name)


def time_blocks(
    df: DataFrame, order: str, key: str, splits: int = FOLDS, seed: int = SEED, name: str = "block"
) -> DataFrame:
    """Add a block 0..splits: ``splits + 1`` consecutive blocks of even size by time.

    ``order`` is a numeric time.  Split i trains on blocks below i and tests on
    block i, for i in 1..splits; see :func:`time_split`.
    """
    blocks = splits + 1
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = global_rank(df, order, order_hash(key, seed), key, "__rn").withColumn("__total", total)
    # The first (n mod blocks) blocks are one row longer.
    small = F.floor(F.col("__total") / blocks)
    longer = F.col("__total") % blocks
    border = longer * (small + 1)
    index = F.col("__rn") - 1
    block = F.when(index < border, F.floor(index / (small + 1))).otherwise(
        longer + F.floor(F.try_divide(index - border, small))
    )
    return ranked.select(*all_columns(df), block.cast("int").alias(name))


def time_split(blocked: DataFrame, split: int, name: str = "block") -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one expanding split."""
    return blocked.filter(F.col(name) < split), blocked.filter(F.col(name) == split)

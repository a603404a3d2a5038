"""Class balancing for training folds: under-, over- and synthetic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import all_columns, col, order_hash
from tabaudit.functions.ranking import STRATUM, hash_rank
from tabaudit.operators.splits import SEED

# Copies of one row made by one task before the work is spread again.
COPIES_PER_TASK = 1_000


def class_extent(df: DataFrame, target: str) -> tuple[int, int]:
    sizes = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    return row["low"] or 0, row["high"] or 0


def undersample(df: DataFrame, target: str, key: str, seed: int = SEED) -> DataFrame:
    """Keep as many rows of each class as the smallest class has."""
    smallest, _ = class_extent(df, target)
    ranked = hash_rank(df, [target], order_hash(key, seed), key, "__rn")
    return ranked.filter(F.col("__rn") <= smallest).select(*all_columns(df))


def oversample(
    df: DataFrame, target: str, key: str, seed: int = SEED, name: str = "copy"
) -> DataFrame:
    """Repeat rows until each class is as large as the largest; ``copy`` counts from 1.

    When a row needs very many copies they are made in two steps, with a
    repartition between, so a tiny class does not burden one task.
    """
    smallest, largest = class_extent(df, target)
    counted = copy_counts(df, target, key, largest, seed)
    return repeated(counted, key, largest > smallest * COPIES_PER_TASK, name).select(*all_columns(df), name)


def copy_counts(df: DataFrame, target: str, key: str, largest: int, seed: int) -> DataFrame:
    """Add ``__copies``: how often each row must occur for its class to have ``largest`` rows."""
    stratum = F.struct(col(target).alias(target)).alias(STRATUM)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    ranked = hash_rank(df, [target], order_hash(key, seed), key, "__rn", per_group=sizes)
    whole = F.floor(F.lit(largest) / F.col("__n"))
    extra = F.when(F.col("__rn") <= F.lit(largest) % F.col("__n"), 1).otherwise(0)
    return ranked.select(*all_columns(df), (whole + extra).cast("long").alias("__copies"))


def repeated(counted: DataFrame, key: str, many: bool, name: str) -> DataFrame:
    """Each row ``__copies`` times, numbered from 1; in two steps when there are ``many``."""
    one = F.lit(1).cast("long")
    if not many:
        return counted.withColumn(name, F.explode(F.sequence(one, F.col("__copies"))))
    lots = F.sequence(one * 0, F.floor((F.col("__copies") - 1) / COPIES_PER_TASK))
    spread = counted.withColumn("__lot", F.explode(lots)).repartition(col(key), F.col("__lot"))
    first = F.col("__lot") * COPIES_PER_TASK + 1
    last = F.least(first + (COPIES_PER_TASK - 1), F.col("__copies"))
    return spread.withColumn(name, F.explode(F.sequence(first, last)))

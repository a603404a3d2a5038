"""Join of rows to a table of their keys when a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key above 1 / HOT_KEYS of the rows is hot; so at most that many keys are.
HOT_KEYS = 10_000


def join_hot_keys(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one table row per key.

    ``size`` is the number of rows of each key.  Hot keys are broadcast, at most
    ``HOT_KEYS`` of them by their definition, so their rows are not shuffled; the
    other keys are small and take an ordinary join.  Both sides are read twice:
    pass tables that are written, not long plans.
    """
    total = table.agg(F.sum(size).alias("n")).scalar()
    marked = table.withColumn("__hot", F.col(size) * HOT_KEYS > total)
    hot = F.broadcast(marked.filter("__hot").drop("__hot", size))
    cold = marked.filter(~F.col("__hot")).drop("__hot", size)
    few = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(few)

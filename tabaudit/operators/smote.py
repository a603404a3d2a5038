"""Synthetic minority rows: points between a row and one of its nearest neighbours.

SMOTE (Chawla et al., 2002).  Neighbours come from hash tables with a bounded number of candidates
per row (``neighbours.py``), for all classes at once; a class of up to ``CELL_ROWS`` distinct vectors is one bucket,
so its neighbours are exact.

``method="exact"`` compares further.  Distinct vectors are cut into
blocks of bounded size along a random direction; as a projection never enlarges a
distance, a row only needs the blocks within its best distance so far.  Tasks see
two blocks at a time and return at most k neighbours per row.  In many dimensions nearly
all blocks are within reach and the work grows with the square of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.joins import join_hot_keys
from tabaudit.functions.ranking import split_points, with_bucket
from tabaudit.functions.storage import materialize
from tabaudit.operators.neighbours import hashed_neighbours
from tabaudit.operators.sampling import COPIES_PER_TASK, class_extent, copy_counts, repeated
from tabaudit.operators.splits import SEED

NEIGHBOURS = 5
BLOCK_ROWS = 2_000
METHODS = ("hashed", "exact")
_CHUNK_VALUES = 4_000_000

_NEAR = "vector array<double>, squared double, near array<double>, near_size long"


def _nearest(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k points nearest to each query, itself excluded; ties by vector."""
    points = points.sort_values("vector", key=lambda s: s.map(tuple)).reset_index(drop=True)
    there = np.stack(points["vector"].to_numpy())
    here = np.stack(queries["vector"].to_numpy())
    step = max(_CHUNK_VALUES // there.size, 1)
    for start in range(0, len(here), step):
        part = here[start : start + step]
        squared = ((part[:, None, :] - there[None, :, :]) ** 2).sum(axis=2)
        squared[(part[:, None, :] == there[None, :, :]).all(axis=2)] = np.inf
        order = np.argsort(squared, axis=1, kind="stable")[:, :k]
        row, place = np.nonzero(np.isfinite(np.take_along_axis(squared, order, axis=1)))
        near = order[row, place]
        yield pd.DataFrame(
            {
                "vector": list(part[row]),
                "squared": squared[row, near],
                "near": list(there[near]),
                "near_size": points["size"].to_numpy()[near],
            }
        )


def nearest_vectors(points: DataFrame, k: int, seed: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``(vector, rank, near, near_size)``: the k nearest other vectors of each vector.

    ``points`` holds distinct ``vector array<double>`` and their ``size``.
    """
    spark = points.sparkSession
    n = points.count()
    p = len(points.select("vector").first()["vector"])
    direction = np.random.default_rng(seed).normal(size=p)
    direction = direction / np.linalg.norm(direction)
    weights = F.array(*[F.lit(float(w)) for w in direction])
    at = F.aggregate(F.zip_with("vector", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    placed = points.select(at.alias("at"), "vector", "size")
    wanted = -(-n // block_rows)
    cuts, _ = split_points(placed, "at", wanted) if wanted > 1 else ([], [])
    blocks = materialize(with_bucket(placed, "at", cuts, "block"), "blocks")

    def within(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(_nearest(block, block, k)), ignore_index=True)

    def across(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({c: [] for c in ("vector", "squared", "near", "near_size")})
        block = block.rename(columns={"point": "vector"})
        return pd.concat(list(_nearest(queries, block, k)), ignore_index=True)

    found = blocks.groupBy("block").applyInPandas(within, _NEAR)
    if cuts:
        found = materialize(found, "near")
        # Best k-th distance so far; infinite with fewer than k in the block.
        reach = found.groupBy("vector").agg(
            F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("squared"))).otherwise(F.lit(float("inf"))).alias("reach")
        )
        # Slack for the rounding of the projection.
        slack = F.lit(1e-9) * (F.abs("at") + F.lit(1.0))
        within_reach = (
            blocks.join(reach, "vector", "left")
            .withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
            .withColumn("low", F.col("at") - F.col("reach") - slack)
            .withColumn("high", F.col("at") + F.col("reach") + slack)
        )
        within_reach = with_bucket(with_bucket(within_reach, "low", cuts, "first"), "high", cuts, "last")
        asked = (
            within_reach.withColumn("other", F.explode(F.sequence("first", "last")))
            .filter(F.col("other") != F.col("block"))
            .select("block", "other", "vector")
        )
        pairs = asked.select("block", "other").distinct()
        there = [F.col(a).alias(b) for a, b in (("block", "other"), ("vector", "point"), ("size", "size"))]
        served = pairs.join(blocks.select(*there), "other").select(
            F.col("block").alias("block"), F.col("other").alias("other"), "point", "size"
        )
        more = asked.groupBy("block", "other").cogroup(served.groupBy("block", "other"))
        found = found.unionByName(more.applyInPandas(across, _NEAR))
    # At most k rows per pair of blocks and vector meet here.
    nearest = F.row_number().over(Window.partitionBy("vector").orderBy("squared", "near"))
    return found.withColumn("rank", nearest).filter(F.col("rank") <= k).select("vector", "rank", "near", "near_size")


def _exact_neighbours(points: DataFrame, k: int, seed: int) -> DataFrame:
    """The neighbours of every class, one after another."""
    found = []
    for row in points.select("group").distinct().collect():
        of_class = materialize(points.filter(F.col("group").eqNullSafe(F.lit(row["group"]))).select("vector", "size"), "points")
        group = F.lit(row["group"]).cast(points.schema["group"].dataType)
        found.append(nearest_vectors(of_class, k, seed).select(group.alias("group"), "vector", "rank", "near", "near_size"))
    return reduce(DataFrame.unionByName, found)


def _neighbour_slots(points: DataFrame, k: int, seed: int, method: str) -> DataFrame:
    """Rows ``(group, vector, size, slots)``: the vectors of the k nearest rows.

    Copies of a row are its nearest neighbours, then come the other vectors, each
    as often as it occurs.
    """
    points = materialize(points, "points")
    near = _exact_neighbours(points, k, seed) if method == "exact" else hashed_neighbours(points, k, seed)
    lists = near.groupBy("group", "vector").agg(
        F.array_sort(F.collect_list(F.struct("rank", "near", "near_size"))).alias("others")
    )
    own = F.array_repeat(F.col("vector"), F.least(F.col("size") - 1, F.lit(k)).cast("int"))
    others = F.flatten(
        F.transform("others", lambda o: F.array_repeat(o["near"], F.least(o["near_size"], F.lit(k)).cast("int")))
    )
    slots = F.slice(F.concat(own, F.coalesce(others, F.array().cast("array<array<double>>"))), 1, k)
    return points.join(lists, ["group", "vector"], "left").select("group", "vector", "size", slots.alias("slots"))


def _hex_number(text: Column, start: int) -> Column:
    return F.conv(F.substring(text, start, 8), 16, 10).cast("long")


def smote(
    df: DataFrame,
    target: str,
    key: str,
    vector: str,
    seed: int = SEED,
    k: int = NEIGHBOURS,
    method: str = "hashed",
) -> DataFrame:
    """``df`` and synthetic rows, until each class is as large as the largest.

    ``vector`` is an ML vector or an array of doubles.  Each row gets its share of
    copies; a copy moves towards one of the k nearest rows of its class, neighbour
    and distance taken from a seeded hash.  Other columns than target, key and
    vector are null in synthetic rows.  ``method`` finds neighbours, see above.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    is_vector = isinstance(df.schema[vector].dataType, VectorUDT)
    values = vector_to_array(col(vector)) if is_vector else col(vector).cast("array<double>")
    smallest, largest = class_extent(df, target)
    rows = df.select(
        col(target).alias("__class"), col(key).cast("string").alias("__name"), values.alias("vector")
    )
    sizes = rows.groupBy("__class").agg(F.count(F.lit(1)).alias("n"))
    short = [r["__class"] for r in sizes.filter(F.col("n") < largest).collect()]
    if not short:
        return df
    counted = copy_counts(rows, "__class", "__name", largest, seed)
    minority = materialize(counted.filter(F.col("__class").isin(short)), "minority")
    points = minority.groupBy(F.col("__class").alias("group"), "vector").agg(F.count(F.lit(1)).alias("size"))
    slots = materialize(_neighbour_slots(points, k, seed, method), "slots")
    # A vector with many copies in a class is a hot key.
    place = F.struct(F.col("__class").alias("group"), F.col("vector").alias("vector"))
    slots = slots.select(F.struct("group", "vector").alias("__place"), "size", "slots")
    known = join_hot_keys(minority.withColumn("__place", place), slots, "__place", "size").drop("__place")
    copies = repeated(known, "__name", largest > smallest * COPIES_PER_TASK, "__copy")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), "__name", F.col("__copy").cast("string")))
    copies = copies.filter(F.col("__copy") > 1).withColumn("__mark", mark)
    slot = F.try_element_at("slots", (_hex_number(F.col("__mark"), 1) % F.size("slots") + 1).cast("int"))
    gap = _hex_number(F.col("__mark"), 9).cast("double") / float(2**32)
    copies = copies.withColumn("__to", F.when(F.size("slots") > 0, slot).otherwise(F.col("vector")))
    moved = F.zip_with("vector", "__to", lambda a, b: a + gap * (b - a))
    synthetic = {
        target: F.col("__class"),
        key: F.concat_ws("#", "__name", F.col("__copy").cast("string")),
        vector: array_to_vector(moved) if is_vector else moved,
    }
    added = copies.select(
        *[
            synthetic.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in df.schema.fields
        ]
    )
    return df.withColumn(key, col(key).cast("string")).unionByName(added)

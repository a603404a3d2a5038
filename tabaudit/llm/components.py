"""Connected components of a table of edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.storage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Each round takes the smallest label among neighbours and then the label of the label, and ends
    when no label changes.  Labels are written between rounds, so lost executors cost one round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least"))
    labels = materialize(labels.select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        better = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("found"))
        # The label of the label; labels are nodes themselves.
        jump = labels.select(F.col("node").alias("found"), F.col("component").alias("further"))
        moved = better.join(jump, "found").select("node", F.col("component").alias("old"), F.least("found", "further").alias("component"))
        moved = materialize(moved, "labels")
        changed = moved.where(F.col("component") < F.col("old")).limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels

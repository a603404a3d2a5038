from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabaudit.functions.storage import materialize
from tabaudit.operators import frequent
from tabaudit.operators.profile import profile_topk


def table(spark, n=20_000):
    """A hot column, a column of few values, a unique one, and one whose tenth place is a tie."""
    hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 < 4, F.concat(F.lit("w"), F.pmod(F.col("id"), F.lit(9)))).otherwise(
        F.concat(F.lit("rare"), F.col("id"))
    )
    tie = F.concat(F.lit("t"), F.lpad((F.col("id") % 25).cast("string"), 2, "0"))
    odd = F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 4).cast("string"))
    return spark.range(0, n, 1, 6).select(
        hot.alias("hot"), tie.alias("tie"), F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("unique one"),
        odd.alias("a.b"), F.lit(None).cast("string").alias("empty"),
    )


def best(rows, name, k):
    counted = Counter(r[name] for r in rows if r[name] is not None)
    return sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("k", [1, 10, 30])
def test_top_values_are_exact(spark, k):
    df = table(spark)
    rows = df.collect()
    found = profile_topk(df, k=k).collect()
    for name in df.columns:
        mine = [(r["value"], r["n"]) for r in sorted(found, key=lambda r: r["rank"]) if r["column"] == name]
        assert mine == best(rows, name, k), name
    assert all(r["share"] == r["n"] / len(rows) for r in found)


def test_bounds_hold_and_summaries_stay_small(spark):
    df = table(spark)
    capacity, parts = 50, df.rdd.getNumPartitions()
    found = materialize(frequent.summaries(df, df.columns, capacity), "summary")
    errors = {r["column"]: r["low"] for r in found.where("value is null").collect()}
    rows = df.collect()
    for name in df.columns:
        low = {r["value"]: r["low"] for r in found.where((F.col("column") == name) & F.col("value").isNotNull()).collect()}
        assert len(low) <= capacity * parts
        for value, n in Counter(r[name] for r in rows if r[name] is not None).items():
            assert low.get(value, 0) <= n <= low.get(value, 0) + errors[name]
    decision = frequent.decide(found, df.columns, 5)
    assert set(decision.exact) == {"tie", "a.b", "empty"} and set(decision.least) == {"hot"} and decision.open == ["unique one"]
    assert frequent.decide(found, df.columns, 5, candidates=2).least == {}


def test_one_task_keeps_the_capacity():
    summary = frequent.Summary(3)
    summary.add(pa.array(["a", "a", "a", "b", "b", "c", "d", None]))
    assert summary.error == 1 and dict(summary.low) == {"a": 2, "b": 1}


def test_hot_column_sends_summaries_only(spark):
    df = table(spark)
    plan = frequent.frequent_values(df.select("hot"), ["hot"], 5, capacity=50)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_small_tables(spark):
    empty = table(spark, 0)
    assert profile_topk(empty).count() == 0
    assert frequent.frequent_values(empty, [], 3).count() == 0
    one = spark.createDataFrame([("x", 1), ("x", 1), (None, 2)], "value string, column int")
    assert [(r["column"], r["value"], r["n"], r["rank"]) for r in profile_topk(one).collect()] == [("value", "x", 2, 1)]

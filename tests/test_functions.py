"""Statistics helpers against brute force, with the paths for large data forced."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.functions import quantiles, ranking
from tabaudit.functions.columns import content_key, missing_to_null, order_hash
from tabaudit.functions.joins import join_hot_keys

PROBABILITIES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _columns(kind: str) -> list[float | None]:
    rng = random.Random(kind)
    if kind == "spread":
        return [rng.gauss(0, 1e6) for _ in range(3001)]
    if kind == "hot":
        return [7.0] * 1500 + [rng.uniform(0, 20) for _ in range(1500)]
    if kind == "wide":
        return [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-4, 5) for _ in range(500)]
    if kind == "infinite":
        return [-math.inf] * 100 + [math.inf] * 50 + [rng.gauss(0, 1) for _ in range(850)]
    if kind == "two":
        return [1.0] * 1000 + [2.0] * 1000
    if kind == "holes":
        return [None if i % 3 else rng.expovariate(1e-3) for i in range(3000)]
    return [None] * 50


@pytest.mark.parametrize(
    ("kind", "bins"), [("spread", 16), ("hot", 1024), ("two", 1024), ("wide", 1024), ("holes", 64), ("empty", 1024)]
)
def test_searched_quantiles_are_exact(spark, kind, bins):
    values = _columns(kind)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    found = quantiles.exact_quantiles(
        df, {"x": F.col("x")}, PROBABILITIES, small_values=0, interval_rows=20, bins=bins
    )["x"]
    present = [v for v in values if v is not None]
    if not present:
        assert found == [None] * len(PROBABILITIES)
    else:
        assert found == pytest.approx(list(np.quantile(present, PROBABILITIES)), rel=1e-12)


def test_searched_quantiles_with_infinities(spark):
    values = _columns("infinite")
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.05, 0.5, 0.99], small_values=0, interval_rows=20)["x"]
    ordered = sorted(values)
    assert found[0] == -math.inf and found[2] == math.inf
    assert found[1] == pytest.approx((ordered[499] + ordered[500]) / 2)


def test_small_and_large_quantiles_agree_on_many_columns(spark):
    df = spark.range(2000).select(
        (F.col("id") * 7919 % 1009).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b")
    )
    columns = {"a": F.col("a"), "b": F.col("b"), "masked": F.when(F.col("a") > 10, F.col("b"))}
    small = quantiles.exact_quantiles(df, columns, PROBABILITIES)
    large = quantiles.exact_quantiles(df, columns, PROBABILITIES, small_values=0, interval_rows=5)
    assert small == large


def test_median_of_even_count_is_between(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [3.0]}


def test_nan_is_missing(spark):
    df = missing_to_null(spark.createDataFrame([(float("nan"),), (1.0,), (3.0,)], "x double"))
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [2.0]}


def test_hash_rank_numbers_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2999, "b").alias("g"))
    ranked = ranking.hash_rank(df, ["g"], order_hash("id", 1), "id").withColumn("h", order_hash("id", 1))
    rows = ranked.collect()
    assert len(rows) == 3000
    for group in ("hot", "b", None):
        ordered = sorted((r for r in rows if r["g"] == group), key=lambda r: (r["h"], r["id"]))
        assert [r["rn"] for r in ordered] == list(range(1, len(ordered) + 1))


def test_global_rank_with_a_hot_value(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 97).alias("t"))
    ranked = ranking.global_rank(df, "t", order_hash("id", 1), "id").withColumn("h", order_hash("id", 1))
    rows = sorted(ranked.collect(), key=lambda r: (r["t"], r["h"], r["id"]))
    assert [r["rn"] for r in rows] == list(range(1, 4001))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") * 31 % 5003).alias("s"), F.lit(1).alias("n"))
    rows = ranking.running_totals(df, ["g"], "s", {"upto": "n"}, descending).collect()
    for group in (0, 1):
        mine = sorted((r for r in rows if r["g"] == group), key=lambda r: r["s"], reverse=descending)
        assert [r["upto"] for r in mine] == list(range(1, 1001))


def test_hot_key_join_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr("tabaudit.functions.joins.HOT_KEYS", 3)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 50 + 1).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.col("k") * 2)
    joined = join_hot_keys(rows, table, "k", "n").collect()
    assert sorted(r["id"] for r in joined) == list(range(1000))
    assert all(r["tag"] == 2 * r["k"] for r in joined)


def test_content_key_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", "a")], "x string, y string")
    assert df.select(content_key(["x", "y"])).distinct().count() == 3


def test_hash_digits_grow_with_the_cluster(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        assert 16 ** ranking.hash_digits(spark) >= 8000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert math.log(4 * int(before), 16) <= ranking.hash_digits(spark)


def test_work_for_a_value_does_not_grow_with_the_columns(spark):
    intervals = [(f"q{i}", 0.0, float(i + 1)) for i in range(50)]
    searches = [quantiles._Search(c, 10.0, low, high, 0, 100_000) for c, low, high in intervals]
    assert str(quantiles._at_rank(intervals, searches)).count("WHEN") == 0
    assert str(quantiles._bin_of(intervals, 8)).count("WHEN") <= 2

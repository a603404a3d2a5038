"""Audit and profile: hand-derived values and the traps of constant or missing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabaudit.dataset import Dataset
from tabaudit.operators import audit, profile


@pytest.fixture(scope="module")
def demo(spark) -> Dataset:
    df = spark.range(10).select(
        F.col("id").alias("x1"),
        (F.col("id") / 9).alias("x2"),
        (F.col("id") % 2).alias("x3"),
        (F.col("id") % 2).alias("target"),
    )
    return Dataset(df, ("x1", "x2", "x3"), "target")


def _facts(data: Dataset) -> dict[tuple[str, str], float]:
    return {(r["section"], r["key"]): r["value"] for r in audit.eda_summary(data).collect()}


def test_demo_summary(demo):
    facts = _facts(demo)
    assert facts[("shape", "n_samples")] == 10 and facts[("shape", "n_features")] == 3
    assert facts[("duplicates", "duplicates")] == 0 and facts[("features", "numeric_features")] == 3
    assert facts[("features", "max_abs_corr_offdiag")] == pytest.approx(1.0)
    assert facts[("y_distribution", "0")] == facts[("y_distribution", "1")] == 0.5
    flags = {k[1]: v for k, v in facts.items() if k[0] == "flags"}
    assert flags == {"needs_scaling": 1, "high_dimensional": 1, "class_imbalance": 0, "high_collinearity": 1}
    assert [facts[("na_top10", c)] for c in demo.features] == [0, 0, 0]


def test_summary_without_target_or_numbers(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    facts = _facts(Dataset(df, ("s",)))
    assert facts[("features", "max_abs_corr_offdiag")] == 0.0
    assert facts[("duplicates", "duplicates")] == 1 and facts[("na_top10", "s")] == 1
    assert facts[("flags", "class_imbalance")] == 0 and ("y_distribution", "a") not in facts


def test_single_numeric_column_has_no_correlation(spark):
    facts = _facts(Dataset(spark.range(5).toDF("a"), ("a",)))
    assert facts[("features", "max_abs_corr_offdiag")] is None
    assert facts[("flags", "high_collinearity")] == 0


def test_null_columns_are_cut_to_ten_in_order(spark):
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(1 for _ in names)], ", ".join(f"{n} int" for n in names))
    df = df.withColumn("c11", F.lit(None).cast("int"))
    keys = [k[1] for k in _facts(Dataset(df, tuple(names))) if k[0] == "na_top10"]
    assert sorted(keys) == sorted(["c11", *names[:9]])


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 1.0, 1.0), (4.0, 5.0, 1.0), (float("nan"), 9.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    found = {(r[0], r[1]): r[2] for r in audit.corr_pairs(df).collect()}
    kept = df.filter("a in (1, 3, 4)").agg(F.abs(F.corr("a", "b"))).first()[0]
    assert found[("a", "b")] == pytest.approx(kept)
    assert found[("a", "k")] is None and found[("b", "k")] is None


def test_correlation_does_not_depend_on_the_width(spark, monkeypatch):
    """Tiny scales, large means, holes: a pair has the same value alone, among many, and in blocks."""
    n = F.col("id")
    columns = [((n * (i + 3) % (17 + i)) * 1e-8).alias(f"t{i}") for i in range(9)]
    columns += [(1e9 + n * (i + 5) % (13 + i)).alias(f"m{i}") for i in range(5)]
    columns += [F.when(n % (i + 2) != 1, n * n % (29 + i)).cast("double").alias(f"h{i}") for i in range(5)]
    columns += [F.lit(2.5).alias("k"), F.when(n > 150, F.lit(1.0)).otherwise(F.when(n % 2 == 0, F.lit(0.0))).alias("z")]
    df = spark.range(200).select(*columns)

    def pairs(frame, names=None):
        return {(r[0], r[1]): r[2] and round(r[2], 7) for r in audit.corr_pairs(frame, names).collect()}

    wide = pairs(df)
    assert len(wide) == 210 and wide[("t0", "k")] is None
    for names in (["t0", "t1"], ["m0", "h0"], ["h1", "h2"], ["t3", "m2", "h4", "k"]):
        assert pairs(df, names).items() <= wide.items()
    values = df.toPandas().corr().abs()
    for (a, b), found in wide.items():
        if found is not None and "m" not in a + b:
            assert found == pytest.approx(values.loc[a, b], abs=1e-6)
    monkeypatch.setattr(audit, "COLUMN_BLOCK", 4)
    assert pairs(df) == wide


def test_correlation_of_common_rows_that_are_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 6.0), (2.0, None), (3.0, None)], "a double, b double")
    assert audit.corr_pairs(df).first()[2] is None
    assert [tuple(r) for r in audit.corr_pairs(df.limit(0)).collect()] == [("a", "b", None)]


def test_types(spark):
    df = spark.range(100).select(
        "id", (F.col("id") % 9).alias("few"), (F.col("id") % 10).cast("double").alias("ten"),
        F.col("id").cast("string").alias("text"), (F.col("id") > 3).alias("flag"),
    )
    found = {r[0]: r[1] for r in audit.infer_types(df).collect()}
    assert found == {"id": "numeric", "few": "categorical", "ten": "numeric", "text": "categorical", "flag": "categorical"}
    assert {r[0]: r[1] for r in audit.infer_types(df.limit(0)).collect()}.get("id", "categorical") == "categorical"


def test_distinct_counts_match_spark(spark):
    df = spark.range(500).select(
        (F.col("id") % 7).alias("i"), (F.col("id") % 11 / 3).alias("d"), F.repeat(F.lit("ab"), (F.col("id") % 60).cast("int")).alias("s"),
        F.when(F.col("id") % 2 == 0, F.lit(True)).alias("b"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 5).cast("int")).alias("t"),
        F.lit(None).cast("int").alias("none"),
    )
    wanted = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first()
    found = {r["position"]: r["n_distinct"] for r in audit.distinct_counts(df, df.columns).collect()}
    assert found == {i: wanted[c] for i, c in enumerate(df.columns)}


def test_metadata_counts_null_as_a_class(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "x int, y string")
    row = audit.dataset_metadata(Dataset(df, ("x",), "y")).first()
    assert (row["samples_count"], row["features_count"], row["target_classes"]) == (3, 1, 3)


def test_profile_numeric_and_histogram(spark):
    df = spark.createDataFrame([(0.0, 5), (1.0, 5), (10.0, 5), (None, 5)], "x double, k int")
    row = profile.profile_numeric(df).filter("column = 'x'").first()
    assert (row["min"], row["p50"], row["max"], row["zeros"]) == (0.0, 1.0, 10.0, 1)
    bins = {(r["column"], r["bin"]): r["n"] for r in profile.profile_histogram(df, bins=5).collect()}
    assert bins == {("x", 0): 2, ("x", 4): 1, ("k", 0): 4}


def test_profile_topk_filters_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("string").alias("s"))
    top = profile.profile_topk(df, k=3)
    assert [(r["value"], r["n"]) for r in top.orderBy("rank").collect()] == [("0", 20), ("1", 20), ("10", 20)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_minimal_profile(demo):
    assert set(profile.full_profile(demo.df, minimal=True)) == {"columns", "numeric"}
    assert set(profile.full_profile(demo.df)) == {"columns", "numeric", "values", "histogram", "correlation"}

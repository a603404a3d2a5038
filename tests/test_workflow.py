"""The end-to-end run and the report."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabaudit.dataset import Dataset
from tabaudit.operators.prep import PrepSpec
from tabaudit.operators.report import report_table
from tabaudit.plans.specs import ModelSpec
from tabaudit.plans.workflow import DataPlan, IntakePlan, RunPlan, prepare, run_all
from tabaudit.sources.runs import load_runs
from tabaudit.sources.tables import latest_artifacts

NOW = datetime(2024, 3, 4, 5, 6, 7)
FOREST = ModelSpec("forest", "random_forest", {"n_estimators": 5}, PrepSpec("simple"))


def _write_input(folder, rows=40):
    folder.mkdir(parents=True)
    lines = ["a,b,target"] + [f"{i % 2 * 3 + i / 100},{i % 5 if i % 7 else ''},{i % 2}" for i in range(rows)]
    (folder / "train.csv").write_text("\n".join([*lines, lines[1]]) + "\n")


def test_run_from_files(spark, tmp_path):
    _write_input(tmp_path / "in")
    plan = RunPlan(
        project="demo",
        output_dir=str(tmp_path / "results"),
        intake=IntakePlan(str(tmp_path / "in"), str(tmp_path / "archive")),
        specs=[FOREST],
        cv={"cv_folds": 2, "scoring": "f1"},
    )
    outcome = run_all(spark, plan, now=NOW)
    assert [s[:2] for s in outcome.status] == [(s, True) for s in ("intake", "data", "audit", "compare", "report", "artifacts")], outcome.status
    assert outcome.dataset.target == "target" and outcome.dataset.df.count() == 40
    facts = {(r["section"], r["key"]): r["value"] for r in outcome.report.collect()}
    assert facts[("shape", "n_samples")] == "40" and facts[("results", "forest.best_score")] == "1.000000"
    assert outcome.analysis.filter("is_target").first()["column"] == "target"
    latest = latest_artifacts(spark, str(tmp_path / "results" / "demo"), [("eda_summary", ".json"), ("cv_forest", ".csv"), ("report", ".json")])
    assert sorted(r["artifact"] for r in latest.collect()) == ["cv_forest_20240304_050607.csv", "eda_summary_20240304_050607.json", "report_20240304_050607.json"]
    run = load_runs(spark, str(tmp_path / "results" / "runs"), "demo").first()
    assert run["run_id"] == "20240304_050607" and len(run["artifacts"]) == len(outcome.artifacts)


def test_no_input_stops_after_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    plan = RunPlan(intake=IntakePlan(str(tmp_path / "in"), str(tmp_path / "out")))
    outcome = run_all(spark, plan)
    assert outcome.dataset is None and [s[0] for s in outcome.status] == ["intake"]
    with pytest.raises(ValueError):
        run_all(spark, RunPlan())


def test_given_data_is_not_cleaned(spark):
    df = spark.range(12).select(F.lit(1).alias("a"), F.when(F.col("id") > 3, 1).alias("b"))
    outcome = run_all(spark, RunPlan(profile_minimal=True), data=Dataset(df, ("a", "b")))
    facts = {r["key"]: r["value"] for r in outcome.summary.collect()}
    assert facts["n_samples"] == 12 and facts["duplicates"] == 10 and facts["b"] == 4
    # Without a target nothing is compared.
    assert [s[0] for s in outcome.status] == ["audit", "report"] and outcome.results == []


def test_failures_are_recorded(spark):
    small = spark.range(5).select("id", F.col("id").alias("target"))
    outcome = run_all(spark, RunPlan(), raw=small)
    assert outcome.status[0][:2] == ("data", False) and "are too few" in outcome.status[0][2]


def test_prepare_options(spark):
    df = spark.range(30).select((F.col("id") % 3).cast("double").alias("a"), "id", F.lit("x").alias("label"))
    data = prepare(spark, df, DataPlan(drop_columns=["id", "zzz"], min_samples_threshold=3, outlier_detection=True))
    assert data.features == ("a",) and data.target == "label" and "a_outlier" in data.df.columns
    plain = prepare(spark, df, DataPlan(auto_detect_target=False))
    assert plain.target is None and plain.features == ("a", "id", "label")


def test_empty_report(spark):
    assert report_table(spark).count() == 0
    assert report_table(spark, profile_path="/x").first()["value"] == "/x"

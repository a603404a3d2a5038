"""Preparation, sampling, metrics and search against brute force and invariants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabaudit.dataset import Dataset
from tabaudit.operators import metrics, models, prep, sampling, search, splits
from tabaudit.operators import smote as smoting
from tabaudit.operators.prep import PrepSpec
from tabaudit.plans.specs import DEFAULT_SPECS, CvPlan, ModelSpec, expand_grid


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(120):
        y = int(rng.random() < 0.4)
        data.append((i, rng.gauss(y * 2, 1), None if i % 7 == 0 else rng.gauss(0, 50) + 1000, 4.0, None, y))
    return spark.createDataFrame(data, "id int, a double, b double, k double, none double, y int").cache()


FEATURES = ["a", "b", "k", "none"]


def _filled(part, name):
    values = np.array([np.nan if r[name] is None else r[name] for r in part], dtype=float)
    return np.where(np.isnan(values), np.nanmedian(values), values)


def test_folds_fit_on_the_other_folds_only(rows):
    folded = splits.stratified_folds(rows, "y", "id", 4).cache()
    spec = PrepSpec(imputer="simple", scaler="standard", select_k_best=2)
    fitted = prep.fit_prep_folds(folded, FEATURES, spec, "y", "fold", [0, 1, 2, 3])
    everything = folded.collect()
    for i, one in enumerate(fitted):
        train = [r for r in everything if r["fold"] != i]
        assert one.features == ("a", "b") and one.n_rows == len(train)
        for name in one.features:
            values = _filled(train, name)
            assert one.means[name] == pytest.approx(values.mean(), rel=1e-12)
            assert one.scales[name] == pytest.approx(values.std(), rel=1e-12)
        labels = np.array([r["y"] for r in train])
        x = _filled(train, "b")
        groups = [x[labels == c] for c in (0, 1)]
        between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert one.scores["b"] == pytest.approx(between / (within / (len(x) - 2)), rel=1e-9)
        assert one.scores["k"] is None
    assert len({f.means["b"] for f in fitted}) == 4


def test_constant_and_empty_columns(rows):
    fitted = prep.fit_prep(rows, FEATURES, PrepSpec(imputer="simple", scaler="standard"))
    assert fitted.features == ("a", "b", "k")
    assert {r["k"] for r in fitted.apply(rows).collect()} == {0.0}
    with pytest.raises(ValueError, match="variance"):
        prep.fit_prep(rows, ["k"], PrepSpec(variance_threshold=0.0))


def test_variance_is_of_the_population(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 9.0)], "x double, w double")
    assert prep.fit_prep(df, ["x", "w"], PrepSpec(variance_threshold=1.5)).features == ("w",)
    # The threshold wins over the F tests, which would need a target.
    both = PrepSpec(variance_threshold=1.5, select_k_best=1)
    assert prep.fit_prep(df, ["x", "w"], both).features == ("w",)


def test_selection_rules():
    assert prep.k_best([1.0, 3.0, 3.0, None], 1) == [2]
    assert prep.k_best([1.0, 3.0, 3.0, None], 100) == [0, 1, 2, 3]
    assert prep.k_best([1.0, None], "all") == [0, 1]
    assert prep.best_percentile(list(range(10)), 25) == [7, 8, 9]
    assert prep.best_percentile([5.0, 5.0, 5.0, 1.0], 50) == [0, 1]
    assert prep.best_percentile([5.0, 1.0], 100) == [0, 1] and prep.best_percentile([5.0], 0) == []


def test_components_kept():
    shares = [0.5, 0.3, 0.15, 0.05]
    assert prep.components_kept(shares, None) == 4 and prep.components_kept(shares, 3) == 3
    assert prep.components_kept(shares, 0.6) == 2 and prep.components_kept(shares, 0.5) == 2
    assert prep.components_kept(shares, 9) == 4 and prep.components_kept(shares, 0.99) == 4


def test_grid_order():
    grid = expand_grid({"b__y": [1, 2], "a__x": ["p", "q"]})
    assert [tuple(c.params.items()) for c in grid][1] == (("a__x", "p"), ("b__y", 2))
    assert grid[2].step("a") == {"x": "q"} and len(expand_grid({})) == 1
    assert [len(s.candidates()) for s in DEFAULT_SPECS] == [9, 6]


def test_spec_from_dict():
    declared = {
        "name": "woods",
        "steps": {
            "preprocess": {"imputer": "simple", "scaler": "none"},
            "feature_selection": {"variance_threshold": 0.25},
            "sampler": {"type": "under"},
            "estimator": {"type": "random_forest", "params": {"max_depth": [2, 4, 6], "n_estimators": 7}},
        },
    }
    spec = ModelSpec.from_dict(declared)
    assert spec.prep == PrepSpec(imputer="simple", variance_threshold=0.25) and spec.sampler == "under" and spec.reduction is None
    assert [tuple(c.step("estimator").items()) for c in spec.candidates()] == [(("max_depth", d), ("n_estimators", 7)) for d in (2, 4, 6)]

    def changed(step, value):
        return ModelSpec.from_dict({**declared, "steps": {**declared["steps"], step: value}})

    assert changed("reduction", {"type": "pca", "params": {"n_components": 5}}).grid()["reduction__n_components"] == [5]
    assert changed("reduction", {"type": "unheard of"}).reduction is None
    with pytest.raises(ValueError, match="umap"):
        changed("reduction", {"type": "umap"})
    with pytest.raises(ValueError, match="no such estimator"):
        changed("estimator", {"type": "oracle"})
    with pytest.raises(ValueError, match="no such sampler"):
        changed("sampler", {"type": "sideways"})


def test_scoring_rules():
    assert list(CvPlan.from_dict({}).metrics) == ["f1"] and CvPlan.from_dict({}).folds == 5
    many = CvPlan.from_dict({"scoring": ["balanced_accuracy", "f1", "balanced_accuracy"]})
    assert list(many.metrics) == ["balanced_accuracy", "f1"] and many.refit == "balanced_accuracy"
    assert CvPlan.from_dict({"scoring": ["f1", "average_precision"], "refit": "average_precision"}).refit == "average_precision"
    named = CvPlan.from_dict({"scoring": {"mine": metrics.accuracy_scorer}})
    assert named.refit == "mine"
    for wrong in ({"scoring": 3}, {"scoring": "nope"}, {"scoring": ["f1", "accuracy"], "refit": "mine"}):
        with pytest.raises(ValueError):
            CvPlan.from_dict(wrong)


def test_splits_are_even(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 20, "a").otherwise("b").alias("y"))
    folds = splits.stratified_folds(df, "y", "id", 5).collect()
    for label, n in (("a", 20), ("b", 83)):
        sizes = [sum(1 for r in folds if r["y"] == label and r["fold"] == i) for i in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    test = [r for r in splits.stratified_holdout(df, "y", "id").collect() if r["is_test"]]
    assert len(test) == 21 and sum(r["y"] == "a" for r in test) == 4
    again = splits.stratified_folds(df.repartition(7), "y", "id", 5).collect()
    assert sorted(map(tuple, folds)) == sorted(map(tuple, again))


def test_groups_do_not_cross_folds(spark):
    df = spark.range(900).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 40).alias("g"))
    rows = splits.group_folds(df, "g", 4).collect()
    assert len(rows) == 900
    assert all(len({r["fold"] for r in rows if r["g"] == g}) == 1 for g in {r["g"] for r in rows})


@pytest.mark.parametrize("hot", [0, 300, 700])
def test_balanced_groups(spark, hot):
    """One group may hold most rows; the other folds then share the rest evenly."""
    draw = random.Random(hot)
    sizes = {f"g{i}": draw.randint(1, 9) for i in range(120)} | {f"big{i}": draw.randint(20, 60) for i in range(6)} | {"hot": hot, None: 5}
    rows = [(g, k) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    found = splits.balanced_group_folds(df, "g", 4).collect()
    assert len(found) == len(rows) and all(len({r["fold"] for r in found if r["g"] == g}) == 1 for g in sizes if sizes[g])
    loads = sorted(sum(r["fold"] == f for r in found) for f in range(4))
    if hot:
        assert loads[3] == hot
        loads = loads[:3]
    assert loads[-1] - loads[0] <= 2 * 9
    again = splits.balanced_group_folds(df.repartition(2), "g", 4).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_levels():
    assert splits._levels([0, 0], 10) == [5, 10] and splits._levels([8, 0, 0], 10) == [0, 5, 10]
    assert splits._levels([3, 1, 2], 6) == [1, 4, 6] and splits._levels([0], 7) == [7] and splits._levels([5, 5], 0) == [0, 0]


def test_time_split_expands(spark):
    df = spark.range(50).select("id", F.when(F.col("id") < 30, 7).otherwise(F.col("id")).alias("t"))
    blocked = splits.time_blocks(df, "t", "id", 4)
    sizes = {r["block"]: r["count"] for r in blocked.groupBy("block").count().collect()}
    assert sizes == {i: 10 for i in range(5)}
    train, test = splits.time_split(blocked, 2)
    assert train.count() == 20 and test.count() == 10


def test_sampling(spark, monkeypatch):
    df = spark.range(100).select("id", (F.col("id") < 7).cast("int").alias("y"))
    low = {r["y"]: r["count"] for r in sampling.undersample(df, "y", "id").groupBy("y").count().collect()}
    assert low == {0: 7, 1: 7}
    high = sampling.oversample(df, "y", "id")
    rows = sorted(map(tuple, high.collect()))
    assert sum(r[1] for r in rows) == 93 and len(rows) == 186
    monkeypatch.setattr(sampling, "COPIES_PER_TASK", 4)
    assert sorted(map(tuple, sampling.oversample(df, "y", "id").collect())) == rows


@pytest.mark.parametrize("block", [4, 1000])
def test_nearest_vectors_are_exact(spark, block):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(60, 3)), 2).tolist()
    df = spark.createDataFrame([(p, 1) for p in points], "vector array<double>, size long").repartition(3)
    found = smoting.nearest_vectors(df, 4, 42, block).collect()
    for p in points:
        mine = [list(r["near"]) for r in sorted((r for r in found if list(r["vector"]) == p), key=lambda r: r["rank"])]
        wanted = sorted((q for q in points if q != p), key=lambda q: (((np.array(p) - q) ** 2).sum(), q))[:4]
        assert mine == wanted


def test_smote_with_copies(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(40)]
    rows += [(100 + i, 1, [1.0, 1.0]) for i in range(8)] + [(200, 1, [9.0, 9.0]), (201, 1, [9.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, y int, v array<double>")
    made = smoting.smote(df, "y", "id", "v", k=3).collect()
    assert sum(r["y"] == 1 for r in made) == 40 and sum(r["y"] == 0 for r in made) == 40
    new = [r for r in made if "#" in r["id"]]
    assert len(new) == 30 and all(1.0 <= c <= 9.0 for r in new for c in r["v"])
    # Copies are each other's nearest rows, so they only yield copies.
    assert all(r["v"] == [1.0, 1.0] for r in new if int(r["id"].split("#")[0]) < 200)
    assert sorted(map(str, made)) == sorted(map(str, smoting.smote(df.repartition(3), "y", "id", "v", k=3).collect()))


def test_metrics_against_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.randrange(3), float(rng.random() < 0.4), float(rng.random() < 0.5), rng.randrange(20) / 20) for _ in range(400)]
    df = spark.createDataFrame(data, "g int, label double, prediction double, score double")
    found = {(r["g"], r["metric"]): r["value"] for r in metrics.score_all(df, metrics.METRICS, ["g"]).collect()}
    for g in range(3):
        mine = [d for d in data if d[0] == g]
        tp = sum(l == p == 1 for _, l, p, _ in mine)
        marks = sum(l for _, l, _, _ in mine) + sum(p for _, _, p, _ in mine)
        assert found[(g, "f1")] == pytest.approx(2 * tp / marks)
        recalls = [np.mean([p == c for _, l, p, _ in mine if l == c]) for c in (0, 1)]
        assert found[(g, "balanced_accuracy")] == pytest.approx(np.mean(recalls))
        total, before, area = sum(l for _, l, _, _ in mine), 0.0, 0.0
        for s in sorted({d[3] for d in mine}, reverse=True):
            taken = [l for _, l, _, x in mine if x >= s]
            area += (sum(taken) / total - before) * np.mean(taken)
            before = sum(taken) / total
        assert found[(g, "average_precision")] == pytest.approx(area)


def test_metric_edges(spark):
    scored = spark.createDataFrame([(0.0, 0.0, 0.1), (0.0, 0.0, 0.2)], "label double, prediction double, score double")
    assert metrics.f1(scored).first()["value"] == 0.0
    assert metrics.average_precision(scored).first()["value"] == 0.0
    steps = [(1.0, 1.0, 0.9), (0.0, 1.0, 0.8), (1.0, 1.0, 0.7), (0.0, 0.0, 0.1)]
    scored = spark.createDataFrame(steps, "label double, prediction double, score double")
    # By steps, not by trapezoids.
    assert metrics.average_precision(scored).first()["value"] == pytest.approx(5 / 6)
    assert metrics.pr_curve(scored).agg(F.sum("area")).first()[0] == pytest.approx(0.5 + (0.5 + 2 / 3) / 4)


@pytest.fixture(scope="module")
def separable(spark) -> Dataset:
    df = spark.range(60).select(
        F.col("id").alias("key"),
        (F.col("id") % 2 * 4 + F.col("id") % 5 / 5).alias("a"),
        F.when(F.col("id") % 9 != 0, F.col("id") % 7 / 7).alias("b"),
        F.when(F.col("id") % 2 == 1, "yes").otherwise("no").alias("class"),
    )
    return Dataset(df, ("a", "b"), "class", "key")


def test_linear_search(separable):
    spec = ModelSpec("svm", "svc", {"kernel": "linear", "C": [0.1, 1.0]}, PrepSpec("simple", "standard"), "pca", {"n_components": [1, None]})
    cv = CvPlan.from_dict({"cv_folds": 3, "scoring": ["f1", "average_precision"]})
    found = search.grid_search(separable, spec, cv)
    assert found.cv_scores.count() == 4 * 3 * 2
    assert found.best_score == 1.0 and found.refit_metric == "f1"
    again = search.grid_search(separable, spec, cv, refit=False)
    assert sorted(map(tuple, again.ranking.collect())) == sorted(map(tuple, found.ranking.collect()))
    assert again.best.params == found.best.params and again.model is None
    table = search.pivoted_results(found)
    assert table.count() == 4 and "f1_rank" in table.columns
    scored = found.model.transform(separable.df).select("prediction", (F.col("class") == "yes").cast("double").alias("y"))
    assert scored.filter("prediction <> y").count() == 0


@pytest.mark.parametrize("sampler", ["over", "smote"])
def test_samplers_change_training_rows_only(spark, sampler):
    df = spark.range(90).select(
        F.col("id").alias("key"), (F.col("id") % 10 / 10 + (F.col("id") < 15).cast("int") * 3).alias("a"), (F.col("id") % 4).alias("b"),
        (F.col("id") < 15).cast("int").alias("y"),
    )
    spec = ModelSpec("s", "svc", {"kernel": "linear"}, PrepSpec("simple", "standard"), sampler=sampler)
    found = search.grid_search(Dataset(df, ("a", "b"), "y", "key"), spec, CvPlan(folds=3), refit=False)
    assert found.best_score == 1.0


def test_rbf_separates_a_ring_and_is_saved(spark, tmp_path):
    df = spark.range(200).select(
        F.col("id").alias("key"),
        (F.cos(F.col("id") * 0.7) * (1 + F.col("id") % 2 * 2)).alias("a"),
        (F.sin(F.col("id") * 0.7) * (1 + F.col("id") % 2 * 2)).alias("b"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    data = Dataset(df, ("a", "b"), "y", "key")
    scaled = PrepSpec("simple", "standard")
    rbf = search.grid_search(data, ModelSpec("rbf", "svc", {"C": 10.0}, scaled), CvPlan(folds=2))
    linear = search.grid_search(data, ModelSpec("lin", "svc", {"kernel": "linear"}, scaled), CvPlan(folds=2), refit=False)
    assert rbf.best_score > 0.95 > linear.best_score
    rbf.model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    first = [r[0] for r in rbf.model.transform(df).orderBy("key").select("prediction").collect()]
    assert first == [r[0] for r in again.transform(df).orderBy("key").select("prediction").collect()]


def test_forest_and_three_classes(spark):
    df = spark.range(90).select(F.col("id").alias("key"), (F.col("id") % 3 * 5 + F.col("id") % 4).alias("a"), (F.col("id") % 3).alias("y"))
    data = Dataset(df, ("a",), "y", "key")
    cv = CvPlan.from_dict({"cv_folds": 3, "scoring": "balanced_accuracy"})
    forest = ModelSpec("rf", "random_forest", {"n_estimators": 5, "max_depth": [None, 3]}, PrepSpec("simple"))
    assert search.grid_search(data, forest, cv).best_score == 1.0
    machine = ModelSpec("svm", "svc", {"kernel": "linear"}, PrepSpec("simple", "standard"))
    assert search.grid_search(data, machine, cv, refit=False).best_score > 0.6


def test_null_target_is_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, 2.0, None)], "key int, a double, y int")
    with pytest.raises(ValueError, match="missing values"):
        search.labelled(Dataset(df, ("a",), "y", "key"))


def test_budget_of_the_model_search(separable, tmp_path):
    found = search.model_search(separable, max_candidates=20, max_seconds=0, cv=CvPlan(folds=2), export_path=str(tmp_path / "m"))
    assert found.tried.count() == 1 and 0 <= found.holdout_score <= 1
    assert PipelineModel.load(str(tmp_path / "m")).transform(separable.df).count() == 60


def test_pca_projection_is_centred(spark):
    df = spark.range(50).select((F.col("id") + 100).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    fitted = prep.centred(prep.fit_prep(df, ["a", "b"], PrepSpec()), df)
    vectors = PipelineModel(fitted.stages("v")).transform(df)
    projected = prep.fit_pca(vectors, "v", "c", 2).transform(vectors).select(F.avg(vector_to_array("c")[0])).first()[0]
    assert projected == pytest.approx(0.0, abs=1e-9)


def test_parameters_that_cannot_be_met_are_errors(spark):
    with pytest.raises(ValueError, match="no parameter"):
        ModelSpec("rf", "random_forest", {"class_weight": "balanced"})
    with pytest.raises(ValueError, match="at most 30"):
        models.tree_depth(31)
    assert models.tree_depth(None) == models.tree_depth(30) == 30
    df = spark.range(40).select("id", (F.col("id") % 2).alias("y"), F.col("id").cast("string").alias("s"))
    data = Dataset(df, ("id", "s"), "y")
    with pytest.raises(ValueError, match="numeric: s"):
        search.grid_search(data, ModelSpec("t", "threshold", {"column": "id", "cutoff": 3.0}), CvPlan(folds=2))


def test_binary_metrics_refuse_three_classes(spark):
    df = spark.range(90).select("id", (F.col("id") % 3).cast("string").alias("y"))
    spec = ModelSpec("t", "threshold", {"column": "id", "cutoff": 3.0})
    with pytest.raises(ValueError, match="two classes"):
        search.grid_search(Dataset(df, ("id",), "y"), spec, CvPlan(folds=2))
    cv = CvPlan(folds=2, metrics={"f1_macro": metrics.METRICS["f1_macro"]}, refit="f1_macro")
    found = search.grid_search(Dataset(df, ("id",), "y"), spec, cv)
    table = search.pivoted_results(found)
    assert {"split0_f1_macro", "split1_f1_macro"} <= set(table.columns) and table.count() == 1


def test_kernel_width_of_values_with_a_large_mean(spark):
    rows = spark.range(7).select(array_to_vector(F.array((F.col("id") + 1e9).cast("double"))).alias("v"))
    assert models.overall_variance(rows, "v") == pytest.approx(4.0)


def test_rows_are_not_moved_by_class(spark):
    """Quotas and copies come with the offsets of cells, also where nothing is broadcast."""
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("y"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for found in (splits.stratified_holdout(df, "y", "id"), sampling.copy_counts(df, "y", "id", 2000, 1)):
            plan = found._jdf.queryExecution().toString()
            nodes = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
            moved = [n for n in nodes.split("\n\n") if "Exchange" in n.split("\n")[0] and "payload" in n]
            assert "Exchange" in plan and moved and all("__cell" in n and "hashpartitioning(__stratum" not in n for n in moved)
            assert found.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_f_scores_of_many_classes_by_fold(spark):
    """More classes than any driver table would hold, missing values, and training sets that merge folds."""
    rows = [(i % 3, i % 1500, None if i % 11 == 0 else float((i * 37) % 101 + (i % 1500) % 7), 4.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "fold int, label int, x double, flat double")
    for imputer in (None, "simple"):
        spec = prep.PrepSpec(imputer=imputer, select_k_best="all")
        for held_out, fitted in zip((0, None), prep.fit_prep_folds(df, ["x", "flat"], spec, "label", "fold", [0, None])):
            train = [(c, x) for f, c, x, _ in rows if f != held_out]
            median = float(np.median([x for _, x in train if x is not None]))
            train = [(c, median if x is None else x) for c, x in train if imputer or x is not None]
            values = np.array([x for _, x in train])
            groups = {}
            for c, x in train:
                groups.setdefault(c, []).append(x)
            between = sum(len(g) * (np.mean(g) - values.mean()) ** 2 for g in groups.values())
            within = sum(len(g) * np.var(g) for g in groups.values())
            wanted = (between / (len(groups) - 1)) / (within / (len(values) - len(groups)))
            assert fitted.scores["x"] == pytest.approx(wanted, rel=1e-9) and fitted.scores["flat"] is None


def test_refit_takes_the_statistics_of_a_last_rung_with_all_rows(separable, monkeypatch):
    asked, plain = [], prep._fold_medians
    monkeypatch.setattr(prep, "_fold_medians", lambda *given: asked.append(given) or plain(*given))
    spec = ModelSpec("lin", "svc", {"kernel": "linear"}, PrepSpec("simple", "standard"))
    found = search.model_search(separable, cv=CvPlan(folds=2), specs=[spec])
    assert len(asked) == 1 and 0 <= found.holdout_score <= 1

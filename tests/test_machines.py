"""Machines fitted together, kernel features and the searches built on them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabaudit.dataset import Dataset
from tabaudit.operators import block_linear, models, search
from tabaudit.operators.prep import PrepSpec
from tabaudit.plans.specs import AutoSpec, Candidate, CvPlan, ModelSpec, spec_from_dict

SCALED = PrepSpec("simple", "standard")


@pytest.fixture(scope="module")
def noisy(spark) -> Dataset:
    """Two classes that overlap, columns of different size, some entries missing."""
    draw = np.random.default_rng(8)
    rows = []
    for i in range(400):
        y = int(draw.random() < 0.45)
        x = [draw.normal(y, 1.0), draw.normal(0, 100) + 1000, draw.normal(-0.7 * y, 1.0), draw.normal(0, 1)]
        rows.append((i, *[None if draw.random() < 0.05 else float(v) for v in x], y))
    return Dataset(spark.createDataFrame(rows, "key int, a double, b double, c double, d double, y int"), ("a", "b", "c", "d"), "y", "key")


def folded(data, cv):
    rows, features, n_classes = search.labelled(data)
    table = search.fold_table(rows, cv)
    return table, features, n_classes, search.fold_statistics(table, features, cv)


def prepared(rows, preps, fold):
    """Training rows of a fold, prepared by hand."""
    prep = preps[fold]
    x = np.array([[prep.medians[c] if r[c] is None else r[c] for c in prep.features] for r in rows])
    return (x - [prep.means[c] for c in prep.features]) / [prep.scales[c] for c in prep.features]


def objective(x, y, weights, ridge):
    short = 1 - y * (x @ weights[:-1] + weights[-1])
    smooth = block_linear.SMOOTH
    loss = np.where(short <= 0, 0, np.where(short < smooth, short**2 / (2 * smooth), short - smooth / 2)).mean()
    return loss + 0.5 * ridge * weights[:-1] @ weights[:-1]


def test_every_pair_reaches_its_minimum(noisy):
    """Against plain gradient steps with numpy on the rows of one training set."""
    cv = CvPlan(folds=3)
    table, features, _, statistics = folded(noisy, cv)
    preps = statistics.fit(SCALED)
    blocks = block_linear.pack(table, features, "label", "fold")
    views = [block_linear.Prepared.of(preps[i], i, features) for i in range(3)]
    fits = [block_linear.Fit(c, v, 4, 1 / (strength * v.n_rows)) for c, strength in enumerate([0.01, 1.0]) for v in views]
    found = block_linear.fit_machines(blocks, fits)
    everything = table.collect()
    for fit, weights in zip(found.fits, found.weights):
        rows = [r for r in everything if r["fold"] != fit.view.held_out]
        x, y = prepared(rows, preps, fit.view.held_out), np.array([1 if r["label"] else -1 for r in rows])
        assert len(rows) == fit.view.n_rows
        reached, guess = objective(x, y, weights, fit.ridge), weights.copy()
        draw = np.random.default_rng(1)
        for size in (0.3, 0.1, 0.03, 0.01):
            for _ in range(300):
                other = guess + draw.normal(size=5) * size
                if objective(x, y, other, fit.ridge) < objective(x, y, guess, fit.ridge):
                    guess = other
        assert reached <= objective(x, y, guess, fit.ridge) + 2e-4


def test_scans_do_not_grow_with_candidates_or_folds(noisy, monkeypatch):
    scans = []
    plain = block_linear.Blocks.scan
    monkeypatch.setattr(block_linear.Blocks, "scan", lambda self, step: scans.append(1) or plain(self, step))

    def scans_of(folds, strengths):
        scans.clear()
        spec = ModelSpec("s", "svc", {"kernel": "linear", "C": strengths}, SCALED, "pca", {"n_components": [2, None]})
        found = search.grid_search(noisy, spec, CvPlan(folds=folds), refit=False)
        return len(scans), {(r["cand_id"], r["metric"]): r["mean"] for r in found.ranking.collect()}

    few, single = scans_of(2, [1.0])
    many, joint = scans_of(2, [0.01, 0.1, 1.0, 3.0])
    more, _ = scans_of(5, [0.01, 0.1, 1.0, 3.0])
    assert many < 2.5 * few and more < 2.5 * few  # eight and twenty times as many fits as the two of a fold
    # Candidates fitted alone and together end at the same scores; C = 1 is the third of four.
    assert single[0, "f1"] == pytest.approx(joint[4, "f1"], abs=0.01) and single[1, "f1"] == pytest.approx(joint[5, "f1"], abs=0.01)


def test_same_ranking_as_single_fits(noisy):
    """Spark's own machine, fitted for each pair alone."""
    cv = CvPlan(folds=3)
    spec = ModelSpec("s", "svc", {"kernel": "linear", "C": [0.0003, 0.003, 1.0]}, SCALED)
    found = search.grid_search(noisy, spec, cv, refit=False)
    joint = {r["cand_id"]: r["mean"] for r in found.ranking.collect()}
    table, _, _, statistics = folded(noisy, cv)
    preps = statistics.fit(SCALED)
    alone = {}
    for c in spec.candidates():
        values = []
        for i in range(3):
            rows = [preps[i].apply(table.where(t), ["label"]) for t in (F.col("fold") != i, F.col("fold") == i)]
            train, test = (r.select("label", array_to_vector(F.array(*preps[i].features)).alias("features")) for r in rows)
            model = models.fit_classifier("svc", c.step("estimator"), train, preps[i].n_rows, 4, 42)
            p = model.transform(test).select("label", "prediction").toPandas()
            hit = ((p.label == 1) & (p.prediction == 1)).sum()
            values.append(2 * hit / max((p.label == 1).sum() + (p.prediction == 1).sum(), 1))
        alone[c.cand_id] = float(np.mean(values))
    assert sorted(joint, key=joint.get) == sorted(alone, key=alone.get)
    assert all(joint[c] == pytest.approx(alone[c], abs=0.02) for c in alone)


def test_missing_values_without_imputer_are_an_error(noisy):
    with pytest.raises(ValueError, match="imputer"):
        search.grid_search(noisy, ModelSpec("s", "svc", {"kernel": "linear"}, PrepSpec(scaler="standard")), CvPlan(folds=2), refit=False)


def test_rotations_equal_numpy(noisy):
    cv = CvPlan(folds=3)
    table, features, _, statistics = folded(noisy, cv)
    preps = statistics.fit(SCALED)
    blocks = block_linear.pack(table, features, "label", "fold")
    views = [block_linear.Prepared.of(preps[i], i, features) for i in range(3)]
    everything = table.collect()
    spread = block_linear.spreads(blocks, views)
    for i, (axes, sizes) in enumerate(block_linear.rotations(blocks, views)):
        x = prepared([r for r in everything if r["fold"] != i], preps, i)
        wanted = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
        assert np.allclose(sizes, wanted) and np.allclose(axes.T @ axes, np.eye(4))
        assert spread[i] == pytest.approx(x.var())


def test_kernel_machines_in_the_same_scans(spark):
    df = spark.range(200).select(
        F.col("id").alias("key"),
        (F.cos(F.col("id") * 0.7) * (1 + F.col("id") % 2 * 2)).alias("a"),
        (F.sin(F.col("id") * 0.7) * (1 + F.col("id") % 2 * 2)).alias("b"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    data = Dataset(df, ("a", "b"), "y", "key")
    spec = ModelSpec("both", "svc", {"kernel": ["linear", "rbf"], "C": [10.0]}, SCALED)
    found = search.grid_search(data, spec, CvPlan(folds=2), refit=False)
    means = {r["cand_id"]: r["mean"] for r in found.ranking.collect()}
    assert means[1] > 0.95 > means[0]
    turned = ModelSpec("pca", "svc", {"kernel": "rbf", "C": 10.0}, SCALED, "pca", {"n_components": [None]})
    assert search.grid_search(data, turned, CvPlan(folds=2), refit=False).best_score > 0.95
    landmarks = ModelSpec("ny", "svc", {"kernel": "rbf", "C": 10.0, "approximation": "nystrom"}, SCALED)
    assert search.grid_search(data, landmarks, CvPlan(folds=2)).best_score > 0.95


# -- kernel features -----------------------------------------------------------------------


def kernel_error(features, exact):
    return np.linalg.norm(features @ features.T - exact) / np.linalg.norm(exact)


def test_nystrom_is_nearer_to_the_kernel_than_random_features(spark, tmp_path):
    """At equal width, with a heap of many like rows and a few far ones that leverage must find."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(330, 6)) * 0.3, draw.normal(size=(60, 6)) * 2 + 4])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, a array<double>")
    df = df.select("id", array_to_vector("a").alias("v")).repartition(4)
    gamma, width = 0.1, 60
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    marks = models.choose_landmarks(df, "v", width, gamma, 3, pilot=120)
    assert len(marks) == width and len({tuple(m) for m in marks} & {tuple(r) for r in x}) == width
    assert (marks.mean(axis=1) > 1).sum() > width * 60 / 390  # more than their share of the rows

    def made(stage):
        return np.array([r[0] for r in stage.transform(df).orderBy("id").select(vector_to_array("f")).collect()])

    nystrom = models.NystromFeatures(inputCol="v", outputCol="f", landmarks=marks.ravel().tolist(), inputSize=6, gamma=gamma)
    fourier = models.FourierFeatures(inputCol="v", outputCol="f", size=width, inputSize=6, gamma=gamma, seed=3)
    near = kernel_error(made(nystrom), exact)
    assert near < 0.03 < kernel_error(made(fourier), exact)
    at = [int(np.flatnonzero((x == m).all(axis=1))[0]) for m in marks]
    features = made(nystrom)[at]
    assert np.allclose(features @ features.T, exact[np.ix_(at, at)], atol=1e-6)
    nystrom.save(str(tmp_path / "n"))
    assert np.array_equal(made(models.NystromFeatures.load(str(tmp_path / "n"))), made(nystrom))
    again = models.choose_landmarks(df.unionAll(df).repartition(2), "v", width, gamma, 3, pilot=120)
    assert np.array_equal(marks, again)


# -- searches --------------------------------------------------------------------------------


def test_halving_shares():
    assert search.rung_shares(9, 10_000, 10) == [1 / 9, 1 / 3, 1.0]
    assert search.rung_shares(2, 10_000, 10) == [1.0] and search.rung_shares(9, 25, 10) == [1.0]
    assert search.rung_shares(100, 100, 10) == [1 / 9, 1 / 3, 1.0]


def test_no_chain_is_drawn_twice():
    specs = search.random_specs(1000, 7)
    keys = {(s.estimator, str(sorted(s.params.items())), s.prep, s.reduction, str(s.reduction_params)) for s in specs}
    assert len(specs) == len(keys) == len(search._chains()) > 50
    assert [s.params for s in search.random_specs(5, 7)] == [s.params for s in specs[:5]]
    assert [s.params for s in search.random_specs(5, 8)] != [s.params for s in specs[:5]]


def test_survivors_of_a_rung_go_on(noisy):
    spec = ModelSpec("rule", "threshold", {"column": "a", "cutoff": [float(c) for c in np.linspace(-3, 4, 9)]})
    cv = CvPlan(folds=3)
    table, features, n_classes, _ = folded(noisy, cv)
    found = search.successive_halving(table, features, n_classes, [spec], cv, least_rows=30)
    rungs = found.rungs.collect()
    assert [sum(r["rung"] == k for r in rungs) for k in range(3)] == [9, 3, 1]
    for k in (1, 2):
        assert {r["cand_id"] for r in rungs if r["rung"] == k} == {r["cand_id"] for r in rungs if r["rung"] == k - 1 and r["promoted"]}
    sizes = [next(r["n_rows"] for r in rungs if r["rung"] == k) for k in range(3)]
    assert sizes[0] < sizes[1] < sizes[2] == 400 and abs(sizes[0] - 400 / 9) < 25
    late = search.successive_halving(table, features, n_classes, [spec, ModelSpec("other", "threshold", {"column": "c", "cutoff": [0.0]})], cv, least_rows=30, deadline=0.0)
    assert {r["name"] for r in late.rungs.collect()} == {"rule"} and late.rungs.agg(F.max("rung")).first()[0] == 0


def test_automated_entry(noisy, tmp_path):
    entry = {"library": "tpot", "tpot": {"generations": 1, "population_size": 3, "max_time_mins": 0, "scoring": "f1", "cv": 2,
                                         "export_best_pipeline": True, "export_path": "best", "random_state": 3}}
    spec = spec_from_dict({"name": "auto", "automl": entry})
    assert spec == AutoSpec("auto", 3, 0.0, "f1", 2, 3, "best")
    rule = ModelSpec("rule", "threshold", {"column": "a", "cutoff": [0.5]})
    found = search.compare(noisy, [rule, spec], CvPlan(folds=2), out_dir=str(tmp_path))
    assert [r.name for r in found] == ["rule", "auto"] and 0 <= found[1].best_score <= 1 and found[1].refit_metric == "f1"
    assert (tmp_path / "best").is_dir() and all((tmp_path / r.cv_results_path.split("/")[-1]).is_dir() for r in found)
    board = search.leaderboard(found, noisy.df.sparkSession).collect()
    assert {r["cv_results_path"] for r in board} == {r.cv_results_path for r in found}
    for wrong in ({"library": "other"}, {"library": None}):
        with pytest.raises(ValueError, match="library"):
            spec_from_dict({"name": "auto", "automl": wrong})
    assert isinstance(spec_from_dict({"name": "s", "steps": {"estimator": {"type": "svc"}}}), ModelSpec)


def test_block_fits_are_for_unsampled_machines():
    linear = ModelSpec("s", "svc", {"kernel": "linear"})
    assert search._is_block_fit(linear, linear.candidates())
    assert not search._is_block_fit(ModelSpec("s", "svc", {"kernel": "linear"}, sampler="over"), linear.candidates())
    assert not search._is_block_fit(linear, [Candidate(0, {"estimator__approximation": "nystrom"})])


# -- registered scores -------------------------------------------------------------------------

SMALL = "/root/testdata/sf0.001"


def embeddings(spark):
    """Scaled rows, labels of 1 and -1, and the order of their ids, by numpy."""
    rows = sorted(spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect(), key=lambda r: r["vec_id"])
    x = np.array([r["embedding"] for r in rows], float)
    return (x - x.mean(axis=0)) / x.std(axis=0), np.array([1.0 if r["label"] < 5 else -1.0 for r in rows]), [r["vec_id"] for r in rows]


def least_loss(x, y, ridge):
    """The smallest regularised hinge loss, by the same optimiser on plain arrays with a finer rounding."""
    state, n = block_linear._State(np.zeros(x.shape[1] + 1)), len(x)
    for _ in range(3000):
        w = state.trial
        short = 1 - y * (x @ w[:-1] + w[-1])
        inside, bent = short > 0, (short > 0) & (short < 0.01)
        loss = np.where(bent, short**2 / 0.02, np.where(inside, short - 0.005, 0)).mean() + 0.5 * ridge * w[:-1] @ w[:-1]
        slope = -y * np.where(bent, short / 0.01, inside) / n
        state.feed(loss, np.append(x.T @ slope + ridge * w[:-1], slope.sum()), 1e-9)
        if state.done:
            break
    return hinge(x, y, state.weights, ridge)


def hinge(x, y, w, ridge):
    return np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).mean() + 0.5 * ridge * w[:-1] @ w[:-1]


@pytest.mark.parametrize("name", ["linear_svm_scores", "rbf_svm_scores"])
def test_registered_machines_equal_a_fit_by_hand(spark, name):
    import __spark_entry__ as entry

    x, y, ids = embeddings(spark)
    if name == "rbf_svm_scores":
        directions, phases = models.fourier_weights(64, models.FOURIER_FEATURES, 1 / (64 * x.var()), 42)
        x = np.sqrt(2 / models.FOURIER_FEATURES) * np.cos(x @ directions + phases)
    found = {r["vec_id"]: r for r in entry.queries()[name](spark, SMALL).collect()}
    score = np.array([found[i]["score"] for i in ids])
    assert [found[i]["label"] for i in ids] == [(v + 1) / 2 for v in y]
    assert [found[i]["prediction"] for i in ids] == [float(v > 0) for v in score]
    # Scores are linear in the rows, so they give the weights of least norm that make them.
    wide = np.column_stack([x, np.ones(len(x))])
    weights = np.linalg.lstsq(wide, score, rcond=None)[0]
    assert np.allclose(wide @ weights, score, atol=1e-6)
    ridge = 1 / len(x)
    assert hinge(x, y, weights, ridge) <= 1.05 * least_loss(x, y, ridge) + 1e-3


def test_registered_forest(spark):
    import __spark_entry__ as entry

    _, y, ids = embeddings(spark)
    found = {r["vec_id"]: r for r in entry.queries()["random_forest_scores"](spark, SMALL).collect()}
    assert set(found) == set(ids) and all(0 <= r["score"] <= 1 and r["prediction"] == float(r["score"] > 0.5) for r in found.values())
    # Deep enough to beat the larger class on its own rows by far.
    assert np.mean([found[i]["prediction"] == (v + 1) / 2 for i, v in zip(ids, y)]) > 0.85

"""Leading principal components against full decompositions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabaudit.dataset import Dataset
from tabaudit.operators import block_linear, search
from tabaudit.operators.components import Projection, fit_leading
from tabaudit.operators.prep import PrepSpec
from tabaudit.plans.specs import CvPlan, ModelSpec


def vectors(spark, x):
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, a array<double>").repartition(5)
    return rows.select("id", array_to_vector("a").alias("v"))


def test_equal_to_a_full_decomposition(spark, tmp_path):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 40)) @ np.diag(0.8 ** np.arange(40)) @ np.linalg.qr(draw.normal(size=(40, 40)))[0]
    x -= x.mean(axis=0)
    df = vectors(spark, x)
    found = fit_leading(df, "v", "c", 5)
    _, singular, turn = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(found.variances, singular[:5] ** 2 / 300, rtol=1e-4)
    assert np.allclose(found.shares, singular[:5] ** 2 / (singular**2).sum(), rtol=1e-4)
    made = np.array([r[0] for r in found.model.transform(df).orderBy("id").select(vector_to_array("c")).collect()])
    assert np.allclose(np.abs(made), np.abs(x @ turn[:5].T), atol=1e-2)
    found.model.save(str(tmp_path / "p"))
    again = Projection.load(str(tmp_path / "p")).transform(df).orderBy("id").select(vector_to_array("c")).collect()
    assert np.array_equal(made, np.array([r[0] for r in again]))


def test_twenty_thousand_columns(spark):
    """A covariance would have 400 million entries.  What is left over obeys the bound of the next variance."""
    draw = np.random.default_rng(2)
    inner = draw.normal(size=(120, 6)) * [30, 20, 10, 6, 4, 2]
    axes = np.linalg.qr(draw.normal(size=(20_000, 6)))[0]
    x = inner @ axes.T + draw.normal(size=(120, 20_000)) * 0.01
    x -= x.mean(axis=0)
    made = spark.createDataFrame([(i,) for i in range(120)], "id int").repartition(4)
    sent = spark.sparkContext.broadcast(x)
    rows = made.mapInPandas(lambda it: (f.assign(a=[sent.value[i] for i in f["id"]]) for f in it), "id int, a array<double>")
    df = rows.select("id", array_to_vector("a").alias("v"))
    found = fit_leading(df, "v", "c", 4)
    singular = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(found.variances, singular[:4] ** 2 / 120, rtol=1e-3)
    basis = np.array(found.model.getOrDefault(found.model.axes)).reshape(4, 20_000)
    assert np.allclose(basis @ basis.T, np.eye(4), atol=1e-8)
    left = np.linalg.norm(x - x @ basis.T @ basis, 2)
    assert left <= 1.05 * singular[4]


def test_ranks_below_the_wanted_number(spark):
    x = np.outer(np.arange(30) - 14.5, [1.0, 2.0, 0.0])
    found = fit_leading(vectors(spark, x), "v", "c", 3)
    assert found.shares == pytest.approx([1.0, 0.0, 0.0], abs=1e-9)
    zero = fit_leading(vectors(spark, x * 0), "v", "c", 2)
    assert list(zero.shares) == [0.0, 0.0]
    with pytest.raises(ValueError, match="no rows"):
        fit_leading(vectors(spark, x).limit(0), "v", "c", 2)


def test_views_of_folds(spark):
    """All folds at once, with missing entries and scaling, against one fold at a time by hand."""
    draw = np.random.default_rng(3)
    rows = [(i, *[None if draw.random() < 0.1 else float(v) for v in draw.normal(size=6) * [9, 5, 3, 2, 1, 1] + 50], i % 2) for i in range(240)]
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "key int, " + ", ".join(f"{n} double" for n in names) + ", y int")
    table, features, _ = search.labelled(Dataset(df, tuple(names), "y", "key"))
    cv = CvPlan(folds=3)
    folded = search.fold_table(table, cv)
    preps = search.fold_statistics(folded, features, cv).fit(PrepSpec("simple"))
    blocks = block_linear.pack(folded, features, "label", "fold")
    views = [block_linear.Prepared.of(preps[i], i, features) for i in range(3)]
    full, lead = block_linear.rotations(blocks, views), block_linear.leading_rotations(blocks, views, 2)
    for (axes, variances), found in zip(full, lead):
        assert np.allclose(found.variances, variances[:2], rtol=1e-6) and found.total == pytest.approx(variances.sum())
        assert np.allclose(np.abs(axes[:, :2].T @ found.axes), np.eye(2), atol=1e-5)


def test_search_with_numbers_of_components(spark):
    df = spark.range(90).select(F.col("id").alias("key"), (F.col("id") % 2 * 4 + F.col("id") % 5 / 5).alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                (F.col("id") % 3).cast("double").alias("c"), (F.col("id") % 2).alias("y"))
    spec = ModelSpec("s", "svc", {"kernel": "linear"}, PrepSpec("simple", "standard"), "pca", {"n_components": [1, 3]})
    found = search.grid_search(Dataset(df, ("a", "b", "c"), "y", "key"), spec, CvPlan(folds=2), refit=False)
    assert found.best_score == 1.0 and found.best.params["reduction__n_components"] == 3

"""Hashed nearest neighbours against all distances, and bounds on what is moved."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.operators import neighbours
from tabaudit.operators import smote as smoting


def points_of(spark, groups):
    rows = [(g, p.tolist(), i % 3 + 1) for g, ps in groups.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "group string, vector array<double>, size long").repartition(3)


def exact(ps, k):
    squared = ((ps[:, None, :] - ps[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(squared, np.inf)
    return np.argsort(squared, axis=1, kind="stable")[:, :k]


def test_one_bucket_is_exact(spark):
    draw = np.random.default_rng(1)
    groups = {"a": draw.normal(size=(40, 3)), "b": draw.normal(size=(3, 3)), "c": draw.normal(size=(1, 3))}
    found = neighbours.hashed_neighbours(points_of(spark, groups), 4, 42).collect()
    for g, ps in groups.items():
        near = exact(ps, min(4, len(ps) - 1)) if len(ps) > 1 else [[]]
        for i, p in enumerate(ps):
            mine = sorted((r for r in found if r["group"] == g and r["vector"] == p.tolist()), key=lambda r: r["rank"])
            assert [r["near"] for r in mine] == [ps[j].tolist() for j in near[i]]
            assert [r["near_size"] for r in mine] == [j % 3 + 1 for j in near[i]]


def test_small_buckets_find_most_and_move_a_bounded_number_of_rows(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 64)) * 0.7
    # One dense heap holds a third of the vectors, and one value repeats in half of the entries.
    ps = centres[np.where(draw.random(3000) < 1 / 3, 0, draw.integers(0, 12, 3000))] + draw.normal(size=(3000, 64))
    ps[: len(ps) // 2, :8] = 0.0
    points = points_of(spark, {"a": ps, "b": ps[:200] + 50}).cache()
    sent, found = neighbours._spread(points, 5, 42, tables=8, cell_rows=250)
    assert sent.count() <= 3 * 8 * points.count()
    largest = sent.where("stored").groupBy("group", "table", "bin", "cell").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * 250
    assert sent.where("stored").groupBy("id").count().where("count <> 8").count() == 0
    measured = {r["group"]: r for r in neighbours.recall(points, found, 5, queries=150).collect()}
    assert sum(r["wanted"] for r in measured.values()) == 150 * 5
    assert sum(r["found"] for r in measured.values()) >= 0.9 * 150 * 5
    # Recall counts as a direct comparison does.
    truth = {tuple(p): {tuple(ps[j]) for j in near} for p, near in zip(ps, exact(ps, 5))}
    mine = found.where("group = 'a'").collect()
    hits = sum(tuple(r["near"]) in truth[tuple(r["vector"])] for r in mine)
    assert hits >= 0.9 * 5 * len(ps)


def test_no_vectors(spark):
    assert neighbours.hashed_neighbours(points_of(spark, {}), 3, 1).count() == 0


@pytest.mark.parametrize("method", ["hashed", "exact"])
def test_smote_methods_agree_on_small_classes(spark, method):
    draw = np.random.default_rng(3)
    rows = [(i, "big" if i < 60 else f"small{i % 2}", draw.normal(size=4).round(3).tolist()) for i in range(90)]
    rows += [(100 + i, "small1", [1.0, 1.0, 1.0, 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "id int, y string, v array<double>")
    made = smoting.smote(df, "y", "id", "v", k=3, method=method).collect()
    assert {y: sum(r["y"] == y for r in made) for y in ("big", "small0", "small1")} == {"big": 60, "small0": 60, "small1": 60}
    other = smoting.smote(df.repartition(5), "y", "id", "v", k=3, method="exact").collect()
    assert sorted(map(str, made)) == sorted(map(str, other))


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="method"):
        smoting.smote(spark.createDataFrame([(1, 1, [1.0])], "id int, y int, v array<double>"), "y", "id", "v", method="guess")

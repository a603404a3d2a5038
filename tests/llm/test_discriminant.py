from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.llm import discriminant
from tabaudit.llm.discriminant import FEATURES, Discriminant, Moments, Normal, features, fit_classes, fit_curve
from tests.llm.cases import documents, labels, prose, texts


def log_normal(x, mean, covariance):
    away = x - mean
    return -0.5 * (away @ np.linalg.solve(covariance, away)) - 0.5 * math.log(np.linalg.det(covariance))


def test_density_equals_the_formula():
    draw = np.random.default_rng(1)
    root = draw.normal(size=(4, 4))
    covariance, mean = root @ root.T + np.eye(4), draw.normal(size=4)
    rows = draw.normal(size=(50, 4))
    found = Normal.fit(mean, covariance).log_density(rows)
    assert np.allclose(found, [log_normal(x, mean, covariance) for x in rows])


def test_shrinkage_by_hand():
    draw = np.random.default_rng(2)
    a, b = draw.normal(size=(400, 3)) * [1, 2, 3], draw.normal(size=(300, 3)) + 1
    good, bad = Moments.of(a[:150]) + Moments.of(a[150:]), Moments.of(b)
    pooled = (400 * np.cov(a.T, bias=True) + 300 * np.cov(b.T, bias=True)) / 700
    for common, identity in [(0.2, 0.1), (1.0, 0.001)]:
        mixed = (1 - common) * np.cov(a.T, bias=True) + common * pooled
        wanted = (1 - identity) * mixed + identity * np.trace(mixed) / 3 * np.eye(3)
        model = fit_classes(good, bad, (common, identity))[0]
        assert np.allclose(model.mean, a.mean(axis=0)) and np.allclose(np.linalg.inv(model.whitening.T @ model.whitening), wanted)


def test_few_rows_of_a_class_are_enough():
    """One row has no covariance of its own; it takes the common one."""
    draw = np.random.default_rng(3)
    good, bad = Moments.of(draw.normal(size=(200, 5))), Moments.of(draw.normal(size=(1, 5)) + 9)
    model = Discriminant(*fit_classes(good, bad, (0.0, 0.001)), 1.0, 0.0)
    assert model.score(np.full((1, 5), 9.0))[0] < 0.1 < 0.9 < model.score(np.zeros((1, 5)))[0]


def test_curve_minimises_the_loss():
    draw = np.random.default_rng(4)
    z = draw.normal(size=5000) * 2
    label = (draw.random(5000) < 1 / (1 + np.exp(-(1.5 * z - 0.5)))).astype(int)
    histogram = np.zeros((discriminant.BINS, 2))
    np.add.at(histogram, (np.rint(z / 0.05).astype(int) + discriminant.BINS // 2, label), 1)
    slope, offset, loss = fit_curve(histogram)
    assert abs(slope - 1.5) < 0.15 and abs(offset + 0.5) < 0.15
    wrong = histogram[:, ::-1]
    assert fit_curve(wrong)[0] > 0 and loss < math.log(2)
    assert fit_curve(np.zeros((discriminant.BINS, 2)) + 1e-9)[0] > 0


def test_features_are_finite():
    for _, text in texts() + [(0, "\x00"), (0, "a" * 200_000), (0, "\n" * 1000)]:
        found = features(text or "")
        assert len(found) == len(FEATURES) and np.isfinite(found).all()
    assert features("") != features("word")


def junk(seed):
    return " ".join(w + "###" for w in prose(seed, 60).split())


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 60)) for i in range(200, 500)] + texts()
    judged = [(i, int(i % 4 != 0), 0) for i in range(200, 500)] + [(4, None, None), (None, 0, 0), (200, 0, 1)]
    return documents(spark, rows), labels(spark, judged), rows


def test_table(labelled):
    docs, judged, rows = labelled
    found = discriminant.classify(docs, judged).collect()
    assert sorted(map(repr, (r["doc_id"] for r in found))) == sorted(repr(i) for i, _ in rows)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"]))
        if r["doc_id"] and r["doc_id"] >= 200:
            assert r["predicted"] == (r["doc_id"] % 4 != 0)


def test_scores_equal_a_model_built_by_hand(labelled):
    """Every step again with numpy on the permitted rows: moments, folds' losses, shrinkage, curve, scores."""
    docs, judged, rows = labelled
    spark = docs.sparkSession
    ids = [i for i, _ in rows if i is not None and i >= 200 and not held(i)]
    x = np.array([features(dict(rows)[i]) for i in ids])
    y = np.array([int(i % 4 != 0) for i in ids])
    hashed = spark.createDataFrame([(i,) for i in ids], "i long").select(
        "i", F.pmod(F.xxhash64(F.col("i").cast("string").cast("binary")), F.lit(3)).alias("f")
    )
    fold = np.array([dict(hashed.collect())[i] for i in ids])
    best = None
    for common in discriminant.COMMON:
        for identity in discriminant.IDENTITY:
            histogram = np.zeros((discriminant.BINS, 2))
            for f in set(fold):
                good, bad = (Moments.of(x[(fold != f) & (y == c)]) for c in (1, 0))
                model = Discriminant(*fit_classes(good, bad, (common, identity)), 1.0, 0.0)
                z = np.arcsinh(model.difference(x[fold == f])) / 0.05
                place = np.clip(np.rint(z).astype(int) + discriminant.BINS // 2, 0, discriminant.BINS - 1)
                np.add.at(histogram, (place, y[fold == f]), 1)
            slope, offset, loss = fit_curve(histogram)
            if best is None or loss < best[0]:
                best = loss, slope, offset, (common, identity)
    good, bad = Moments.of(x[y == 1]), Moments.of(x[y == 0])
    model = Discriminant(*fit_classes(good, bad, best[3]), best[1], best[2])
    wanted = {repr(i): s for (i, _), s in zip(rows, model.score(np.array([features(t or "") for _, t in rows])))}
    for r in discriminant.classify(docs, judged).collect():
        if r["doc_id"] is not None:
            assert r["score"] == pytest.approx(wanted[repr(r["doc_id"])], abs=1e-4)


def test_labels_held_out_teach_nothing(labelled):
    docs, judged, _ = labelled
    flipped = judged.withColumn("quality", F.when(discriminant.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {repr(r["doc_id"]): r["score"] for r in discriminant.classify(docs, judged).collect()}
    b = {repr(r["doc_id"]): r["score"] for r in discriminant.classify(docs, flipped).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a if k != "None")


def test_without_labels(spark):
    found = discriminant.classify(documents(spark), labels(spark, [])).collect()
    assert len(found) == 15 and {r["score"] for r in found} == {0.5}
    one = labels(spark, [(i, 1, 0) for i in range(20)])
    assert all(r["score"] > 0.99 for r in discriminant.classify(documents(spark), one).collect())
    assert discriminant.classify(documents(spark, []), labels(spark, [(1, 1, 0)])).count() == 0

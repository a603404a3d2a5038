"""Stored and merged quantile sketches against exact ranks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.functions import sketches
from tabaudit.functions.storage import materialize


def ranks(values, q):
    return (values < q).mean(), (values <= q).mean()


@pytest.mark.parametrize("kind", ["even", "hot", "skewed", "few"])
def test_rank_error_of_merged_parts(spark, kind):
    draw = np.random.default_rng(4)
    n = 20_000
    values = {
        "even": draw.random(n),
        "hot": np.where(draw.random(n) < 0.4, 7.0, draw.normal(size=n)),
        "skewed": np.exp(draw.normal(size=n) * 4),
        "few": draw.integers(0, 5, n).astype(float),
    }[kind]
    # One part holds most of the rows.
    rows = [(float(v), "main" if i % 10 else f"p{i % 70}") for i, v in enumerate(values)] + [(None, "main"), (float("nan"), "none")]
    df = spark.createDataFrame(rows, "x double, part string").repartition(6)
    stored = materialize(sketches.quantile_sketches(df, ["x"], ["part"]), "sketches")
    assert stored.count() == 9 and stored.where("part = 'none' and n = 0 and sketch is null").count() == 1
    df.unpersist()
    probabilities = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    found = sketches.sketch_quantiles(sketches.merged_sketches(stored), probabilities).first()
    assert found["n"] == n and found["quantiles"][0] == values.min() and found["quantiles"][-1] == values.max()
    for p, q in zip(probabilities, found["quantiles"]):
        below, upto = ranks(values, q)
        assert below - 2 * sketches.rank_error() <= p <= upto + 2 * sketches.rank_error()
    one = stored.where("part = 'main'").select(sketches.sketch_rank(F.col("sketch"), F.lit(float(np.median(values)))).alias("r")).first()["r"]
    main = np.array([r[0] for r in rows if r[1] == "main" and r[0] is not None])
    below, upto = ranks(main, np.median(values))
    assert below - 0.02 <= one <= upto + 0.02


def test_sketches_stay_small(spark):
    sizes = [
        sketches.quantile_sketches(spark.range(n).select(F.col("id").alias("x")), ["x"]).select(F.length("sketch")).first()[0]
        for n in (20_000, 400_000)
    ]
    assert sizes[1] < 1.3 * sizes[0] < 40_000
    assert sketches.merged_sketches(sketches.quantile_sketches(spark.range(0), ["id"])).where("n > 0").count() == 0

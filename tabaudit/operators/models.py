"""Estimators: linear and RBF support vector machines, random forest, threshold rule."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Estimator names and their default parameters.
SVC = "svc"
RANDOM_FOREST = "random_forest"
THRESHOLD = "threshold"
ESTIMATORS = (SVC, RANDOM_FOREST, THRESHOLD)
DEFAULT_C = 1.0
DEFAULT_KERNEL = "rbf"
DEFAULT_TREES = 100
# Spark's deepest tree; stands for "no limit".
DEEPEST_TREE = 30
FOURIER, NYSTROM = "fourier", "nystrom"
APPROXIMATIONS = (FOURIER, NYSTROM)
FOURIER_FEATURES = 200
SVC_ITERATIONS = 100
SVC_TOLERANCE = 1e-3


def fourier_weights(p: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions and phases whose cosines approximate exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (p, size))
    return directions, rng.uniform(0.0, 2.0 * np.pi, size)


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features (Rahimi and Recht, 2007): sqrt(2 / D) cos(x W + b).

    An approximation of the RBF kernel that keeps the model linear.  The weights
    follow from the parameters, so only those are stored.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    inputSize = Param(Params._dummy(), "inputSize", "length of a vector", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=None, inputSize=None, gamma=None, seed=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        size = self.getOrDefault(self.size)
        weights, phases = fourier_weights(
            self.getOrDefault(self.inputSize),
            size,
            self.getOrDefault(self.gamma),
            self.getOrDefault(self.seed),
        )

        @F.pandas_udf("array<double>")
        def features(vectors: pd.Series) -> pd.Series:
            if vectors.empty:
                return pd.Series([], dtype=object)
            block = np.sqrt(2.0 / size) * np.cos(np.stack(vectors.to_numpy()) @ weights + phases)
            return pd.Series(list(block))

        made = features(vector_to_array(F.col(self.getOrDefault(self.inputCol))))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(made))


def _kernel(rows: np.ndarray, others: np.ndarray, gamma: float) -> np.ndarray:
    squared = (rows**2).sum(1)[:, None] + (others**2).sum(1)[None, :] - 2 * rows @ others.T
    return np.exp(-gamma * squared.clip(min=0))


def whitening(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """The matrix that makes kernel columns of landmarks into features whose products approximate the kernel."""
    sizes, axes = np.linalg.eigh(_kernel(landmarks, landmarks, gamma))
    kept = sizes > 1e-10 * sizes.max()
    return axes[:, kept] / np.sqrt(sizes[kept])


def choose_landmarks(vectors: DataFrame, column: str, size: int, gamma: float, seed: int, pilot: int | None = None) -> np.ndarray:
    """``size`` rows drawn by their ridge leverage, which is high for rows that few others stand for.

    ``pilot`` rows of smallest hash (five times ``size`` when not given) give an estimate of the leverage of every row; its ridge is the
    mean of the kernel's eigenvalues beyond ``size``.  Rows are drawn without replacement with that weight by
    one pass and a top-n; the draw follows from the seed and a row's content, and copies count once.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vector_to_array(F.col(column)).alias("v")).distinct()
    mark = F.xxhash64("v", F.lit(seed))
    first = rows.orderBy(mark, "v").limit(pilot or 5 * size).toPandas()["v"]
    if not len(first):
        raise ValueError("no rows to choose landmarks from")
    there = np.stack(first.to_numpy())
    kernel = _kernel(there, there, gamma)
    sizes = np.linalg.eigvalsh(kernel)[::-1]
    ridge = max(float(sizes[size:].mean()) if len(sizes) > size else 0.0, 1e-6)
    factor = np.linalg.inv(np.linalg.cholesky(kernel + ridge * np.eye(len(kernel))))
    sent = spark.sparkContext.broadcast((there, factor))

    @F.pandas_udf("double")
    def leverage(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=float)
        there, factor = sent.value
        columns = _kernel(np.stack(values.to_numpy()), there, gamma)
        explained = ((columns @ factor.T) ** 2).sum(axis=1)
        return pd.Series(((1.0 - explained) / ridge).clip(1e-9, 1.0) if ridge > 1e-6 else np.ones(len(values)))

    # The smallest of -ln(u) / weight are a weighted draw without replacement.
    uniform = (F.pmod(F.xxhash64("v", F.lit(seed + 1)), F.lit(2**40)) + 1).cast("double") / float(2**40 + 1)
    drawn = rows.withColumn("order", -F.log(uniform) / leverage("v")).orderBy("order", "v").limit(size)
    return np.stack(drawn.select("v").toPandas()["v"].to_numpy())


class NystromFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Kernel columns of landmark rows, whitened (Williams and Seeger, 2001).

    Products of the features are the kernel exactly between landmarks and nearly so elsewhere.  Tasks compute
    them block by block; landmarks are stored with the parameters.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    landmarks = Param(Params._dummy(), "landmarks", "entries of all landmarks", TypeConverters.toListFloat)
    inputSize = Param(Params._dummy(), "inputSize", "length of a vector", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, landmarks=None, inputSize=None, gamma=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma = self.getOrDefault(self.gamma)
        there = np.array(self.getOrDefault(self.landmarks)).reshape(-1, self.getOrDefault(self.inputSize))
        white = whitening(there, gamma)

        @F.pandas_udf("array<double>")
        def features(vectors: pd.Series) -> pd.Series:
            if vectors.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(_kernel(np.stack(vectors.to_numpy()), there, gamma) @ white))

        made = features(vector_to_array(F.col(self.getOrDefault(self.inputCol))))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(made))


def kernel_width(gamma: Any, p: int, variance: float) -> float:
    """"scale" is 1 / (p var(X)), "auto" is 1 / p, a number is itself."""
    if gamma in (None, "scale"):
        return 1.0 / (p * variance) if variance > 0 else 1.0
    if gamma == "auto":
        return 1.0 / p
    return float(gamma)


def overall_variance(train: DataFrame, column: str) -> float:
    """Variance over all entries of all vectors, as "scale" needs, from centred moments."""
    entries = train.select(F.explode(vector_to_array(F.col(column))).alias("entry"))
    return entries.agg(F.var_pop("entry")).first()[0] or 0.0


# Parameters that each estimator takes; others would be candidates that differ in name only.
_FOREST_PARAMS = {"n_estimators", "max_depth", "min_samples_leaf", "max_features", "max_samples", "criterion"}
ESTIMATOR_PARAMS = {
    SVC: {"C", "kernel", "gamma", "approximation"},
    RANDOM_FOREST: _FOREST_PARAMS,
    THRESHOLD: {"column", "cutoff"},
}


def check_params(kind: str, names: Iterable[str]) -> None:
    """An unknown parameter is an error, not ignored."""
    unknown = sorted(set(names) - ESTIMATOR_PARAMS[kind])
    if unknown:
        raise ValueError(f"{kind} has no parameter {', '.join(unknown)}")


def tree_depth(value: int | None) -> int:
    """The depth of a forest; no limit is Spark's deepest tree, and a deeper one is an error."""
    if value is None:
        return DEEPEST_TREE
    if int(value) > DEEPEST_TREE:
        raise ValueError(f"max_depth is at most {DEEPEST_TREE}, asked {value}")
    return int(value)


def _subset(value: Any) -> str:
    if value is None or value == 1.0 and isinstance(value, float):
        return "all"
    return str(value)


def fit_classifier(
    kind: str,
    params: Mapping[str, Any],
    train: DataFrame,
    n_rows: int,
    p: int,
    seed: int,
    features: str = "features",
    label: str = "label",
    classes: int = 2,
) -> PipelineModel:
    """Fit one estimator on ``(features, label)``; the model adds prediction columns."""
    check_params(kind, params)
    if kind == SVC:
        return _fit_svc(params, train, n_rows, p, seed, features, label, classes)
    if kind == RANDOM_FOREST:
        forest = RandomForestClassifier(
            featuresCol=features,
            labelCol=label,
            numTrees=int(params.get("n_estimators", DEFAULT_TREES)),
            maxDepth=tree_depth(params.get("max_depth")),
            minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_subset(params.get("max_features", "sqrt")),
            subsamplingRate=float(params.get("max_samples") or 1.0),
            impurity=params.get("criterion", "gini"),
            seed=seed,
        )
        return PipelineModel([forest.fit(train)])
    raise ValueError(f"no such estimator: {kind}")


def _fit_svc(
    params: Mapping[str, Any],
    train: DataFrame,
    n_rows: int,
    p: int,
    seed: int,
    features: str,
    label: str,
    classes: int,
) -> PipelineModel:
    kernel = params.get("kernel", DEFAULT_KERNEL)
    stages: list[Transformer] = []
    column = features
    if kernel == "rbf":
        column = "__fourier"
        gamma = params.get("gamma", "scale")
        variance = overall_variance(train, features) if gamma in (None, "scale") else 0.0
        stages.append(_kernel_features(params, train, features, column, p, kernel_width(gamma, p, variance), seed))
        train = stages[0].transform(train)
    elif kernel != "linear":
        raise ValueError(f"no such kernel: {kernel}")
    # The mean hinge loss here weighs against C times its sum there.
    svm = LinearSVC(
        featuresCol=column,
        labelCol=label,
        regParam=1.0 / (float(params.get("C", DEFAULT_C)) * max(n_rows, 1)),
        standardization=False,
        maxIter=SVC_ITERATIONS,
        tol=SVC_TOLERANCE,
    )
    if classes > 2:
        svm = OneVsRest(classifier=svm, featuresCol=column, labelCol=label)
    return PipelineModel([*stages, svm.fit(train)])


def _kernel_features(
    params: Mapping[str, Any], train: DataFrame, column: str, output: str, p: int, gamma: float, seed: int
) -> Transformer:
    """Features of ``FOURIER_FEATURES`` entries at most, by the asked approximation of the kernel."""
    asked = params.get("approximation", FOURIER)
    if asked == FOURIER:
        return FourierFeatures(inputCol=column, outputCol=output, size=FOURIER_FEATURES, inputSize=p, gamma=gamma, seed=seed)
    if asked != NYSTROM:
        raise ValueError(f"approximation must be one of {', '.join(APPROXIMATIONS)}")
    found = choose_landmarks(train, column, FOURIER_FEATURES, gamma, seed)
    return NystromFeatures(inputCol=column, outputCol=output, landmarks=found.ravel().tolist(), inputSize=p, gamma=gamma)


def positive_score(kind: str, raw: str = "rawPrediction", probability: str = "probability") -> Column:
    """Score of the positive class: margin of a machine, probability of a forest."""
    name = raw if kind == SVC else probability
    return F.element_at(vector_to_array(F.col(name)), 2)


def threshold_prediction(column: Column, cutoff: Column) -> Column:
    return (column > cutoff).cast("double")

"""Principal components of vectors too wide for a covariance matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.operators import block_linear


class Projection(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Products of a vector with fixed axes, the same as a PCA model makes them."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    axes = Param(Params._dummy(), "axes", "entries of all axes, one after another", TypeConverters.toListFloat)
    inputSize = Param(Params._dummy(), "inputSize", "length of a vector", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, axes=None, inputSize=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        axes = np.array(self.getOrDefault(self.axes)).reshape(-1, self.getOrDefault(self.inputSize))

        @F.pandas_udf("array<double>")
        def projected(vectors: pd.Series) -> pd.Series:
            if vectors.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(np.stack(vectors.to_numpy()) @ axes.T))

        made = projected(vector_to_array(F.col(self.getOrDefault(self.inputCol))))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(made))


@dataclass(frozen=True)
class LeadingComponents:
    """The first components of wide vectors: the model, their variances and their shares of the whole variance."""

    model: Projection
    variances: np.ndarray
    shares: np.ndarray


def fit_leading(vectors: DataFrame, column: str, output: str, k: int, seed: int = 42) -> LeadingComponents:
    """The first ``k`` principal components without a covariance matrix, for vectors of any length.

    ``column`` must be centred, as for :func:`tabaudit.operators.prep.fit_pca`.  The largest axis entry is made positive.
    """
    first = vectors.select(column).first()
    if first is None:
        raise ValueError("no rows to fit components on")
    width = len(first[0])
    blocks = block_linear.pack_vectors(vectors, column, width)
    everything = np.arange(width)
    view = block_linear.Prepared(None, 0, everything, np.full(width, np.nan), np.zeros(width), np.ones(width))
    found = block_linear.leading_rotations(blocks, [view], min(k, width), seed=seed)[0]
    top = found.axes[np.abs(found.axes).argmax(axis=0), np.arange(found.axes.shape[1])]
    axes = found.axes * np.where(top < 0, -1.0, 1.0)
    model = Projection(inputCol=column, outputCol=output, axes=axes.T.ravel().tolist(), inputSize=width)
    shares = found.variances / found.total if found.total > 0 else np.zeros_like(found.variances)
    return LeadingComponents(model, found.variances, shares)

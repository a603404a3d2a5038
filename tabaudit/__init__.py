"""Audit tabular datasets and compare classification models with Spark.

The library is a set of functions from ``DataFrame`` to ``DataFrame``.  See the
README for the map of modules and the notes on scale.
"""

from tabaudit.dataset import Dataset, from_rows

__all__ = ["Dataset", "from_rows"]

"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class is a normal distribution over transformed statistics of whole texts (logarithms of counts and
shares, so that junk of any amount stays within a few units).  Its covariance is shrunk in two steps
(Friedman 1989): towards the covariance common to both classes, then towards a multiple of the identity.  The score is
the difference of the log densities, from Mahalanobis distances with the Cholesky factors of the shrunk
covariances, and a logistic curve turns it into a probability.

Statistics are computed once for every document and written.  Of the labelled rows only counts, sums and sums of products
leave the tasks, by class and fold, so all of them are used.  Shrinkage is chosen by the log loss on folds that
did not take part, and the curve is fitted to a histogram of the same scores (``BINS`` by two counts).

Null and empty texts have no words; their statistics are finite and they are scored like others.  Several labels of one
document count by their mean (0.5 and above is 1).  Repeated rows get equal scores and each counts when labelled.  With
no labels of one class every score is the share of the other class (0.5 without any labels).  Empty tables
give no rows.  Very long texts are read whole, one at a time.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.llm.frames import Batches, each_text, text_bytes

FOLDS = 3
# Shares of the common covariance and of the identity that are tried.
COMMON = (0.0, 0.05, 0.2, 0.5, 1.0)
IDENTITY = (0.001, 0.01, 0.1)
BINS = 4001
_BIN_WIDTH = 0.05  # of asinh of the difference of log densities

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_STOPS = b".,;:'\"()-"
_MARKS = b"!?"
_BARS = b"|<>[]{}=_/\\~^"
_SIGNS = b"#*$%&@+"

FEATURES = (
    "words", "chars_per_word", "longest_word", "distinct", "upper", "digits", "stops", "marks", "bars", "signs",
    "lines_per_word", "dup_lines", "top_word", "repeated_pairs",
)


def features(text: str) -> tuple[float, ...]:
    """The transformed statistics of one whole text, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    letters = max(sum(map(len, words)), 1)

    def share(of: float, whole: float) -> float:
        return math.log(of / max(whole, 1) + 1e-3)

    def count(characters: bytes) -> int:
        return len(raw) - len(raw.translate(None, characters))

    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    pairs = len(set(zip(words, words[1:])))
    return (
        math.log1p(n),
        math.log((letters + 5) / (n + 1)),
        math.log1p(max(map(len, words), default=0)),
        math.log((len(counts) + 1) / (n + 1)) / math.log(n + 2),
        share(count(_UPPER), letters),
        share(count(_DIGITS), letters),
        share(count(_STOPS), n),
        share(count(_MARKS), n),
        share(count(_BARS), n),
        share(count(_SIGNS), n),
        share(len(lines), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(max(counts.values(), default=0), n),
        share(max(n - 1, 0) - pairs, n),
    )


def _measured(batches: Batches) -> Batches:
    for batch in batches:
        rows = [features(t) for t in each_text(batch.column(1), 100)]
        flat = pa.array(np.array(rows, np.float64).reshape(-1))
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the transformed statistics, of every document."""
    rows = docs.select(col("doc_id"), text_bytes("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_measured, f"doc_id {kind}, x array<double>")


@dataclass(frozen=True)
class Moments:
    """Count, sums and sums of products of some rows."""

    n: float
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.n - np.outer(self.mean, self.mean)

    @classmethod
    def none(cls, p: int) -> Moments:
        return cls(0.0, np.zeros(p), np.zeros((p, p)))

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        return cls(float(len(rows)), rows.sum(axis=0), rows.T @ rows)


@dataclass(frozen=True)
class Normal:
    """A normal distribution with the inverse Cholesky factor of its covariance at hand."""

    mean: np.ndarray
    whitening: np.ndarray
    log_scale: float

    @classmethod
    def fit(cls, mean: np.ndarray, covariance: np.ndarray) -> Normal:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, np.linalg.inv(factor), -float(np.log(np.diag(factor)).sum()))

    def log_density(self, rows: np.ndarray) -> np.ndarray:
        """Up to the constant that all distributions share."""
        squared = (((rows - self.mean) @ self.whitening.T) ** 2).sum(axis=1)
        return self.log_scale - 0.5 * squared


def shrunk(own: Moments, both: list[Moments], common: float, identity: float) -> np.ndarray:
    """The covariance of a class, drawn to that of all classes and then to a multiple of the identity."""
    within = sum(m.n * m.covariance for m in both) / sum(m.n for m in both)
    # A class of few rows is drawn to the common covariance at least as far as rows are missing.
    few = len(own.sums) / (len(own.sums) + own.n)
    common = max(common, few)
    mixed = (1 - common) * own.covariance + common * within
    size = max(np.trace(mixed) / len(mixed), 1e-9)
    return (1 - identity) * mixed + identity * size * np.eye(len(mixed))


@dataclass(frozen=True)
class Discriminant:
    """``score`` is the probability of class 1: logistic of ``slope * asinh(difference) + offset``."""

    good: Normal | None
    bad: Normal | None
    slope: float
    offset: float
    shrinkage: tuple[float, float] = (0.0, 0.0)

    def difference(self, rows: np.ndarray) -> np.ndarray:
        if self.good is None or self.bad is None:
            return np.zeros(len(rows))
        return self.good.log_density(rows) - self.bad.log_density(rows)

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = self.slope * np.arcsinh(self.difference(rows)) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def fit_classes(good: Moments, bad: Moments, shrinkage: tuple[float, float]) -> tuple[Normal, Normal]:
    both = [good, bad]
    return tuple(Normal.fit(m.mean, shrunk(m, both, *shrinkage)) for m in both)


def fit_curve(histogram: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """Slope, offset and log loss of a logistic curve through counts of (bin, class), by Newton's method."""
    z = (np.arange(len(histogram)) - len(histogram) // 2) * _BIN_WIDTH
    used = histogram.sum(axis=1) > 0
    z, bad, good = z[used], histogram[used, 0], histogram[used, 1]
    total = good.sum() + bad.sum()
    slope, offset, ridge = 1.0, 0.0, 1e-3

    def loss(a: float, b: float) -> float:
        t = a * z + b
        return float((good * np.logaddexp(0, -t) + bad * np.logaddexp(0, t)).sum() + 0.5 * ridge * a * a) / total

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -700, 700)))
        error, weight = (good + bad) * p - good, (good + bad) * p * (1 - p) + 1e-12
        gradient = np.array([error @ z + ridge * slope, error.sum()])
        hessian = np.array([[weight @ (z * z) + ridge, weight @ z], [weight @ z, weight.sum() + 1e-9]])
        move = np.linalg.solve(hessian, gradient)
        step, before = 1.0, loss(slope, offset)
        while step > 1e-6 and loss(slope - step * move[0], offset - step * move[1]) > before:
            step /= 2
        slope, offset = slope - step * float(move[0]), offset - step * float(move[1])
        if np.abs(step * move).max() < 1e-9:
            break
    return max(slope, 1e-6), offset, loss(slope, offset)


def _rows_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, -1)


def _class_moments(batches: Batches) -> Batches:
    """One row of moments for each (class, fold) of a task."""
    held: dict[tuple[int, int], Moments] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x, label, fold = _rows_of(batch, 0), np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for key in set(zip(label.tolist(), fold.tolist())):
            found = Moments.of(x[(label == key[0]) & (fold == key[1])])
            held[key] = held[key] + found if key in held else found
    rows = [
        {"label": k[0], "fold": k[1], "m": np.concatenate([[m.n], m.sums, m.products.reshape(-1)])} for k, m in held.items()
    ]
    schema = pa.schema([("label", pa.int32()), ("fold", pa.int32()), ("m", pa.list_(pa.float64()))])
    yield pa.RecordBatch.from_pylist(rows, schema)


def _histograms(models: dict[int, list[tuple[Normal, Normal]]]):
    """Counts of (shrinkage, bin, class), each row scored by the model of its fold."""

    def run(batches: Batches) -> Batches:
        tried = len(next(iter(models.values())))
        counts = np.zeros((tried, BINS, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label, fold = _rows_of(batch, 0), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for f in np.unique(fold):
                here = fold == f
                for i, (good, bad) in enumerate(models[int(f)]):
                    z = np.arcsinh(good.log_density(x[here]) - bad.log_density(x[here]))
                    place = np.clip(np.rint(z / _BIN_WIDTH).astype(int) + BINS // 2, 0, BINS - 1)
                    np.add.at(counts[i], (place, label[here]), 1)
        i, place, label = np.nonzero(counts)
        columns = [pa.array(a.astype(np.int32)) for a in (i, place, label)] + [pa.array(counts[i, place, label])]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "bin", "label", "n"])

    return run


def fit(labelled: DataFrame) -> Discriminant:
    """Learn from rows of ``x``, ``label`` (0 or 1) and ``fold``; they are read twice."""
    sums = labelled.select("x", "label", "fold").mapInArrow(_class_moments, "label int, fold int, m array<double>")
    p = len(FEATURES)
    size = 1 + p + p * p
    added = sums.groupBy("label", "fold").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m"))
    by_key: dict[tuple[int, int], Moments] = {}
    for row in added.toArrow().to_pylist():  # a row for each class and fold
        m = np.array(row["m"])
        by_key[row["label"], row["fold"]] = Moments(m[0], m[1 : 1 + p], m[1 + p :].reshape(p, p))

    def total(label: int, without: int | None = None) -> Moments:
        return sum((m for (c, f), m in by_key.items() if c == label and f != without), Moments.none(p))

    good, bad = total(1), total(0)
    if not good.n or not bad.n:
        prior = good.n / (good.n + bad.n) if good.n + bad.n else 0.5
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return Discriminant(None, None, 1.0, math.log(prior / (1 - prior)))
    grid = [(c, i) for c in COMMON for i in IDENTITY]
    # A fold without which a class would be empty is scored by the model of all rows.
    models = {}
    for fold in sorted({f for _, f in by_key}):
        parts = total(1, fold), total(0, fold)
        models[fold] = [fit_classes(*(parts if parts[0].n and parts[1].n else (good, bad)), s) for s in grid]
    counted = labelled.select("x", "label", "fold").mapInArrow(_histograms(models), "i int, bin int, label int, n long")
    histograms = np.zeros((len(grid), BINS, 2))
    for i, place, label, n in zip(*counted.groupBy("i", "bin", "label").agg(F.sum("n")).toArrow().to_pydict().values()):
        histograms[i, place, label] = n
    curves = [fit_curve(h) for h in histograms]
    best = min(range(len(grid)), key=lambda i: (curves[i][2], i))
    return Discriminant(*fit_classes(good, bad, grid[best]), *curves[best][:2], grid[best])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that may teach, with their class and a fold by a hash of their id."""
    key = F.col("doc_id").cast("string").cast("binary")
    judged = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    judged = judged.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return rows.join(judged, "doc_id").withColumn("fold", F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int"))


def _scored(model: Discriminant):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_rows_of(batch, 1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    rows = materialize(measured(docs), "features")
    model = fit(materialize(_labelled(rows, labels), "labelled"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "x").mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

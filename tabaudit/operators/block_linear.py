"""Linear machines of many candidates and folds, fitted together by one scan per step.

Rows are packed once into blocks of a bounded number of values.  Preparation is linear in a row apart from
its missing entries: with ``x`` (0 where missing) and ``m`` (1 where missing) a prepared row times a weight is
``x . v + m . (median * v) + c``, where ``v`` is the weight in terms of raw columns.  So the margins of all
(candidate, fold) pairs are two matrix products of a block, whatever their scaling, selection or rotation,
and their gradients two more.  Tasks return sums over their rows, which are added up in two levels.

Machines on random Fourier features are fitted in the same scans: a task prepares and lifts its block once for each view
and kernel, so their number adds work inside a scan but no scan.

The driver runs L-BFGS for all pairs side by side.  A scan evaluates the trial point of every pair that has not ended,
so the number of scans is that of the slowest pair, not the sum over pairs.  The loss is the mean hinge, rounded off
over ``SMOOTH`` of a margin so that it has a gradient, plus the ridge of the weights without the intercept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.operators.prep import FittedPrep

BLOCK_VALUES, BLOCK_ROWS = 1_000_000, 8_192
SMOOTH = 0.05
MAX_SCANS = 100
TOLERANCE = 1e-4
# Sums of so many tasks are collected; those of more are added up in lots first.
DIRECT_TASKS = 64
_HISTORY = 12

_BLOCK_SCHEMA = "x binary, label binary, fold binary"


# -- blocks -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Blocks:
    """Packed rows of some columns, with a label and a fold each."""

    df: DataFrame
    columns: tuple[str, ...]

    def scan(
        self,
        step: Callable[[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], np.ndarray],
        combine: Callable[[Sequence[np.ndarray]], np.ndarray] = sum,
    ) -> np.ndarray:
        """``step`` of every task, one array for all of its blocks, put together in two levels by ``combine``."""
        width = len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = step(_unpacked(batches, width))
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])

        def added(parts: pd.DataFrame) -> pd.DataFrame:
            total = combine([np.frombuffer(b) for b in parts["sums"]])
            return pd.DataFrame({"sums": [total.tobytes()]})

        parts = self.df.mapInArrow(run, "sums binary")
        if self.tasks > DIRECT_TASKS:
            lot = F.spark_partition_id() % F.lit(int(self.tasks**0.5))
            parts = parts.withColumn("lot", lot).groupBy("lot").applyInPandas(added, "sums binary")
        sums = parts.collect()
        return combine([np.frombuffer(r["sums"]) for r in sums])

    @cached_property
    def tasks(self) -> int:
        """Tasks of a scan."""
        return self.df.select(F.spark_partition_id().alias("p")).distinct().count()


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, label, fold in zip(*(batch.column(i) for i in range(3))):
            labels = np.frombuffer(label.as_py())
            yield np.frombuffer(x.as_py()).reshape(len(labels), width), labels, np.frombuffer(fold.as_py(), np.int32)


def pack(rows: DataFrame, columns: Sequence[str], label: str, fold: str) -> Blocks:
    """Write ``rows`` as blocks; missing entries are NaN."""
    values = F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    chosen = rows.select(values.alias("x"), col(label).cast("double").alias("label"), col(fold).cast("int").alias("fold"))
    return _packed(chosen, tuple(columns))


def _packed(chosen: DataFrame, columns: tuple[str, ...]) -> Blocks:
    size = max(min(BLOCK_VALUES // max(len(columns), 1), BLOCK_ROWS), 1)

    def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, labels, folds = (np.concatenate(p) for p in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (x, labels, folds)], names=["x", "label", "fold"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.asarray(part.column(0).flatten()).reshape(part.num_rows, -1)
                held.append((x, np.asarray(part.column(1)), np.asarray(part.column(2))))
                count += part.num_rows
                if count >= size:
                    yield packed(held)
                    held, count = [], 0
        if held:
            yield packed(held)

    return Blocks(materialize(chosen.mapInArrow(run, _BLOCK_SCHEMA), "blocks"), columns)


# -- preparation in terms of raw columns -------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """A linear view of rows: ``(filled - mean) / scale`` of some columns, then ``rotation`` if there is one."""

    held_out: int | None
    n_rows: int
    places: np.ndarray
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    rotation: np.ndarray | None = None

    @classmethod
    def of(cls, prep: FittedPrep, held_out: int | None, columns: Sequence[str]) -> Prepared:
        at = {c: i for i, c in enumerate(columns)}

        def values(found: dict[str, float], default: float) -> np.ndarray:
            return np.array([found.get(c, default) for c in prep.features], float)

        places = np.array([at[c] for c in prep.features], int)
        medians, means, scales = values(prep.medians, np.nan), values(prep.means, 0.0), values(prep.scales, 1.0)
        return cls(held_out, prep.n_rows, places, medians, means, scales)

    @property
    def width(self) -> int:
        return len(self.places) if self.rotation is None else self.rotation.shape[1]

    def raw(self, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights (columns: fits) as factors of raw values and of missing entries, and what is added."""
        inner = weights if self.rotation is None else self.rotation @ weights
        scaled = inner / self.scales[:, None]
        value, missing = np.zeros((width, weights.shape[1])), np.zeros((width, weights.shape[1]))
        value[self.places] = scaled
        missing[self.places] = self.medians[:, None] * scaled
        return value, missing, -(self.means @ scaled)

    def rows(self, value: np.ndarray, missing: np.ndarray | None) -> np.ndarray:
        """Prepared rows themselves, for what is not linear in them."""
        found = value[:, self.places]
        if missing is not None:
            found = found + missing[:, self.places] * self.medians
        found = (found - self.means) / self.scales
        return found if self.rotation is None else found @ self.rotation

    def gradient(self, value: np.ndarray, missing: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The reverse of ``raw``: sums over rows of slope times prepared row, from sums in raw terms."""
        found = value[self.places] + self.medians[:, None] * missing[self.places] - self.means[:, None] * total[None, :]
        found = found / self.scales[:, None]
        return found if self.rotation is None else self.rotation.T @ found


def _no_median(views: Sequence[Prepared]) -> list[Prepared]:
    """Without an imputer no entry may be missing; a median of 0 then stands for nothing."""
    return [
        Prepared(v.held_out, v.n_rows, v.places, np.where(np.isnan(v.medians), 0.0, v.medians), v.means, v.scales, v.rotation)
        for v in views
    ]


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    missing = np.isnan(x)
    if not missing.any():
        return x, None
    return np.where(missing, 0.0, x), missing.astype(float)


def _column_moments(blocks: Blocks, views: Sequence[Prepared]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows, and mean and variance of every prepared column without the rotation, of each view; one scan for all folds."""
    p = len(blocks.columns)
    folds = sorted({v.held_out for v in views if v.held_out is not None})
    place = {f: i for i, f in enumerate(folds)}
    cells = len(folds) + 1  # the last holds rows of any other fold

    def step(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        sums = np.zeros((cells, 1 + 3 * p))
        for x, _, fold in parts:
            cell = np.array([place.get(int(f), cells - 1) for f in fold])
            for i in np.unique(cell):
                value, missing = _split(x[cell == i])
                holes = np.zeros(p) if missing is None else missing.sum(0)
                sums[i] += np.concatenate([[len(value)], value.sum(0), (value**2).sum(0), holes])
        return sums.ravel()

    sums = blocks.scan(step).reshape(cells, 1 + 3 * p)
    found = []
    for view in _no_median(views):
        total = sum(s for i, s in enumerate(sums) if view.held_out is None or i != place[view.held_out])
        n, mid = max(total[0], 1.0), view.medians
        first, second, holes = (total[1 + i * p :][:p][view.places] for i in range(3))
        mean = (first + mid * holes) / n
        square = (second + mid**2 * holes) / n
        found.append((int(total[0]), (mean - view.means) / view.scales, (square - mean**2).clip(min=0) / view.scales**2))
    return found


def spreads(blocks: Blocks, views: Sequence[Prepared]) -> list[float]:
    """The variance over all entries of all training rows of each view without a rotation."""
    return [float((v + m**2).mean() - m.mean() ** 2) for _, m, v in _column_moments(blocks, views)]


@dataclass(frozen=True)
class Axes:
    """Leading principal axes (columns), their variances, and the variance of all columns together."""

    axes: np.ndarray
    variances: np.ndarray
    total: float


def leading_rotations(
    blocks: Blocks, views: Sequence[Prepared], k: int, extra: int = 10, rounds: int = 3, seed: int = 42
) -> list[Axes]:
    """The first ``k`` principal axes of each view by a randomised range finder (Halko, Martinsson and Tropp, 2011).

    Nothing of the size of a covariance is made: a scan multiplies the rows with a thin basis and back, for all views at once,
    and the driver makes the result orthogonal.  After ``rounds`` scans the rows in terms of the basis
    are decomposed as tall thin matrices: every task keeps the triangle of its own rows, and triangles are stacked and
    decomposed again in a tree.
    """
    p = len(blocks.columns)
    plain = _no_median(views)
    moments = _column_moments(blocks, plain)
    sizes = [min(k + extra, v.width) for v in plain]
    bases = [np.linalg.qr(np.random.default_rng(seed).normal(size=(v.width, n)))[0] for v, n in zip(plain, sizes)]
    held_out = [v.held_out for v in plain]

    def maps() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        made = []
        for view, base, (_, mean, _) in zip(plain, bases, moments):
            value, missing, added = view.raw(base, p)
            made.append((value, missing, added - mean @ base))
        return made

    def thin(sent: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, fold: np.ndarray):
        value, missing = _split(x)
        for (to_value, to_missing, added), out in zip(sent, held_out):
            y = value @ to_value + added
            if missing is not None:
                y += missing @ to_missing
            if out is not None:
                y[fold == out] = 0.0
            yield value, missing, y

    for _ in range(rounds):
        sent = blocks.df.sparkSession.sparkContext.broadcast(maps())

        def step(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
            sums = [(np.zeros((p, n)), np.zeros((p, n)), np.zeros(n)) for n in sizes]
            for x, _, fold in parts:
                for (by_value, by_missing, added), (value, missing, y) in zip(sums, thin(sent.value, x, fold)):
                    by_value += value.T @ y
                    if missing is not None:
                        by_missing += missing.T @ y
                    added += y.sum(0)
            return np.concatenate([a.ravel() for s in sums for a in s])

        sums, at = blocks.scan(step), 0
        for i, (view, n, (_, mean, _)) in enumerate(zip(plain, sizes, moments)):
            by_value, by_missing = sums[at : at + 2 * p * n].reshape(2, p, n)
            added = sums[at + 2 * p * n : at + 2 * p * n + n]
            at += 2 * p * n + n
            bases[i] = np.linalg.qr(view.gradient(by_value, by_missing, added) - np.outer(mean, added))[0]
    sent = blocks.df.sparkSession.sparkContext.broadcast(maps())

    def triangles(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        held = [np.zeros((n, n)) for n in sizes]
        for x, _, fold in parts:
            for i, (_, _, y) in enumerate(thin(sent.value, x, fold)):
                held[i] = _triangle(np.concatenate([held[i], y]))
        return np.concatenate([r.ravel() for r in held])

    def stacked(parts: Sequence[np.ndarray]) -> np.ndarray:
        merged, at = [], 0
        for n in sizes:
            merged.append(_triangle(np.concatenate([part[at : at + n * n].reshape(n, n) for part in parts])).ravel())
            at += n * n
        return np.concatenate(merged)

    found, at = [], 0
    merged = blocks.scan(triangles, stacked)
    for base, n, (rows, _, variance) in zip(bases, sizes, moments):
        _, singular, turn = np.linalg.svd(merged[at : at + n * n].reshape(n, n))
        at += n * n
        found.append(Axes((base @ turn.T)[:, :k], singular[:k] ** 2 / max(rows, 1), float(variance.sum())))
    return found


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The square factor of a tall matrix."""
    found = np.linalg.qr(rows, mode="r")
    return np.concatenate([found, np.zeros((rows.shape[1] - len(found), rows.shape[1]))])


def pack_vectors(vectors: DataFrame, column: str, width: int) -> Blocks:
    """Blocks of a vector column, all in fold 0 and without labels."""
    values = vectors.select(vector_to_array(F.col(column)).alias("x"), F.lit(0.0).alias("label"), F.lit(0).alias("fold"))
    return _packed(values, tuple(f"{column}{i}" for i in range(width)))


def rotations(blocks: Blocks, views: Sequence[Prepared]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Principal axes (columns) and their variances for each view, from one scan for all folds."""
    p = len(blocks.columns)
    folds = sorted({v.held_out for v in views if v.held_out is not None})
    place = {f: i for i, f in enumerate(folds)}
    cells = len(folds) + 1  # the last holds rows of any other fold
    size = 1 + 2 * p + 3 * p * p

    def step(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        sums = np.zeros((cells, size))
        for x, _, fold in parts:
            cell = np.array([place.get(int(f), cells - 1) for f in fold])
            for i in np.unique(cell):
                value, missing = _split(x[cell == i])
                missing = np.zeros_like(value) if missing is None else missing
                sums[i] += np.concatenate(
                    [[len(value)], value.sum(0), missing.sum(0), (value.T @ value).ravel(), (missing.T @ value).ravel(), (missing.T @ missing).ravel()]
                )
        return sums.ravel()

    sums = blocks.scan(step).reshape(cells, size)
    found = []
    for view in _no_median(views):
        total = sum(s for i, s in enumerate(sums) if view.held_out is None or i != place[view.held_out])
        n, at = total[0], np.ix_(view.places, view.places)
        value, missing = total[1 : 1 + p][view.places], total[1 + p : 1 + 2 * p][view.places]
        vv, mv, mm = (total[1 + 2 * p + i * p * p :][: p * p].reshape(p, p)[at] for i in range(3))
        mid = view.medians
        mean = (value + mid * missing) / n
        cross = mid[:, None] * mv
        second = (vv + cross + cross.T + mid[:, None] * mid[None, :] * mm) / n
        covariance = (second - np.outer(mean, mean)) / np.outer(view.scales, view.scales)
        sizes, axes = np.linalg.eigh(covariance)
        found.append((axes[:, ::-1], sizes[::-1].clip(min=0)))
    return found


# -- fits ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lift:
    """Random Fourier features of the first columns of a view: directions and phases."""

    directions: np.ndarray
    phases: np.ndarray

    def apply(self, rows: np.ndarray) -> np.ndarray:
        inner, size = self.directions.shape
        return np.sqrt(2.0 / size) * np.cos(rows[:, :inner] @ self.directions + self.phases)


@dataclass(frozen=True)
class Fit:
    """One machine: a view of the training rows, how many of its columns, the strength of the ridge, the positive label.

    With a ``lift`` the machine is linear in its ``size`` features; machines share a lift by holding the same object.
    """

    cand_id: int
    view: Prepared
    size: int
    ridge: float
    positive: float = 1.0
    lift: Lift | None = None


@dataclass
class _State:
    """L-BFGS of one fit, fed with a loss and a gradient at ``trial``."""

    trial: np.ndarray
    weights: np.ndarray | None = None
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    slope: float = 0.0
    step: float = 1.0
    moves: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    flat: int = 0
    done: bool = False

    def feed(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        if self.weights is None:
            self._accept(loss, gradient)
        elif loss <= self.loss + 1e-4 * self.step * self.slope:
            drop = self.loss - loss
            move, change = self.trial - self.weights, gradient - self.gradient
            if move @ change > 1e-12 * np.sqrt((move @ move) * (change @ change)):
                self.moves = [*self.moves[-_HISTORY + 1 :], (move, change)]
            self._accept(loss, gradient)
            # Three steps in a row that hardly gain anything end the fit; one may be a short step only.
            self.flat = self.flat + 1 if drop <= tolerance * max(abs(loss), 1e-3) else 0
            self.done = self.flat == 3
        else:
            self.step /= 2
            if self.step < 1e-8:
                self.done = True
            self.trial = self.weights + self.step * self.direction
            return
        if np.sqrt(gradient @ gradient) <= tolerance * max(1e-3, np.abs(loss)):
            self.done = True
        self._aim()

    def _accept(self, loss: float, gradient: np.ndarray) -> None:
        self.weights, self.loss, self.gradient = self.trial, loss, gradient

    def _aim(self) -> None:
        found = -self.gradient
        factors = []
        for move, change in reversed(self.moves):
            a = (move @ found) / (move @ change)
            factors.append(a)
            found = found - a * change
        if self.moves:
            move, change = self.moves[-1]
            found = found * ((move @ change) / (change @ change))
        else:
            found = found / max(np.sqrt(found @ found), 1.0)
        for (move, change), a in zip(self.moves, reversed(factors)):
            found = found + move * (a - (change @ found) / (move @ change))
        if found @ self.gradient >= 0:
            found, self.moves = -self.gradient, []
        self.direction, self.slope, self.step = found, float(found @ self.gradient), 1.0
        self.trial = self.weights + found


@dataclass(frozen=True)
class FittedMachines:
    """Weights (intercept last) of every fit, in order, and the scans that it took."""

    fits: tuple[Fit, ...]
    weights: tuple[np.ndarray, ...]
    scans: int


class _Raw:
    """Weights of several fits: in terms of raw columns, or of the features of each lift."""

    def __init__(self, fits: Sequence[Fit], weights: Sequence[np.ndarray], width: int):
        self.count = len(fits)
        self.straight = np.array([i for i, f in enumerate(fits) if f.lift is None], int)
        self.value = np.zeros((width, len(self.straight)))
        self.missing = np.zeros((width, len(self.straight)))
        self.added = np.zeros(len(fits))
        for k, i in enumerate(self.straight):
            fit = fits[i]
            whole = np.zeros((fit.view.width, 1))
            whole[: fit.size, 0] = weights[i][:-1]
            value, missing, added = fit.view.raw(whole, width)
            self.value[:, k], self.missing[:, k], self.added[i] = value[:, 0], missing[:, 0], added[0] + weights[i][-1]
        self.lifted: list[tuple[Prepared, Lift, np.ndarray, np.ndarray]] = []
        lifts = {id(f.lift): f for f in fits if f.lift is not None}
        for key, first in lifts.items():
            mine = np.array([i for i, f in enumerate(fits) if id(f.lift) == key], int)
            self.added[mine] = [weights[i][-1] for i in mine]
            self.lifted.append((first.view, first.lift, mine, np.stack([weights[i][:-1] for i in mine], axis=1)))

    def features(self, value: np.ndarray, missing: np.ndarray | None) -> list[np.ndarray]:
        return [lift.apply(view.rows(value, missing)) for view, lift, _, _ in self.lifted]

    def margins(self, value: np.ndarray, missing: np.ndarray | None, features: Sequence[np.ndarray]) -> np.ndarray:
        found = np.tile(self.added, (len(value), 1))
        if len(self.straight):
            found[:, self.straight] += value @ self.value
            if missing is not None:
                found[:, self.straight] += missing @ self.missing
        for made, (_, _, mine, inner) in zip(features, self.lifted):
            found[:, mine] += made @ inner
        return found


def _held_out(fits: Sequence[Fit]) -> np.ndarray:
    return np.array([-1 if f.view.held_out is None else f.view.held_out for f in fits])


def _losses(blocks: Blocks, fits: Sequence[Fit], trials: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient of every fit at its trial point, from one scan."""
    p, k = len(blocks.columns), len(fits)
    raw, held_out, positive = _Raw(fits, trials, p), _held_out(fits), np.array([f.positive for f in fits])
    straight = raw.straight
    shapes = [inner.shape for _, _, _, inner in raw.lifted]
    sent = blocks.df.sparkSession.sparkContext.broadcast((raw, held_out, positive))

    def step(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        raw, held_out, positive = sent.value
        loss, added = np.zeros(k), np.zeros(k)
        value_sums, missing_sums = np.zeros((p, len(straight))), np.zeros((p, len(straight)))
        lifted_sums = [np.zeros(shape) for shape in shapes]
        for x, label, fold in parts:
            value, missing = _split(x)
            features = raw.features(value, missing)
            sign = np.where(label[:, None] == positive[None, :], 1.0, -1.0)
            short = 1.0 - sign * raw.margins(value, missing, features)
            inside = (short > 0) & (fold[:, None] != held_out[None, :])
            bent = inside & (short < SMOOTH)
            loss += np.where(bent, short**2 / (2 * SMOOTH), np.where(inside, short - SMOOTH / 2, 0.0)).sum(0)
            slope = -sign * np.where(bent, short / SMOOTH, inside)
            added += slope.sum(0)
            value_sums += value.T @ slope[:, straight]
            if missing is not None:
                missing_sums += missing.T @ slope[:, straight]
            for sums, made, (_, _, mine, _) in zip(lifted_sums, features, raw.lifted):
                sums += made.T @ slope[:, mine]
        return np.concatenate([loss, added, value_sums.ravel(), missing_sums.ravel(), *(a.ravel() for a in lifted_sums)])

    sums = blocks.scan(step)
    loss, added = sums[:k], sums[k : 2 * k]
    at = 2 * k + 2 * p * len(straight)
    value, missing = sums[2 * k : at].reshape(2, p, len(straight))
    inner: dict[int, np.ndarray] = {}
    for j, i in enumerate(straight):
        fit = fits[i]
        inner[int(i)] = fit.view.gradient(value[:, j : j + 1], missing[:, j : j + 1], added[i : i + 1])[: fit.size, 0]
    for shape, (_, _, mine, _) in zip(shapes, raw.lifted):
        part = sums[at : at + shape[0] * shape[1]].reshape(shape)
        at += shape[0] * shape[1]
        inner |= {int(i): part[:, j] for j, i in enumerate(mine)}
    found = []
    for i, (fit, w) in enumerate(zip(fits, trials)):
        n = max(fit.view.n_rows, 1)
        gradient = np.append(inner[i], added[i]) / n
        gradient[:-1] += fit.ridge * w[:-1]
        found.append((loss[i] / n + 0.5 * fit.ridge * float(w[:-1] @ w[:-1]), gradient))
    return found


def fit_machines(blocks: Blocks, fits: Sequence[Fit], max_scans: int = MAX_SCANS, tolerance: float = TOLERANCE) -> FittedMachines:
    """Fit all machines together; one scan for each step of those that have not ended."""
    fits = [replace(f, view=v) for f, v in zip(fits, _no_median([f.view for f in fits]))]
    states = [_State(np.zeros(f.size + 1)) for f in fits]
    scans = 0
    while scans < max_scans:
        active = [i for i, s in enumerate(states) if not s.done]
        if not active:
            break
        found = _losses(blocks, [fits[i] for i in active], [states[i].trial for i in active])
        for i, (loss, gradient) in zip(active, found):
            states[i].feed(loss, gradient, tolerance)
        scans += 1
    return FittedMachines(tuple(fits), tuple(s.weights for s in states), scans)


def score_held_out(blocks: Blocks, machines: FittedMachines, labels: Sequence[float]) -> DataFrame:
    """Rows ``(cand_id, fold, label, prediction, score)``: every row by all machines that did not see it, in one scan.

    With more than two ``labels`` a candidate has a machine for each, the largest margin wins and ``score`` is null.
    """
    p = len(blocks.columns)
    raw, held_out = _Raw(machines.fits, machines.weights, p), _held_out(machines.fits)
    cand = np.array([f.cand_id for f in machines.fits], np.int32)
    positive = np.array([f.positive for f in machines.fits])
    many = len(labels) > 2
    sent = blocks.df.sparkSession.sparkContext.broadcast((raw, held_out, cand, positive))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, held_out, cand, positive = sent.value
        for x, label, fold in _unpacked(batches, p):
            value, missing = _split(x)
            margins = raw.margins(value, missing, raw.features(value, missing))
            for f in np.unique(fold):
                rows = np.flatnonzero(fold == f)
                for c in np.unique(cand[held_out == f]):
                    mine = np.flatnonzero((held_out == f) & (cand == c))
                    found = margins[np.ix_(rows, mine)]
                    if many:
                        predicted, score = positive[mine][found.argmax(axis=1)], pa.nulls(len(rows), pa.float64())
                    else:
                        predicted, score = (found[:, 0] > 0).astype(float), pa.array(found[:, 0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), c)), pa.array(np.full(len(rows), f)), pa.array(label[rows]), pa.array(predicted), score],
                        names=["cand_id", "fold", "label", "prediction", "score"],
                    )

    return blocks.df.mapInArrow(run, "cand_id int, fold int, label double, prediction double, score double")

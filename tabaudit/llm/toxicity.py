"""Toxicity by compression distance with zstandard dictionaries.

A text is cut into windows of ``WINDOW`` words.  Each is compressed with an ordinary dictionary and
with a toxic one; the bytes that the toxic one saves are the window's distance.  Both
hold the same content trained on ordinary text, so that they differ only in what was
trained on toxic text, or on more ordinary text to fill the same room.  Windows that pass a first
pair of dictionaries are measured with a second pair, trained on other ordinary text, and keep the
smaller saving: a chance match seldom occurs in both.  Thresholds on a text's savings
are calibrated on labelled texts that no dictionary was trained on, and give its score.

The toxic dictionary is trained on *marked* stretches of toxic texts, those whose byte sequences are more frequent than in
ordinary texts; common prose would only add the same content to both sides.  The distinct stretches, the most frequent last,
are put before what the training kept, so that those of rare languages have a place.  Ordinary
dictionaries are trained on windows without marked sequences, as a word that ordinary texts have now and then
would cost the same on both sides otherwise.  How much more frequent a marked sequence must be, and in what share of toxic
texts (``SETTINGS``), is chosen inside the fit: each setting's weights are fitted on two thirds of the calibration
texts and judged on the others by log loss.  Rows that are held out take no part.

Dictionaries and thresholds are fitted on the driver on a bounded sample of labelled rows (``Bounds``);
every text is then scored whole.  Nulls and texts without words have no window and get the score
of a text without savings.  Repeated rows get equal scores.  Without rows of both classes nothing can be
learnt and all scores are 0.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.llm.frames import decoded, each_text, fresh, text_bytes

WINDOW = 8  # words
GRAM = 6  # bytes
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 1_536
PROSE_WINDOWS = 20_000  # ordinary windows that a dictionary is trained on
THRESHOLD = 0.3
# Savings in bytes from which a window counts in the features.
STEPS = (1, 3, 5, 7)
FIRST = STEPS[0]


@dataclass(frozen=True)
class Bounds:
    """How many labelled rows the model is fitted on; longer texts are not used for fitting."""

    toxic: int = 1_600
    ordinary: int = 4_000
    characters: int = 10_000


@dataclass(frozen=True)
class Setting:
    """When byte sequences are marked: the log of their relative frequency, and the share of toxic texts that have them."""

    contrast: float
    share: float


SETTINGS = tuple(Setting(contrast, share) for contrast in (3.0, 2.4, 1.8) for share in (0.015, 0.025, 0.04))
FEWEST_TEXTS = 4
STRETCH_BYTES = 2_048


@dataclass(frozen=True)
class Model:
    """Pairs of (ordinary, toxic) dictionary contents, and calibrated weights."""

    pairs: tuple[tuple[bytes, bytes], ...]
    weights: tuple[float, ...]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def windows(text: str) -> list[bytes]:
    words = words_of(text)
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


@lru_cache(maxsize=8)
def _compress(content: bytes):
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
    ).compress


def savings(text: str, pairs: tuple[tuple[bytes, bytes], ...]) -> list[int]:
    """Bytes that the toxic dictionary saves in each window, if every pair saves ``FIRST`` at least; else 0."""
    found = []
    steps = [(_compress(ordinary), _compress(toxic)) for ordinary, toxic in pairs]
    for window in windows(text):
        least = 1 << 20
        for ordinary, toxic in steps:
            least = min(least, len(ordinary(window)) - len(toxic(window)))
            if least < FIRST:
                least = 0
                break
        found.append(least)
    return found


def features(saved: list[int]) -> list[float]:
    n, total = max(1, len(saved)), sum(saved)
    top = sorted(saved, reverse=True)[:4] + [0, 0, 0, 0]
    hits = [sum(s >= step for s in saved) for step in STEPS]
    counts = [math.log1p(x) for x in (*hits, total, len(saved))]
    return [1.0, *top[:4], *counts, float(not saved), math.sqrt(hits[1] / n), math.sqrt(hits[2] / n), total / n]


def _chance(row: list[float], weights: tuple[float, ...]) -> float:
    z = sum(a * b for a, b in zip(row, weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(text: str, model: Model | None) -> float:
    return 0.0 if model is None else _chance(features(savings(text, model.pairs)), model.weights)


def _grams(word: bytes) -> set[bytes]:
    spaced = b" " + word + b" "
    return {spaced[i : i + GRAM] for i in range(max(1, len(spaced) - GRAM + 1))}


class _Frequencies:
    """How often byte sequences occur in words of some texts, and in how many texts."""

    def __init__(self, texts: list[str]) -> None:
        self.times: Counter[bytes] = Counter()
        self.texts: Counter[bytes] = Counter()
        self.words, self.n = 0, len(texts)
        for text in texts:
            here: Counter[bytes] = Counter()
            for word, n in Counter(words_of(text)).items():
                self.words += n
                for gram in _grams(word):
                    here[gram] += n
            self.times.update(here)
            self.texts.update(here.keys())

    def log_rate(self, gram: bytes) -> float:
        return math.log((self.times[gram] + 0.5) / max(1, self.words))


def marked_grams(toxic: _Frequencies, ordinary: _Frequencies, setting: Setting) -> set[bytes]:
    least = max(FEWEST_TEXTS, setting.share * toxic.n)
    often = (g for g, n in toxic.texts.items() if n >= least)
    return {g for g in often if toxic.log_rate(g) - ordinary.log_rate(g) > setting.contrast}


def stretches(texts: list[str], marked: set[bytes]) -> list[bytes]:
    """The stretches of words that marked sequences cover."""
    found = []
    for text in texts:
        for word in words_of(text):
            spaced = b" " + word + b" "
            covered = [False] * len(spaced)
            for i in range(max(1, len(spaced) - GRAM + 1)):
                if spaced[i : i + GRAM] in marked:
                    covered[i : i + GRAM] = [True] * len(covered[i : i + GRAM])
            stretch = bytearray()
            for byte, on in zip(spaced + b"\0", [*covered, False]):
                if on:
                    stretch.append(byte)
                elif stretch:
                    found.append(bytes(stretch))
                    stretch = bytearray()
    return found


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few samples for training are used as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _calibrate(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(rows.shape[1])
    ridge = np.full(rows.shape[1], 1e-2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(rows.T @ (rows * curve[:, None]) + np.diag(ridge), rows.T @ (weight * (labels - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def _toxic_content(found: list[bytes]) -> bytes:
    """What a dictionary keeps of the stretches, after the distinct ones that occur twice or more and have room."""
    kept = _trained([b"".join(found[i : i + 8]) for i in range(0, len(found), 8)], TOXIC_BYTES)
    before = b""
    for stretch, n in Counter(found).most_common():
        if n < 2 or len(before) + len(stretch) > STRETCH_BYTES:
            break
        if stretch not in kept and stretch not in before:
            before = stretch + before
    return before + kept


def _pairs(toxic: list[str], ordinary: list[list[bytes]], marked: set[bytes]) -> tuple[tuple[bytes, bytes], ...]:
    """A pair of dictionaries for each half of the ordinary windows."""
    content = _toxic_content(stretches(toxic, marked))
    pairs = []
    for prose in ordinary:
        plain = [w for w in prose if not any(w[i : i + GRAM] in marked for i in range(len(w) - GRAM + 1))]
        shared = _trained(plain[:PROSE_WINDOWS], ORDINARY_BYTES)
        filler = _trained(plain[-PROSE_WINDOWS:], max(256, len(content)))[-len(content) :]
        pairs.append((shared + filler, shared + content))
    return tuple(pairs)


def _loss(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """Weighted log loss of rows by weights fitted on the other thirds."""
    total, third = 0.0, np.arange(len(rows)) % 3
    for k in range(3):
        beta = np.array(_calibrate(rows[third != k], labels[third != k], weight[third != k]))
        z = np.clip(rows[third == k] @ beta, -30, 30)
        total += float((weight[third == k] * np.logaddexp(0, np.where(labels[third == k] == 1, -z, z))).sum())
    return total


def train(toxic: list[str], ordinary: list[str], toxic_share: float, settings: tuple[Setting, ...] = SETTINGS, seed: int = 17) -> Model | None:
    """Two thirds of each class train the dictionaries, the rest calibrates the thresholds and chooses the setting."""
    if len(toxic) < 3 or len(ordinary) < 3:
        return None
    draw = Random(seed)
    fit = [[t for i, t in enumerate(texts) if i % 3] for texts in (toxic, ordinary)]
    test = [[t for i, t in enumerate(texts) if i % 3 == 0] for texts in (toxic, ordinary)]
    seen = [_Frequencies(texts) for texts in fit]
    prose = []
    for half in (0, 1):
        every = [w for i, t in enumerate(fit[1]) if i % 2 == half for w in windows(t)]
        prose.append(draw.sample(every, min(len(every), 2 * PROSE_WINDOWS)))
    labels = np.array([1.0] * len(test[0]) + [0.0] * len(test[1]))
    weight = np.where(labels == 1, toxic_share / len(test[0]), (1 - toxic_share) / len(test[1])) * len(labels)
    best: tuple[float, Model] | None = None
    for setting in settings:
        marked = marked_grams(*seen, setting)
        if not marked:
            continue
        pairs = _pairs(fit[0], prose, marked)
        rows = np.array([features(savings(t, pairs)) for texts in test for t in texts])
        loss = _loss(rows, labels, weight)
        if best is None or loss < best[0]:
            best = loss, Model(pairs, _calibrate(rows, labels, weight))
    return None if best is None else best[1]


def held_out(id_column: Column) -> Column:
    """Rows never used for learning."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model | None:
    """Fit on labelled rows that are not held out, at most ``bounds`` of them, chosen by a hash of their id."""
    judged = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in judged.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    usable = docs.select(col("doc_id"), text_bytes("text")).where(F.length("text").between(1, bounds.characters))
    texts = []
    for wanted, limit in ((1, bounds.toxic), (0, bounds.ordinary)):
        chosen = judged.where((F.col("toxic") > 0).cast("int") == wanted).select("doc_id")
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # so few ids that they can be broadcast
        rows = usable.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(limit).collect()
        texts.append([decoded(bytes(r["text"])) for r in rows])
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return train(texts[0], texts[1], share)


def score_column(model: Model | None, text_column: str = "text") -> Column:
    """The score of each text, as an expression."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([score(t, model) for t in each_text(texts)], pa.float64())

    return scores(text_bytes(text_column))


def classify(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every document."""
    model = fit(docs, labels, bounds)
    found = docs.select(
        col("doc_id"), F.coalesce(held_out(col("doc_id")), F.lit(False)).alias("held_out"), score_column(model).alias("score")
    )
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their columns as they are."""
    model = fit(docs, labels, bounds)
    (name,) = fresh(docs, "toxic_score")
    scored = docs.withColumn(name, score_column(model))
    return scored.where(F.col(name) < threshold).drop(name)

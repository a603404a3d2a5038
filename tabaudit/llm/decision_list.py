"""Quality rules: a decision list learnt by sequential covering, applied as a Spark expression.

From labelled statistics of documents, rules against bad ones are learnt one by one.  A rule is a conjunction
of thresholds on statistics.  It is *grown* on part of the sample, adding the threshold
with the largest information gain until it covers no good document (or nothing gains), then *pruned* on
the other part, dropping last conditions while that improves it.  A rule that is precise enough enters the list, the rows
that it covers leave the sample, and the next rule is learnt.  The list becomes one ordered
``CASE WHEN`` expression over columns, so it runs inside Spark and can be read by people.

Statistics are of whole texts; words are ``[^\\x20\\x09-\\x0D]+``.  Nulls and empty texts have no words and
fail the base rules.  Rules are learnt from at most ``max_rows`` labelled documents, chosen by a
hash of their ids; without labels of both kinds the list is empty and the base rules decide alone.
Repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.llm.frames import each_text, fresh, text_bytes

MAX_ROWS = 20_000
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = b"#*$%&|<>"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words",
)
_STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def _hashed_windows(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        found = np.zeros(len(ids) - REPEAT_WINDOW + 1, np.uint64)
        for i in range(REPEAT_WINDOW):
            found = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(found)]
    return found


def _exact_windows(ids: np.ndarray) -> np.ndarray:
    """Equal numbers for equal windows, by doubling: pairs of words, of pairs, of fours."""
    found, width = ids.astype(np.int64), 1
    while width < REPEAT_WINDOW:
        pairs = found[:-width] * (int(found.max()) + 1) + found[width:]
        found = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return found


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more in the text."""
    if len(words) <= REPEAT_WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    hashed = _hashed_windows(ids)
    if len(np.unique(hashed)) == len(hashed):
        return 0  # equal windows have equal hashes
    _, which, counts = np.unique(_exact_windows(ids), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """The ``COUNTS`` of one whole text."""
    raw = text.encode()
    words = raw.split()  # of bytes: at ASCII white space
    lines = [x for x in raw.split(b"\n") if x.split()]

    def without(characters: bytes) -> int:
        return len(raw) - len(raw.translate(None, characters))

    return (
        len(words),
        len(text) - without(b" \t\n\r\x0b\x0c"),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        without(b"0123456789"),
        without(b"!?"),
        len(set(words)),
    )


def statistics_column(text_column: str = "text") -> Column:
    @F.arrow_udf(_STRUCT)
    def counted(texts: pa.Array) -> pa.Array:
        rows = [statistics(t) for t in each_text(texts)]
        columns = zip(*rows) if rows else [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=list(COUNTS))

    return counted(text_bytes(text_column))


def measures(stats: Column) -> dict[str, Column]:
    """The statistics that rules may put thresholds on: counts and shares."""

    def share(part: str, whole: str) -> Column:
        return stats[part] / F.greatest(stats[whole], F.lit(1))

    return {
        "words": stats["n_words"].cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "symbols_per_char": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeat_words": share("n_repeat_words", "n_words"),
        "upper_per_char": share("n_upper", "word_chars"),
        "digits_per_char": share("n_digits", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.measure]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, named: dict[str, Column]) -> Column:
        value = named[self.measure]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """Documents for which all conditions hold are bad; ``precision`` is that on the pruning part."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(table) for c in self.conditions])

    def column(self, named: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [c.column(named) for c in self.conditions])


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    best, found = 1e-9, None
    p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
    for name, column in table.items():
        values, labels = column[inside], bad[inside]
        order = np.argsort(values, kind="stable")
        values, labels = values[order], labels[order]
        ends = np.flatnonzero(values[1:] != values[:-1])
        if not len(ends):
            continue
        p_low, n_low = np.cumsum(labels)[ends], np.cumsum(~labels)[ends]
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            gains = _gain(p.astype(float), n.astype(float), p0, n0)
            at = int(np.argmax(gains))
            if gains[at] > best:
                middle = float((values[ends[at]] + values[ends[at] + 1]) / 2)
                best, found = float(gains[at]), Condition(name, above, middle)
    return best, found


def _quality(conditions: list[Condition], table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    covered = Rule(tuple(conditions), 0, 0).holds(table)
    p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(
    table: dict[str, np.ndarray],
    bad: np.ndarray,
    max_rules: int = 16,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_covered: int = 5,
) -> list[Rule]:
    """Sequential covering; rows must be in random order, every third one prunes."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    prunes = np.arange(len(bad)) % 3 == 0
    while len(rules) < max_rules and bad[left & ~prunes].any() and bad[left & prunes].any():
        grow, prune = left & ~prunes, left & prunes
        conditions: list[Condition] = []
        inside = grow.copy()
        while len(conditions) < max_conditions and (~bad[inside]).any():
            _, condition = _best_condition(table, bad, inside)
            if condition is None:
                break
            conditions.append(condition)
            inside &= condition.holds(table)
        if not conditions:
            break
        held = {k: v[prune] for k, v in table.items()}
        tried = [(*_quality(conditions[:k], held, bad[prune]), k) for k in range(1, len(conditions) + 1)]
        _, p, n, k = max(tried, key=lambda t: (t[0], t[1], -t[3]))
        rule = Rule(tuple(conditions[:k]), p / max(1, p + n), p + n)
        covered = rule.holds(table) & left
        if rule.precision < min_precision or int((covered & bad).sum()) < min_covered:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def kept_by(rules: list[Rule], stats: Column) -> Column:
    """The list as one ordered expression: the first rule that holds decides, and no rule keeps."""
    named = measures(stats)
    verdict = None
    for rule in rules:
        verdict = (F if verdict is None else verdict).when(rule.column(named), F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Learn from labelled documents that pass the base rules (``quality`` 0 is bad)."""
    judged = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # so few rows that they can be broadcast
    # Written, as the filter on statistics would otherwise move below the join and measure every document.
    sample = materialize(docs.select(col("doc_id"), col("text")).join(F.broadcast(chosen), "doc_id"), "quality-sample")
    sample = sample.withColumn("stats", statistics_column())
    named = measures(F.col("stats"))
    values = sample.where(~base_failed(F.col("stats"))).select("doc_id", "quality", *[c.alias(k) for k, c in named.items()])
    rows = values.orderBy(F.xxhash64("doc_id"), *named).limit(max_rows).toPandas()
    return learn({k: rows[k].to_numpy(float) for k in named}, rows["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` of every document."""
    rules = fit(docs, labels, max_rows)
    rows = docs.select(col("doc_id"), statistics_column().alias("stats"))
    stats = F.col("stats")
    failed = base_failed(stats)
    return rows.select(
        "doc_id", *[stats[c].alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & kept_by(rules, stats)).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that the rules keep, with their columns as they are."""
    rules = fit(docs, labels, max_rows)
    (name,) = fresh(docs, "quality_stats")
    rows = docs.withColumn(name, statistics_column())
    return rows.where(~base_failed(F.col(name)) & kept_by(rules, F.col(name))).drop(name)

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.llm import decision_list
from tests.llm.cases import documents, labels, prose, texts


def brute(text: str) -> tuple[int, int, int, int, int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_brute_force():
    draw = random.Random(6)
    for _ in range(400):
        parts = draw.choices(["a", "bb", "é#", "<x>", "\n", "\n", " ", "\t", "\x1c", "漢"], k=draw.randint(0, 60))
        text = draw.choice([" ", ""]).join(parts)
        assert decision_list.statistics(text)[:5] == brute(text), text
    for text in ["a " * 40, "a b " * 30 + "c", "\n".join(["same line"] * 5 + ["", " "])]:
        assert decision_list.statistics(text)[:5] == brute(text)


def test_learns_planted_rules():
    draw = np.random.default_rng(1)
    n = 3000
    table = {"a": draw.random(n), "b": draw.random(n), "c": draw.random(n)}
    bad = (table["a"] > 0.8) & (table["b"] <= 0.5) | (table["c"] < 0.05)
    rules = decision_list.learn(table, bad)
    found = np.logical_or.reduce([r.holds(table) for r in rules])
    assert 2 <= len(rules) <= 6 and (found == bad).mean() > 0.98
    assert all(1 <= len(r.conditions) <= 4 and r.precision >= 0.9 for r in rules)


def test_noise_teaches_nothing():
    draw = np.random.default_rng(2)
    assert decision_list.learn({"a": draw.random(2000)}, draw.random(2000) < 0.1) == []
    assert decision_list.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def junk(seed: int) -> str:
    return " ".join(w + "###" for w in prose(seed, 60).split())


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 60)) for i in range(200, 400)] + texts()
    judged = [(i, int(i % 4 != 0), 0) for i in range(200, 400)] + [(4, None, None), (None, 0, 0)]
    return documents(spark, rows), labels(spark, judged), rows


def test_table(labelled):
    docs, judged, rows = labelled
    found = decision_list.judge(docs, judged).collect()
    assert len(found) == len(rows)
    wanted = sorted((repr(i), *brute(t or "")) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == wanted
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] and r["doc_id"] >= 200:
            assert r["kept"] == (r["doc_id"] % 4 != 0)
    kept = decision_list.keep_good(docs, judged)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in found if r["kept"])


def test_rules_are_spark_expressions(labelled):
    docs, judged, _ = labelled
    rules = decision_list.fit(docs, judged)
    assert rules and "CASE WHEN" in str(decision_list.kept_by(rules, F.col("stats")))


def test_only_the_sample_is_measured_for_the_rules(spark, monkeypatch):
    """No Python node reads all documents to learn from a few."""
    written = []
    plain = decision_list.materialize
    monkeypatch.setattr(decision_list, "materialize", lambda df, label: written.append((label, df)) or plain(df, label))
    docs = documents(spark, [(i, prose(i, 40)) for i in range(60)])
    decision_list.fit(docs, labels(spark, [(i, i % 2, 0) for i in range(20)]))
    assert [label for label, _ in written] == ["quality-sample"]
    plan = written[0][1]._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and written[0][1].count() == 20


def test_without_labels(spark):
    found = decision_list.judge(documents(spark), labels(spark, [])).collect()
    assert len(found) == 15 and all(r["kept"] == (not r["base_failed"]) for r in found)
    assert decision_list.judge(documents(spark, []), labels(spark, [])).count() == 0

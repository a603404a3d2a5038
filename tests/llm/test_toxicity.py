from __future__ import annotations

import zlib

import pytest

from tabaudit.llm import toxicity
from tests.llm.cases import documents, labels, prose

INSULTS = ["blockhead", "nincompoop", "scoundrel", "numbskull"]


def toxic(seed: int) -> str:
    words = prose(seed, 60).split()
    for k in range(5):
        words[(seed * 7 + k * 11) % 60] = INSULTS[(seed + k) % len(INSULTS)]
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    return toxicity.train([toxic(i) for i in range(90)], [prose(1000 + i, 60) for i in range(200)], 0.3)


def test_separates_unseen_texts(model):
    bad = [toxicity.score(toxic(500 + i), model) for i in range(40)]
    good = [toxicity.score(prose(5000 + i, 60), model) for i in range(40)]
    assert sum(s >= toxicity.THRESHOLD for s in bad) >= 36 and sum(s >= toxicity.THRESHOLD for s in good) <= 2
    # whole texts are read: the words may come at the very end
    assert toxicity.score(prose(1, 3000) + " " + toxic(77), model) > toxicity.score(prose(1, 3000), model)


def test_windows_cover_all_words():
    text = prose(3, 101)
    assert b" ".join(w.strip() for w in toxicity.windows(text)) == text.encode()
    assert toxicity.windows(" \n") == []


def test_nothing_to_learn(spark):
    assert toxicity.train([], ["a"] * 10, 0.5) is None
    found = toxicity.classify(documents(spark), labels(spark, [(4, 1, 0)])).collect()
    assert len(found) == 15 and all(r["score"] == 0.0 and r["predicted"] == 0 for r in found)
    assert toxicity.classify(documents(spark, []), labels(spark, [])).count() == 0


def test_table(spark):
    rows = [(i, toxic(i) if i % 3 == 0 else prose(9000 + i, 60)) for i in range(300)] + [(900, None), (901, ""), (902, prose(1, 20_000)), (None, "x")]
    judged = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(5, 1, None), (None, 1, 1)])
    docs = documents(spark, rows)
    found = {r["doc_id"]: r for r in toxicity.classify(docs, judged).collect()}
    assert len(found) == len(rows)
    for i in range(300):
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [r for i, r in found.items() if r["held_out"] and i < 300]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    assert found[900]["score"] == found[901]["score"]
    kept = toxicity.keep_clean(docs, judged)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}


def test_held_out_labels_do_not_matter(spark):
    rows = [(i, toxic(i) if i % 3 == 0 else prose(9000 + i, 60)) for i in range(200)]
    docs = documents(spark, rows)
    right = [(i, 1, int(i % 3 == 0)) for i in range(200)]
    turned = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in right]
    a, b = (sorted(map(tuple, toxicity.classify(docs, labels(spark, x)).collect())) for x in (right, turned))
    assert a == b

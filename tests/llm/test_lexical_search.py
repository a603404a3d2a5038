from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabaudit.llm import lexical_search
from tabaudit.llm.lexical_search import PostingList, Shard, build_index, encode_shard, query_terms, search
from tests.llm.cases import documents, prose, texts

LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, top=10):
    found = [(i, Counter(terms(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in found]
    n_docs, all_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    result = []
    for item, text in items:
        wanted = Counter(terms(text))
        ranked = []
        for (doc, counts), size in zip(found, sizes):
            m = 25 + (75 * size * n_docs) // max(all_terms, 1)
            score = 0
            for t, times in wanted.items():
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc or 0))
        result += [(item, k, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(result, key=repr)


def result(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


def corpus(seed, count, vocabulary=60, long=80):
    """Texts of few words, some of them rare, with many equal scores."""
    draw = random.Random(seed)
    names = ["".join(draw.choice("abcdeé漢1") for _ in range(draw.randint(1, 4))) for _ in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    marks = [" ", ", ", "-", "_", "\n", " # "]
    return [(i, draw.choice(marks).join(draw.choices(names, weights, k=draw.randint(0, long))).title()) for i in range(count)]


@pytest.mark.parametrize("shard_bytes", [12 << 20, 3000])
def test_equals_brute_force(spark, shard_bytes):
    rows = corpus(1, 400) + [(i + 1000 if i else i, t) for i, t in texts()] + corpus(1, 30)
    items = [(i, t) for i, t in corpus(2, 25)] + [(30, None), (31, ""), (32, "zzz"), (None, "a b c"), (33, prose(1, 120)), (33, "a"), (33, "a")]
    queries = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int")
    index = build_index(documents(spark, rows), shard_bytes)
    wanted = brute(rows, items)
    assert result(search(index, queries)) == wanted and len(wanted) > 200
    assert result(search(index, queries, lot_bytes=2500)) == wanted
    assert result(search(index, queries, top=3)) == brute(rows, items, 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(build_index(documents(spark, [])), some).count() == 0
    assert search(build_index(documents(spark)), none).count() == 0
    assert search(build_index(documents(spark, [(1, None), (2, " ")])), some).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost():
    """Frequent terms of a rare query are non-essential: most of their blocks stay compressed."""
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choices(["the", "of", "and", "to"], k=30))) for i in range(6000)]
    for i in draw.sample(range(6000), 25):
        rows[i] = (i, rows[i][1] + " needle hay")
    rows[3000] = (3000, "the " * 400)  # an escaped frequency
    batch = encode_shard(0, [i for i, _ in rows], [t.encode() for _, t in rows]).to_pylist()
    scale = (batch[0]["n_docs"], batch[0]["n_terms"])
    assert scale == (6000, sum(len(terms(t)) for _, t in rows))
    df = {r["term"]: r["df"] for r in batch[1:]}
    assert df == {k.encode(): v for k, v in Counter(t for _, x in rows for t in set(terms(x))).items()}

    def lists(shard, text):
        weight = {t: math.floor(1000 * math.log((2 * scale[0] + 2) / (2 * n + 1))) for t, n in df.items()}
        by_term = {r["term"]: r for r in batch[1:]}
        return [
            (PostingList(r["df"], r["blocks"], r["payload"], weight[t], shard.norms, scale), times)
            for t, times in query_terms(text).items()
            for r in [by_term[t]]
        ]

    for text in ("the needle of hay", "the the of", "and to the of", "needle"):
        shard = Shard.from_header(batch[0]["payload"], scale)
        places, scores = shard.best(lists(shard, text), 10)
        found = [(0, k, int(shard.ids[p]), int(s)) for k, (p, s) in enumerate(zip(places, scores), 1)]
        assert sorted(found, key=repr) == brute(rows, [(0, text)])
        if "needle hay" in text or "hay" in text:
            assert shard.work.essential <= 2 < shard.work.lists
            assert shard.work.decoded < shard.work.blocks


def test_bounds_hold():
    """No document scores more than the bound of its block."""
    rows = corpus(9, 900, vocabulary=30)
    batch = encode_shard(0, [i for i, _ in rows], [t.encode() for _, t in rows]).to_pylist()
    scale = (batch[0]["n_docs"], batch[0]["n_terms"])
    shard = Shard.from_header(batch[0]["payload"], scale)
    for r in batch[1:]:
        postings = PostingList(r["df"], r["blocks"], r["payload"], 7, shard.norms, scale)
        for i in range(len(postings.blocks)):
            place, part = postings.decode(np.array([i]))
            assert part.max() <= postings.bounds[i] <= postings.bound
            assert (place // lexical_search.BLOCK == postings.blocks[i]).all()

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tabaudit.llm import signature_join as join
from tabaudit.llm.components import connected_components
from tests.llm.cases import documents, prose, texts


def sets_of(text: str | None, width: int) -> set:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows: list[tuple], width: int, percent: int) -> dict:
    sets = [(i, sets_of(t, width)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed: int, families: int, members: int) -> list[tuple[int, str]]:
    """Families whose members drift away from each other, with passages that families share."""
    draw = random.Random(seed)
    passage = prose(seed + 10_000, 25)
    rows = []
    for family in range(families):
        words = prose(seed + family, draw.choice([6, 30, 80, 200])).split()
        if draw.random() < 0.5:
            words += passage.split()
        for _ in range(draw.randint(1, members)):
            words = list(words)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                at = draw.randrange(len(words))
                words[at : at + 1] = draw.choice([[], [words[at], "new"], [f"w{draw.randrange(10**6)}"]])
                words = words or ["x"]
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    return rows


def test_shingles():
    assert len(join.shingles("")) == len(join.shingles(" \n")) == 0
    assert len(join.shingles("a b c")) == 1 and len(join.shingles("a b a b a b a b", 4)) == 2
    assert np.array_equal(join.shingles("A B\tC D e"), join.shingles("a b c\nd e"))
    for text in [prose(1, 300), "x " * 1000, "é É Ab ab\x1cc d e f"]:
        assert len(join.shingles(text)) == len(sets_of(text, 4))


def test_key_counts_are_safe():
    """Linked sets always share the needed keys: checked on random pairs at the threshold."""
    draw = np.random.default_rng(4)
    for _ in range(3000):
        n = int(draw.integers(1, 120))
        universe = draw.choice(10_000, 2 * n + 2, replace=False).astype(np.uint64)
        drop, add = (int(draw.integers(0, n // 6 + 2)) for _ in range(2))
        a, b = np.sort(universe[:n]), np.sort(universe[min(drop, n - 1) : n + add])
        if join.links(a, b, 85):
            keys = [s[: join.n_keys(len(s), 85, 10)] for s in (a, b)]
            common = len(np.intersect1d(*keys))
            assert common >= max(join.needed_keys(len(a), 85, 10), join.needed_keys(len(b), 85, 10))


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_brute_force(seed):
    rows = near_copies(seed, 25, 12)
    sets = [join.shingles(t) for _, t in rows]
    tree = join.SignatureTree(sets, [1] * len(sets), 85)
    forest = tree.join()
    wanted = brute(rows, 4, 85)
    groups: dict[int, set] = {}
    for k in range(len(sets)):
        groups.setdefault(forest.find(k), set()).add(rows[tree.order[k]][0])
    found = {i: min(g) for g in groups.values() for i in g}
    assert found == {i: c for i, (_, c) in wanted.items()}


def collected(frame) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def test_table(spark):
    rows = texts()
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    found = join.jaccard_components(documents(spark, texts()))
    assert found.count() == len(texts())
    by_id = collected(found.where("doc_id is not null"))
    assert by_id == brute(rows, 4, 85)
    assert {tuple(r) for r in found.where("doc_id is null").collect()} == {(None, 39, None), (None, 0, None)}


@pytest.mark.parametrize(("width", "percent", "unit"), [(4, 85, 8192), (5, 80, 16)])
def test_near_copies(spark, width, percent, unit):
    """Small units make clusters that are cut into blocks."""
    rows = near_copies(50, 25, 60)
    found = join.jaccard_components(documents(spark, rows), width, percent, unit=unit)
    assert collected(found) == brute(rows, width, percent)


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, texts())
    kept = join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [1, 2, 3, 4, 7, 8, 10, 11, 12, None, None]))
    assert join.keep_one(documents(spark, [])).count() == 0
    assert join.jaccard_components(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 4000)]
    edges = spark.createDataFrame(chain, "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1300)}, 4000: 4000, 5000: 4000}


def repeated_ids() -> list[tuple[int | None, str | None]]:
    """Ids with several texts, also empty ones and copies of other documents, and copies without id."""
    a, b, c, d = (prose(k, 60) for k in range(900, 904))
    return [
        (1, a), (2, a + " tail"), (2, b), (3, b + " end"), (4, None), (4, c), (5, c + " more"), (5, ""), (6, d), (6, d),
        (7, prose(905, 50)), (7, None), (None, d + " x"), *[(None, prose(906, 60) + t) for t in ("", "", " y")],
    ]


def test_components_of_repeated_ids(spark):
    rows = repeated_ids()
    found = join.jaccard_components(documents(spark, rows)).where("doc_id is not null").collect()
    wanted = {i: c for i, (_, c) in brute(rows, 4, 85).items()}
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(
        (i, len(sets_of(t, 4)), wanted[i]) for i, t in rows if i is not None
    )
    assert wanted[2] == wanted[3] == 1


def test_rows_of_repeated_ids_stay_by_their_texts(spark):
    rows = repeated_ids()
    kept = [(r["doc_id"], r["text"]) for r in join.keep_one(documents(spark, rows)).collect()]
    a, b, c, d = (prose(k, 60) for k in range(900, 904))
    wanted = [(1, a), (2, b), (4, None), (4, c), (5, ""), (6, d), (7, prose(905, 50)), (7, None)]
    assert sorted((k for k in kept if k[0] is not None), key=repr) == sorted(wanted, key=repr)
    (nameless,) = [t for i, t in kept if i is None]
    assert nameless.startswith(prose(906, 60))

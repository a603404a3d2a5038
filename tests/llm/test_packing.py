from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabaudit.functions.storage import materialize
from tabaudit.llm import packing
from tabaudit.llm.tokens import vocabulary
from tests.llm.cases import documents, texts

PATH = vocabulary("word_bpe_49k.json")


def fewest(lengths: list[int], capacity: int) -> int:
    """The optimum, by trying all placements."""
    best = len(lengths)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for room in set(bins):
            if room >= lengths[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*bins, capacity - lengths[i]])

    lengths.sort(reverse=True)
    place(0, [])
    return best


def check(histogram: dict[int, int], capacity: int) -> packing.Plan:
    plan = packing.Plan(histogram, capacity)
    placed, filled = Counter(), defaultdict(list)
    for run in plan.runs:
        assert run.first == placed[run.length] and run.n % run.per_bin == 0
        placed[run.length] += run.n
        for k in range(run.n // run.per_bin):
            filled[run.sequence + k].append((run.offset, run.per_bin * run.length))
    assert placed == Counter({k: n for k, n in histogram.items() if n})
    assert sorted(filled) == list(range(plan.sequences))
    for spans in filled.values():
        end = 0
        for offset, size in sorted(spans):
            assert offset == end
            end += size
        assert end <= capacity
    return plan


def test_plans_are_valid_and_near_the_optimum():
    draw = random.Random(2)
    for _ in range(150):
        capacity = draw.choice([10, 17, 30])
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 9))]
        plan = check(Counter(lengths), capacity)
        best = fewest(lengths, capacity)
        assert packing.bound(Counter(lengths), capacity) <= best <= plan.sequences <= best + 1


def test_reduction_never_costs_a_sequence():
    draw = random.Random(3)
    for _ in range(150):
        lengths = [draw.randint(1, 20) for _ in range(draw.randint(1, 8))]
        plan = packing.Plan.__new__(packing.Plan)
        plan.capacity, plan.left = 20, {k: n for k, n in sorted(Counter(lengths).items(), reverse=True)}
        plan.used, plan.runs, plan.sequences = Counter(), [], 0
        plan._reduce()
        rest = [k for k, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + (fewest(rest, 20) if rest else 0) == fewest(lengths, 20)


def test_large_counts():
    draw = random.Random(4)
    histogram = {k: draw.randint(1, 10**9) for k in range(1, 2049)}
    plan = packing.Plan(histogram, 2048)
    assert plan.sequences <= 1.01 * packing.bound(histogram, 2048) and len(plan.runs) < 20_000
    assert plan.fixed > 0
    with pytest.raises(ValueError):
        packing.Plan({2049: 1}, 2048)


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    capacity = 100
    wanted = Counter()
    for doc_id, text in texts():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted[doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack(materialize(packing.pieces(documents(spark), PATH, capacity, with_ids=True), "pieces"), capacity)
    found = rows.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    filled = defaultdict(list)
    for r in found:
        filled[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for spans in filled.values():
        end = 0
        for offset, size, ids in sorted(spans):
            assert offset == end and len(ids) == 4 * size
            end += size
        assert end <= capacity
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(rows).collect()}
    assert joined == {k: b"".join(ids for _, _, ids in sorted(v)) for k, v in filled.items()}


def test_no_documents(spark):
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0

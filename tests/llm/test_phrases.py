from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabaudit.llm import phrases
from tabaudit.llm.words import byte_classes, joined, word_hashes, word_spans
from tests.llm.cases import prose, texts

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, n long, score double, phrase string, rank int, hash string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 3, 0.5, "x", 1, "y") for i, t, lang in rows], SCHEMA).repartition(3)


def brute(rows, min_count, top, absorb=80):
    """All counts in dictionaries, straight from the definition."""
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        ranked = []
        for p, a in wanted.items():
            longer = [n for q, n in wanted.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= absorb * a for n in longer):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(found)


def result(frame):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect())


def corpus(seed, documents):
    draw = random.Random(seed)
    names = ["aa", "Ab", "é", "the", "of", "漢字", "x-y", "\x1c", "zz"]
    rows = []
    for i in range(documents):
        words = [draw.choice(names) + draw.choice(["", "", "", ".", ",", "\n", "!", "\t", "\r"]) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.4:
            words += ["New", "York", "stock", "exchange"] * draw.randint(1, 3)
        rows.append((i, draw.choice([" ", "  ", "\t"]).join(words), draw.choice(["en", "en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("tries", [400_000, 40])
def test_equals_brute_force(spark, tries):
    rows = corpus(1, 300) + [(i, t, "en") for i, t in texts()] + [(None, None, None), (7, prose(2, 3000), "fr")]
    found = phrases.collocations(table(spark, rows), min_count=8, top=25, trie_phrases=tries, bits=20)
    wanted = brute(rows, 8, 25)
    assert result(found) == wanted and len(wanted) > 60


def test_a_bitmap_full_of_false_hits_changes_nothing(spark):
    rows = corpus(5, 120)
    assert result(phrases.collocations(table(spark, rows), min_count=5, top=40, bits=15)) == brute(rows, 5, 40)


def test_texts_are_read_as_often_for_many_tries_as_for_one(spark):
    """Each place of a text meets only the tries of its first pair, so more tries don't cost more passes."""
    rows = corpus(6, 200)
    read = []
    for tries in (400_000, 10):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        docs = table(spark, rows).select("lang", "text")
        docs = docs.mapInArrow(counted, docs.schema)
        assert result(phrases.collocations(docs, min_count=5, top=40, trie_phrases=tries, bits=20)) == brute(rows, 5, 40)
        read.append(seen.value)
    assert read == [4 * len(rows)] * 2


def test_more_words_make_more_ranges(spark, monkeypatch):
    bits = phrases._range_bits(spark, 0)
    assert phrases._range_bits(spark, 4_000_000 << bits) == bits and phrases._range_bits(spark, 4_000_001 << bits) == bits + 1
    monkeypatch.setattr(phrases, "_RANGE_WORDS", 50)
    rows = corpus(8, 150)
    assert result(phrases.collocations(table(spark, rows), min_count=5, top=40, bits=20)) == brute(rows, 5, 40)


def drawn_windows(seed, number):
    """Columns of one to four words (0 after the end) and a count."""
    draw = random.Random(seed)
    rows = np.zeros((phrases.LONGEST + 1, number), np.uint64)
    for i in range(number):
        size = draw.randint(1, phrases.LONGEST)
        rows[:size, i] = [draw.randint(1, 4) << 60 for _ in range(size)]
        rows[phrases.LONGEST, i] = draw.choice([1, 2, 300])
    return rows


def as_counter(rows):
    found = Counter()
    for column in rows.T.tolist():
        found[tuple(column[: phrases.LONGEST])] += column[phrases.LONGEST]
    return found


@pytest.mark.parametrize("shared", [False, True])
def test_windows_are_summed_by_their_words(monkeypatch, shared):
    """Also when all hashes of two words are the same."""
    if shared:
        monkeypatch.setattr(phrases, "_pair_hashes", lambda first, second: np.full(len(first), 7, np.uint64))
    for number in (0, 1, 2000):
        rows = drawn_windows(number, number)
        found = phrases._summed_rows(rows)
        assert as_counter(found) == as_counter(rows) and found.shape[1] == len(as_counter(rows))


def test_packed_windows_are_the_same_windows():
    for number, most in ((1, 1), (500, 300), (500, 70_000), (500, 1 << 40)):
        rows = drawn_windows(number, number)
        rows[phrases.LONGEST, 0] = most
        rows = rows[:, np.argsort(-np.count_nonzero(rows[: phrases.LONGEST], axis=0), kind="stable")]
        assert (phrases._unpacked_windows(phrases._packed_windows(rows)) == rows).all()


def test_a_window_counts_as_often_as_it_occurs():
    """Beginnings of windows, counted by tries of several sizes, against a dictionary."""
    rows = phrases._summed_rows(drawn_windows(9, 3000))
    data = phrases._packed_windows(rows[:, np.argsort(-np.count_nonzero(rows[: phrases.LONGEST], axis=0), kind="stable")])
    wanted = Counter()
    for column in rows.T.tolist():
        for size in range(1, phrases.LONGEST + 1):
            if column[size - 1]:
                wanted[tuple(column[:size])] += column[phrases.LONGEST]
    for tries in (400_000, 7):
        counted = phrases._count_windows(900, tries)(pa.table([pa.array([3], pa.int32()), pa.array([data])], names=["range", "data"]))
        found = {tuple(h % (1 << 64) for h in (r["h1"], r["h2"], r["h3"], r["h4"])[: r["size"]]): r["n"] for r in counted.to_pylist()}
        assert found == {p: n for p, n in wanted.items() if len(p) == 1 or n >= 900} and len(found) > 20


def test_texts_in_parts(spark, monkeypatch):
    """Long texts are read in parts and no phrase is lost or made at a seam."""
    whole = " ".join(["a b c d."] * 4000)
    parts = list(phrases._parts(whole.encode() * 50))
    assert len(parts) > 1 and b"".join(parts) == whole.encode() * 50 and all(p.endswith(b".") for p in parts[:-1])
    assert list(phrases._parts(b"word " * 400_000)) == [b"word " * 400_000]  # one piece is not cut
    found = result(phrases.collocations(table(spark, [(1, whole, "en")]), min_count=30))
    assert found == brute([(1, whole, "en")], 30, 2000)


def test_nothing_to_find(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(1, None, "en"), (2, "", None), (3, "one two", "en")])).count() == 0


def test_double_array_equals_a_dictionary():
    draw = random.Random(3)
    for size in (1, 5, 300):
        words = np.array([draw.getrandbits(64) | 1 for _ in range(size)], np.uint64)
        stream = np.array([draw.choice(words) for _ in range(4000)] + [5, 6], np.uint64)
        linked = np.array([draw.random() < 0.9 for _ in range(len(stream))])
        linked[-1] = False
        candidates = {tuple([draw.choice(words)] + [draw.choice(words) for _ in range(draw.randint(0, 3))]) for _ in range(400)}
        rows = np.zeros((len(candidates), 4), np.uint64)
        for i, c in enumerate(sorted(candidates)):
            rows[i, : len(c)] = c
        trie, ends = phrases.DoubleArray.build(rows)
        assert len(set(ends)) == len(rows)
        trie = phrases.DoubleArray.from_bytes(trie.to_bytes())
        counts = np.zeros(len(trie.base), np.int64)
        trie.add_counts(counts, stream, linked)
        wanted = Counter()
        for i in range(len(stream)):
            for k in range(1, 5):
                if i + k <= len(stream) and linked[i : i + k - 1].all():
                    wanted[tuple(stream[i : i + k])] += 1
        assert [counts[e] for e in ends] == [wanted[c] for c in sorted(candidates)]


def test_word_hashes():
    classes = byte_classes(b" \t", b".\n")
    draw = random.Random(4)
    data = ["".join(draw.choice("ab é.\n\t") for _ in range(draw.randint(0, 50))).encode() for _ in range(200)] + [b"w" * 3_000_000]
    buffer, begins = joined(data)
    starts, ends = word_spans(buffer, classes)
    found = [bytes(buffer[a:b]) for a, b in zip(starts, ends)]
    assert found == re.findall(rb"[^ \t.\n]+", b"\n".join(data))
    assert [bytes(buffer[b : b + len(t)]) for b, t in zip(begins, data)] == data
    hashes = word_hashes(buffer, starts, ends)
    by_word = {w: h for w, h in zip(found, hashes)}
    assert all(by_word[w] == h for w, h in zip(found, hashes)) and len(set(by_word.values())) == len(by_word)
    assert (hashes[:50] != word_hashes(buffer, starts[:50], ends[:50], seed=1)).all()

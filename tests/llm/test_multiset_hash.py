from __future__ import annotations

import hashlib
from collections import Counter

from tabaudit.llm import multiset_hash
from tabaudit.llm.multiset_hash import Fingerprint, edited_text
from tests.llm.cases import documents, prose, texts


def test_sums_are_independent_of_order_and_reversible():
    a, b, c = "first paragraph", "second one", "first paragraph"
    assert Fingerprint.of("\n".join([a, b, c])) == Fingerprint.of("\n".join([b, c, a]))
    assert Fingerprint.of("\n".join([a, b])) != Fingerprint.of("\n".join([a, b, c]))
    assert Fingerprint.of(a).insert(b) == Fingerprint.of(f"{a}\n{b}")
    assert Fingerprint.of(f"{a}\n{b}").delete(b) == Fingerprint.of(a)
    found = Fingerprint.of(prose(1, 400))
    assert Fingerprint.from_text(found.to_text()) == found
    assert Fingerprint.of("") == Fingerprint()


def test_likeness():
    text, other = prose(1, 600), prose(2, 600)
    found = Fingerprint.of(text)
    assert found.likeness(Fingerprint.of(text)) == 1.0
    assert found.likeness(Fingerprint.of(other)) < 0.35
    assert 0.35 < found.likeness(Fingerprint.of(edited_text(text, other))) < 0.7
    assert found.likeness(Fingerprint.of(text + " more")) > 0.9
    assert found.likeness(Fingerprint()) == 0.0


def test_long_paragraphs_in_parts(monkeypatch):
    text = prose(3, 3000)
    whole = Fingerprint.of(text)
    monkeypatch.setattr(multiset_hash, "BLOCK", 100)
    assert Fingerprint.of(text) == whole


def expected(rows):
    """Descending ids, ties by text; the last one is followed by the first."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = Counter()
    for k, (doc_id, text) in enumerate(rows):
        following = rows[k - 1][1]
        edited = edited_text(text, following)
        a, b = Fingerprint.of(text), Fingerprint.of(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        near = a.likeness(b), a.likeness(Fingerprint.of(following))
        found[(doc_id, len(text), digest, a.to_text(), b.to_text(), *near)] += 1
    return found


def test_table(spark):
    assert Counter(tuple(r) for r in multiset_hash.compare_with_edit(documents(spark)).collect()) == expected(texts())
    many = [(i * 37 % 1009, prose(i, 12)) for i in range(500)]
    assert Counter(tuple(r) for r in multiset_hash.compare_with_edit(documents(spark, many)).collect()) == expected(many)


def test_one_and_none(spark):
    one = [(5, "alone here")]
    assert Counter(tuple(r) for r in multiset_hash.compare_with_edit(documents(spark, one)).collect()) == expected(one)
    assert multiset_hash.compare_with_edit(documents(spark, [])).count() == 0
    found = {r["doc_id"]: r["fingerprint"] for r in multiset_hash.fingerprints(documents(spark)).collect()}
    assert found[4] == found[5] != found[6]

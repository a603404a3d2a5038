from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabaudit.llm import warc

SCHEMA = "record_id long, url string, kind string, captured_at long, etag string, last_modified string, headers map<string,string>, payload string, cell int, status string"


def table(spark, rows):
    return spark.createDataFrame([(*r, f"body {r[0]}", 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("HTTP://Example.COM:80/A/?utm_source=x&b=1&ref=z#top", "example.com/A?b=1"),
        ("https://example.com", "example.com"),
        ("https://example.com/?fbclid=1", "example.com"),
        ("example.com/a//", "example.com/a"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, wanted):
    assert spark.range(1).select(warc.canonical_url(F.lit(url).cast("string"))).first()[0] == wanted


def test_merging_and_validators(spark):
    rows = [
        (1, "http://a/x", "response", 10, '"e1"', "d1", {"etag": '"e1"', "content-type": "text/html", "date": "1", "age": "5"}),
        (2, "http://a/x", "response", 20, '"e2"', "d2", {"content-type": "text/plain"}),
        (3, "https://A/x#f", "revisit", 15, 'W/"e1"', None, {"date": "9", "content-type": "message/http", "vary": "*"}),
        (4, "http://a/x", "revisit", 20, '"e2"', None, {}),
        (5, "http://a/x", "revisit", 30, None, "d2", None),
        (6, "http://a/x", "revisit", 30, None, None, None),
        (7, "http://a/x", "revisit", 10, '"e1"', None, None),
        (8, None, "revisit", 30, '"e1"', None, None),
        (9, "http://a/x", "revisit", None, '"e1"', None, None),
        (10, None, "response", 1, '"e1"', None, None),
        (11, "http://a/x", None, 40, None, None, None),
    ]
    found = {r["revisit_id"]: r for r in warc.resolve_revisits(table(spark, rows)).collect()}
    assert sorted(found) == [3, 4, 5, 6, 7, 8, 9]
    assert found[3]["status"] == warc.RESOLVED and found[3]["response_id"] == 1
    assert found[3]["headers"] == {"etag": '"e1"', "content-type": "text/html", "date": "9", "age": "5", "vary": "*"}
    assert found[4]["status"] == warc.MISMATCH and found[4]["response_id"] == 1
    assert found[5]["status"] == warc.RESOLVED and found[5]["response_id"] == 2 and found[5]["headers"] == {"content-type": "text/plain"}
    assert found[6]["status"] == warc.UNVERIFIED
    assert all(found[k]["status"] == warc.MISSING and found[k]["response_id"] is None for k in (7, 8, 9))
    bodies = warc.attach_payload(warc.resolve_revisits(table(spark, rows)), table(spark, rows), "payload")
    assert {r["revisit_id"]: r["payload"] for r in bodies.collect()} == {3: "body 1", 5: "body 2"}


def test_as_of_join_equals_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for k in range(900):
        url = "http://hot/" if draw.random() < 0.4 else f"http://h{draw.randint(0, 60)}/"
        kind = draw.choice(["response", "revisit", "revisit"])
        rows.append((k, url, kind, draw.randint(0, 300), None, None, None))
    found = {r["record_id"]: r["response_id"] for r in warc.latest_earlier(table(spark, rows)).collect()}
    responses = [r for r in rows if r[2] == "response"]
    for k, url, kind, at, *_ in rows:
        if kind == "revisit":
            assert found[k] == max(((r[3], r[0]) for r in responses if r[1] == url and r[3] < at), default=(0, None))[1]
    assert len(found) == sum(r[2] == "revisit" for r in rows)


def test_no_records(spark):
    assert warc.resolve_revisits(table(spark, [])).count() == 0
    only = [(1, "http://a/", "revisit", 5, None, None, None)]
    assert warc.resolve_revisits(table(spark, only)).first()["status"] == warc.MISSING


def test_null_and_repeated_ids(spark):
    one = (1, "http://a/x", "response", 10, '"e1"', None, {"vary": "a"})
    again = (2, "http://a/x", "revisit", 20, '"e1"', None, {"date": "2"})
    rows = [
        one, one, one, again, again,
        (None, "http://b/", "response", 10, '"b"', None, {"vary": "b"}),
        (None, "http://b/", "revisit", 20, '"b"', None, None),
        (None, "http://b/", "revisit", 30, '"z"', None, {"date": "3"}),
        (None, "http://c/", "revisit", 30, None, None, None),
        (None, None, "revisit", 30, None, None, None),
        (5, "http://d/", "response", 10, '"d"', None, None),
        (None, "http://d/", "response", 10, '"other"', None, None),
        (6, "http://d/", "revisit", 11, '"d"', None, None),
    ]
    resolved = warc.resolve_revisits(table(spark, rows))
    found = sorted(((r["canonical_url"], r["captured_at"], r["revisit_id"], r["response_id"], r["response_at"], r["status"], r["headers"]) for r in resolved.collect()), key=repr)
    wanted = [
        *[("a/x", 20, 2, 1, 10, warc.RESOLVED, {"vary": "a", "date": "2"})] * 2,
        ("b", 20, None, None, 10, warc.RESOLVED, {"vary": "b"}),
        ("b", 30, None, None, 10, warc.MISMATCH, {"date": "3"}),
        ("c", 30, None, None, None, warc.MISSING, None),
        (None, 30, None, None, None, warc.MISSING, None),
        ("d", 11, 6, 5, 10, warc.RESOLVED, {}),
    ]
    assert found == sorted(wanted, key=repr)
    bodies = warc.attach_payload(resolved, table(spark, rows), "payload").collect()
    assert sorted((r["canonical_url"], r["payload"]) for r in bodies) == [("a/x", "body 1")] * 2 + [("b", "body None"), ("d", "body 5")]

"""CSV files with quoted line breaks, read by many tasks."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from tabaudit.catalog import tables as catalog_tables
from tabaudit.sources import records
from tabaudit.sources.tables import read_table


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as out:
        csv.writer(out, lineterminator=end).writerows(rows)


def table(seed, count, long=200):
    """Fields with line breaks, quotes and commas, some of them longer than several ranges."""
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        marks = ["\n", '"', ",", "x", " ", "é", "\n\n", '""']
        text = "".join(draw.choice(marks) for _ in range(draw.choice([0, 3, 30, long])))
        if draw.random() < 0.01:
            text += "line\n" * 3000
        rows.append([str(i), "t" + text, f"{draw.random():.3f}", draw.choice(["", "2024-01-05"])])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_whole_reading(spark, tmp_path, small_ranges, seed):
    rows = table(seed, 600)
    write(tmp_path / "a.csv", [["id", "text", "x y", "day"], *rows])
    found = read_table(spark, str(tmp_path / "a.csv"), split=True)
    assert found.dtypes == [("id", "int"), ("text", "string"), ("x y", "double"), ("day", "date")]
    assert records._lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20
    got = sorted((r["id"], r["text"], f"{r['x y']:.3f}", "" if r["day"] is None else str(r["day"])) for r in found.collect())
    assert got == [(int(i), t, x, d) for i, t, x, d in rows]
    whole = read_table(spark, str(tmp_path / "a.csv"))
    assert whole.dtypes == found.dtypes and whole.exceptAll(found).count() == 0 == found.exceptAll(whole).count()
    declared = read_table(spark, str(tmp_path / "a.csv"), "id long, text string, x double, day string", split=True)
    assert declared.dtypes[0] == ("id", "bigint") and declared.agg(F.sum("id")).first()[0] == sum(range(600))


def test_several_files_and_line_ends(spark, tmp_path, small_ranges):
    (tmp_path / "t.csv").mkdir()
    rows = table(3, 300, long=40)
    write(tmp_path / "t.csv" / "1.csv", [["id", "text", "x", "day"], *rows[:100]], "\r\n")
    write(tmp_path / "t.csv" / "2.csv", [["id", "text", "x", "day"], *rows[100:]])
    write(tmp_path / "t.csv" / "3.csv", [["id", "text", "x", "day"]])
    got = {r["id"]: r["text"] for r in read_table(spark, str(tmp_path / "t.csv"), split=True).collect()}
    assert got == {int(r[0]): r[1] for r in rows}


def test_without_line_breaks_and_without_rows(spark, tmp_path):
    write(tmp_path / "p.csv", [["a", "b"], ["1", ""], ["2", "x"], ["", ""]])
    found = read_table(spark, str(tmp_path / "p.csv"), split=True)
    assert found.dtypes == [("a", "int"), ("b", "string")] and sorted(map(str, found.collect())) == sorted(map(str, read_table(spark, str(tmp_path / "p.csv")).collect()))
    write(tmp_path / "h.csv", [["a", "b"]])
    assert read_table(spark, str(tmp_path / "h.csv"), split=True).count() == 0
    (tmp_path / "e.csv").write_text("")
    assert read_table(spark, str(tmp_path / "e.csv"), split=True).count() == 0
    text = read_table(spark, str(tmp_path / "p.csv"), infer=False, split=True)
    assert {t for _, t in text.dtypes} == {"string"}


def test_no_task_writes_a_whole_table(spark, tmp_path, small_ranges, monkeypatch):
    """Files of the split reading grow in number with the table, and each is still cut by several tasks."""
    rows = spark.range(0, 400, 1, 10).select(
        F.col("id").alias("doc_id"), F.expr("repeat(sha2(cast(id as string), 256), 5)").alias("text"), F.lit("en").alias("lang"), F.lit(320).cast("long").alias("n_chars")
    )
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog_tables, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = catalog_tables.csv_split_roundtrip(spark, str(tmp_path))
    held = [p.read_text().count('say ""') for p in sorted((tmp_path / "csv.csv").glob("part-*"))]
    assert sum(held) == 400 and len(held) > 2 and max(held) < 200
    ranges = records._lines(spark, str(tmp_path / "csv.csv")).groupBy("file").agg(F.countDistinct("start").alias("n"))
    assert min(r["n"] for r in ranges.collect()) > 1
    wanted = rows.select("doc_id", F.md5(catalog_tables._wrapped("text")).alias("digest"), "lang", "n_chars")
    assert found.exceptAll(wanted).count() == 0 == wanted.exceptAll(found).count()

"""Dataset roles, cleaning rules and sources."""

from __future__ import annotations

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabaudit.catalog.fixtures import dirty_orders
from tabaudit.dataset import Dataset, from_rows, infer_target, split_target
from tabaudit.functions.storage import scratch_path
from tabaudit.operators import clean
from tabaudit.sources import runs, tables

SMALL = "/root/testdata/sf0.001"


def test_rows_source(spark):
    assert from_rows(spark, {"a": 1, "b": "x"}).collect() == [(1, "x")]
    many = from_rows(spark, [{"a": 1}, {"b": "y", "a": 2}])
    assert sorted(tuple(r) for r in many.collect()) == [(1, None), (2, "y")]
    assert from_rows(spark, many).count() == 2
    for wrong in (3, "text", None):
        with pytest.raises(ValueError):
            from_rows(spark, wrong)


def test_target_inference(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, label int, y int")
    assert infer_target(df) == "label"
    assert infer_target(df, "y") == "y"
    assert infer_target(df, "absent") == "label"
    assert infer_target(df, auto_detect=False) is None
    assert infer_target(df.select("a")) is None
    assert infer_target(spark.createDataFrame([(1,)], "LABEL int")) is None


def test_split_without_target(spark):
    data = split_target(spark.createDataFrame([(1, 2)], "a int, b int"), None)
    assert data.features == ("a", "b") and data.y is None


def test_keyed_dataset_has_unique_keys(spark):
    df = clean.dedupe(dirty_orders(spark, SMALL))
    keyed = Dataset(df, tuple(df.columns)).keyed()
    assert keyed.df.select(keyed.key).distinct().count() == df.count()


def test_nan_and_null_clean_alike(spark):
    with_null = clean.clean(dirty_orders(spark, SMALL), "fill")
    with_nan = clean.clean(dirty_orders(spark, SMALL, F.lit(float("nan"))), "fill")
    assert with_null.exceptAll(with_nan).count() == 0 and with_nan.exceptAll(with_null).count() == 0


def test_fill_types(spark):
    rows = [(1, None, None, None), (2, 1.0, "x", True), (None, 3.0, "x", False), (4, 5.0, "y", None)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean")
    filled = clean.fill_missing(df)
    assert dict(filled.dtypes) == {"i": "double", "d": "double", "s": "string", "b": "boolean"}
    assert sorted(filled.collect(), key=str)[0] == (1.0, 3.0, "Unknown", None)
    assert {r["i"] for r in filled.collect()} == {1.0, 2.0, 4.0}
    # Without nulls an integer column keeps its type; an all-null column stays null.
    same = clean.fill_missing(spark.createDataFrame([(1, None)], "i int, d double"))
    assert dict(same.dtypes)["i"] == "int" and same.first()["d"] is None


def test_strategies(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert clean.clean(df).count() == 2
    assert clean.clean(df, "drop").collect() == [(2, "x")]
    # Rows are compared and dropped on all columns, also on those dropped later.
    assert clean.clean(df, "drop", ["b"]).collect() == [(2,)]
    with pytest.raises(ValueError):
        clean.clean(df, "guess")


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 2), (3.0, 2)], "`a.b` double, `c d` int")
    assert clean.clean(df, "fill").select("`a.b`").distinct().count() == 3
    assert clean.duplicate_count(df).first()[0] == 0
    assert clean.null_counts(df).filter("column = 'a.b'").first()["n_nulls"] == 1


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    flagged = clean.outlier_flags(df).filter("x_outlier").collect()
    assert [r["x"] for r in flagged] == [1000.0]


def test_validation(spark):
    with pytest.raises(ValueError, match="9 rows are too few"):
        clean.validate(spark.range(9))
    clean.validate(spark.range(10))
    assert clean.validation_status(spark.range(3)).first()["ok"] is False


def test_csv_and_json_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "b.JSON").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    (tmp_path / "c.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    for name in ("a.csv", "b.JSON", "c.json"):
        read = tables.read_table(spark, str(tmp_path / name)).select("a", "b")
        assert sorted(tuple(r) for r in read.collect()) == [(1, "x"), (2, "y")]
    for name in ("x.parquet", "x.xlsx", "x"):
        with pytest.raises(ValueError, match="cannot"):
            tables.read_table(spark, name)
        with pytest.raises(ValueError, match="cannot"):
            tables.write_table(spark.range(1), name)


def test_csv_as_other_programs_write_it(spark, tmp_path):
    (tmp_path / "q.csv").write_text('name,note,n\nann,"say ""hi"", ok",1\nbob,"two\nlines \\ back",2\n" eve ",,3\n')
    wanted = [(" eve ", None, 3), ("ann", 'say "hi", ok', 1), ("bob", "two\nlines \\ back", 2)]
    read = tables.read_table(spark, str(tmp_path / "q.csv"))
    assert sorted(tuple(r) for r in read.collect()) == wanted
    tables.write_table(read, str(tmp_path / "again.csv"))
    assert sorted(tuple(r) for r in tables.read_table(spark, str(tmp_path / "again.csv")).collect()) == wanted
    (tmp_path / "plain.csv").write_text("a,b\n1,x y\n2,z\n")
    assert tables.read_table(spark, str(tmp_path / "plain.csv"), line_per_row=True).count() == 2


def test_json_keeps_the_order_of_records(spark, tmp_path):
    lines = '{"y": 1, "b": {"k": [1, 2]}, "a": "}"}\n{"c": 5, "y": 2, "b": null, "a": null}\n'
    (tmp_path / "l.json").write_text("\n" + lines)
    (tmp_path / "m.json").write_text('[\n' + '{"y": 1,' + "\n" * 40 + '"label": "x", "a": 2},\n{"y": 2, "label": "z", "a": 3}\n]')
    (tmp_path / "e.json").write_text("")
    assert tables.read_table(spark, str(tmp_path / "l.json")).columns == ["y", "b", "a", "c"]
    assert tables.read_table(spark, str(tmp_path / "m.json")).columns == ["y", "label", "a"]
    assert tables.read_table(spark, str(tmp_path / "e.json")).columns == []


def test_rows_of_mixed_numbers_and_without_values(spark):
    df = from_rows(spark, [{"a": 1, "b": None}, {"a": 2.5, "b": None, "c": True}, {}])
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "boolean")]
    assert [tuple(r) for r in df.collect()] == [(1.0, None, None), (2.5, None, True), (None, None, None)]
    with pytest.raises(ValueError, match="must be"):
        from_rows(spark, 7)


def test_inventory_is_flat_and_ignores_case(spark, tmp_path):
    for name in ("b.csv", "a.CSV", "c.yaml", "d.txt", ".csv"):
        (tmp_path / name).write_text("x\n1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.csv").write_text("x\n1\n")
    names = [r["name"] for r in tables.list_inputs(spark, str(tmp_path), [".csv"]).orderBy("path").collect()]
    assert names == ["a.CSV", "b.csv"]
    assert tables.pick_input(spark, str(tmp_path), [".csv"]).endswith("/a.CSV")
    assert tables.pick_input(spark, str(tmp_path), [".json"]) is None


@pytest.mark.parametrize("compress", [False, True])
def test_archive_keeps_text(spark, tmp_path, compress):
    (tmp_path / "in.csv").write_text('code,n\n007,1\n008,\n"a\nb",2\n')
    copy = tables.archive(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), compress, datetime(2024, 5, 6, 7, 8, 9))
    assert copy.endswith("/20240506_070809_in.csv")
    rows = tables.read_table(spark, copy, infer=False).collect()
    assert sorted(tuple(r) for r in rows) == [("007", "1"), ("008", None), ("a\nb", "2")]
    (file,) = (tmp_path / "out" / "20240506_070809_in.csv").iterdir()
    data = gzip.decompress(file.read_bytes()) if compress else file.read_bytes()
    assert data == (tmp_path / "in.csv").read_bytes() and (file.suffix == ".gz") == compress


@pytest.mark.parametrize("compress", [False, True])
def test_archive_keeps_partitions(spark, tmp_path, compress):
    """Files of one task have one name in every folder of a partitioned table."""
    values = ["a", "b", "c:d 100%", None]
    wanted = [(n, values[n % 4]) for n in range(40)]
    rows = spark.createDataFrame(wanted, "n int, k string").coalesce(1)
    rows.write.partitionBy("k").option("header", True).csv(str(tmp_path / "in.csv"))
    copy = tables.archive(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), compress, datetime(2024, 5, 6, 7, 8, 9))
    found = [(r["n"], r["k"]) for r in tables.read_table(spark, copy).collect()]
    assert sorted(found) == sorted(wanted)
    names = {p.relative_to(copy).as_posix() for p in (tmp_path / "out").rglob("*.csv*") if p.is_file() and p.name[0] != "."}
    source = tmp_path / "in.csv"
    assert names == {p.relative_to(source).as_posix() + ".gz" * compress for p in source.rglob("part*")}


def test_run_index(spark):
    path = scratch_path(spark, "runs")
    assert runs.load_runs(spark, path).count() == 0
    runs.append_run(spark, path, "p", "b", datetime(2024, 1, 2), ["x"])
    runs.append_run(spark, path, "p", "a", datetime(2024, 1, 1), ["y", "z"])
    runs.append_run(spark, path, "q", "c", datetime(2024, 1, 3), [])
    assert [r["run_id"] for r in runs.load_runs(spark, path).collect()] == ["a", "b", "c"]
    assert [r["run_id"] for r in runs.load_runs(spark, path, "q").collect()] == ["c"]

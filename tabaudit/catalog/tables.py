"""Queries of sources and sinks; the files they read are written from the driver tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.catalog import query
from tabaudit.catalog.audit import _SUMMARY_SQL
from tabaudit.catalog.fixtures import audit_lineitem, rounded, table
from tabaudit.dataset import from_rows, infer_target
from tabaudit.functions.storage import scratch_path
from tabaudit.operators import audit
from tabaudit.sources import runs, tables

NOON = datetime(2024, 1, 1, 12, 0, 0)
LATER = datetime(2024, 1, 2, 12, 0, 0)


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(spark, 'csv')}.csv"
    tables.write_table(table(spark, sf_dir, "customer"), path)
    read = tables.read_table(spark, path)
    return read.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(spark, 'json')}.json"
    part = table(spark, sf_dir, "part")
    tables.write_table(part, path)
    read = tables.read_table(spark, path)
    return read.select(*part.columns).withColumn("p_size", F.col("p_size").cast("int"))


# Texts as files hold them: quotes, separators, backslashes and line breaks in every row.
_WRAP_SQL = """'say "' || text || '", \\ ' || chr(10) || ' "" end '"""


def _wrapped(name: str) -> Column:
    return F.concat(F.lit('say "'), F.col(name), F.lit('", \\ \n "" end '))


@query(f"select doc_id, md5({_WRAP_SQL}) as digest, lang, n_chars from documents")
def csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(spark, 'csv')}.csv"
    rows = table(spark, sf_dir, "documents").select("doc_id", _wrapped("text").alias("text"), "lang", "n_chars")
    tables.write_table(rows, path)
    read = tables.read_table(spark, path, "doc_id long, text string, lang string, n_chars long")
    return read.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


# Scan tasks whose rows go to one file: a bounded part of any table, and more than one range of the file.
SCANS_A_FILE = 2


@query(f"select doc_id, md5({_WRAP_SQL}) as digest, lang, n_chars from documents")
def csv_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in fewer files, each cut into records by several tasks, types found without a schema."""
    path = f"{scratch_path(spark, 'csv')}.csv"
    rows = table(spark, sf_dir, "documents").select("doc_id", _wrapped("text").alias("text"), "lang", "n_chars")
    tables.write_table(rows.coalesce(max(rows.rdd.getNumPartitions() // SCANS_A_FILE, 1)), path)
    read = tables.read_table(spark, path, split=True)
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "lang", F.col("n_chars").cast("long").alias("n_chars"))


@query(f"select conv_id, turn, role, md5({_WRAP_SQL}) as digest, 'y' as target from conversations")
def json_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records begin with ``y``, which is the target although ``label`` sorts first."""
    path = f"{scratch_path(spark, 'json')}.json"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("y"), _wrapped("text").alias("text"), F.col("role").alias("label"), "conv_id"
    )
    tables.write_table(rows, path)
    read = tables.read_table(spark, path)
    return read.select(
        "conv_id", F.col("y").alias("turn"), F.col("label").alias("role"), F.md5("text").alias("digest"),
        F.lit(infer_target(read)).alias("target"),
    )


@query(f"select conv_id, turn, md5({_WRAP_SQL}) as digest from conversations")
def archive_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed copy of a table with line breaks in its fields reads like its source."""
    folder = scratch_path(spark, "archive")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _wrapped("text").alias("text"))
    tables.write_table(rows, f"{folder}/in/talk.csv")
    copy = tables.archive(spark, f"{folder}/in/talk.csv", f"{folder}/out", compress=True, now=NOON)
    read = tables.read_table(spark, copy, "conv_id long, turn long, text string")
    return read.select("conv_id", "turn", F.md5("text").alias("digest"))


@query(
    """
    select meaning, count(*) as n from lineitem
    join (values ('A', 'accepted'), ('N', 'not returned'), ('R', 'returned')) m(flag, meaning)
      on l_returnflag = flag
    group by meaning
    """
)
def rows_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal code table, given as records, names the flags of all line items."""
    meanings = [
        {"flag": "A", "meaning": "accepted"},
        {"flag": "N", "meaning": "not returned"},
        {"flag": "R", "meaning": "returned"},
    ]
    codes = from_rows(spark, meanings)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return lines.agg(F.count(F.lit(1)).alias("n")).join(codes, "flag").select("meaning", "n")


_INPUTS = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier"
).split()


@query(
    " union all ".join(
        f"select '{t}.parquet' as name, {str(t == _INPUTS[0]).lower()} as is_first, count(*) as n_rows from {t}" for t in _INPUTS
    )
)
def input_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parquet tables of the input folder with their rows; the first in path order is picked."""
    found = tables.list_inputs(spark, sf_dir, [".PARQUET"]).select("name", "path").collect()  # a row for each input file
    picked = tables.pick_input(spark, sf_dir, [".parquet"])
    counts = [
        spark.read.parquet(r["path"]).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(r["name"]).alias("name"), F.lit(r["path"] == picked).alias("is_first"), "n_rows"
        )
        for r in found
    ]
    return reduce(DataFrame.unionByName, counts)


@query("select s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' as source from supplier")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archive")
    tables.write_table(table(spark, sf_dir, "supplier"), f"{folder}/in/supplier.csv")
    copy = tables.archive(spark, f"{folder}/in/supplier.csv", f"{folder}/out", compress=True, now=NOON)
    name = copy.rsplit("/", 1)[1]
    source = F.regexp_extract(F.lit(name), r"^20240101_120000_(.*)\.csv$", 1)
    read = tables.read_table(spark, copy).withColumn("source", source)
    return read.withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query(_SUMMARY_SQL)
def artifacts_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit record as a stamped artifact, read back."""
    folder = scratch_path(spark, "artifacts")
    summary = audit.eda_summary(audit_lineitem(spark, sf_dir))
    path = tables.write_artifact(summary, folder, "eda_summary", ".json", NOON)
    read = tables.read_table(spark, path, "section string, key string, value double")
    return rounded(read, 6, "value")


@query(
    """
    select run_id, project, cast(count(*) as int) as n_artifacts, min(artifact) as first_artifact
    from (select distinct strftime(o_orderdate, '%Y%m') as run_id,
                 'p' || o_orderstatus as project, o_orderpriority as artifact from orders)
    group by run_id, project
    """
)
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of orders appended as a run, one project per status."""
    path = scratch_path(spark, "runs")
    first = runs.load_runs(spark, path)
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.date_format("o_orderdate", "yyyyMM").alias("run_id"),
            F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("when"),
            F.concat(F.lit("p"), "o_orderstatus").alias("project"),
        )
        .agg(F.array_sort(F.collect_set("o_orderpriority")).alias("artifacts"))
    )
    runs.append_runs(monthly, path)
    loaded = runs.load_runs(spark, path).unionByName(first)
    return loaded.select(
        "run_id",
        "project",
        F.size("artifacts").alias("n_artifacts"),
        F.element_at("artifacts", 1).alias("first_artifact"),
    )


@query(
    """
    select 'classes.json' as kind, 'classes_20240102_120000.json' as artifact, count(distinct l_returnflag) as n_rows from lineitem
    union all
    select 'shape.csv', 'shape_20240101_120000.csv', 1
    """
)
def latest_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest artifact of each kind and how many rows it holds."""
    folder = scratch_path(spark, "latest")
    data = audit_lineitem(spark, sf_dir)
    classes = audit.class_distribution(data.df, data.target)
    for now in (NOON, LATER):
        tables.write_artifact(classes, folder, "classes", ".json", now)
    tables.write_artifact(audit.shape(data), folder, "shape", ".csv", NOON)
    latest = tables.latest_artifacts(spark, folder, [("classes", ".json"), ("shape", ".csv")])
    sizes = [
        tables.read_table(spark, f"{folder}/{name}").agg(
            F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("n_rows")
        )
        for name in ("classes_20240102_120000.json", "shape_20240101_120000.csv")
    ]
    return latest.join(sizes[0].unionByName(sizes[1]), "artifact")

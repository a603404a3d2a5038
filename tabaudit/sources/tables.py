"""CSV and JSON tables, input inventory, archive snapshots and result artifacts."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.columns import col
from tabaudit.functions.columns import quote as quoted
from tabaudit.sources.records import csv_records, narrowest_types

# Stamp format and the input extensions looked for.
STAMP_FORMAT = "%Y%m%d_%H%M%S"
INPUT_EXTENSIONS = (".csv", ".json")

# Quotes inside fields are doubled, a backslash is a character, and white space stays.
CSV_RULES = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _extension(path: str) -> str:
    return posixpath.splitext(path.rstrip("/"))[1].lower()


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    infer: bool = True,
    line_per_row: bool = False,
    split: bool = False,
) -> DataFrame:
    """Read ``.csv`` (header row) or ``.json`` (array of records, or JSON lines).

    Give a ``schema`` for large inputs: inferring one costs an extra pass, and
    JSON lines with a schema are split between tasks.  ``infer=False`` reads all
    CSV fields as text.  Quoted CSV fields may hold line breaks, so a CSV file is read by
    one task; ``line_per_row`` says that it has none and splits it.  ``split`` lets many tasks read a file that
    has some, at the price of a second pass that counts quotes (see ``records``).
    """
    kind = _extension(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == ".csv" and split:
        return _split_csv(spark, path, schema, infer)
    if kind == ".csv":
        rows = reader.options(header=True, multiLine=not line_per_row, **CSV_RULES)
        return rows.option("inferSchema", infer and schema is None).csv(path)
    if kind == ".json":
        found = reader.option("multiLine", _is_record_array(spark, path)).json(path)
        return found if schema is not None else _in_record_order(spark, path, found)
    raise ValueError(f"cannot read {kind or 'a file without extension'}: only .csv and .json")


def _split_csv(spark: SparkSession, path: str, schema: T.StructType | str | None, infer: bool) -> DataFrame:
    """Records cut by many tasks and parsed one by one; empty lines are left out, as Spark's reader does."""
    records = csv_records(spark, path).where(F.trim("record") != "")
    rules = {k: str(v) for k, v in CSV_RULES.items()}
    if schema is None:
        head = records.where("first").orderBy("file").first()
        if head is None:
            return spark.createDataFrame([], T.StructType())
        names = next(csv.reader(io.StringIO(head["record"])))
        wanted = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(names)])
    else:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in wanted.fields)
    rows = records.where(~F.col("first")).select(F.from_csv("record", ddl, rules).alias("r")).select("r.*")
    return narrowest_types(rows) if schema is None and infer else rows


def _is_record_array(spark: SparkSession, path: str) -> bool:
    """Whether the files hold one JSON array each rather than one record per line."""
    first = spark.read.text(path).filter(F.trim("value") != "").head(1)
    return bool(first) and first[0]["value"].lstrip().startswith("[")


def _in_record_order(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """Columns in the order of the first record's keys; an inferred schema sorts them by name.

    Reads as many lines as the first record has.
    """
    names, lines = df.columns, 16
    while True:
        rows = spark.read.text(path).head(lines)
        text = "\n".join(r["value"] for r in rows).lstrip().removeprefix("[").lstrip()
        try:
            record, _ = json.JSONDecoder().raw_decode(text)
        except ValueError:
            if len(rows) < lines:
                return df
            lines *= 4
            continue
        first = [k for k in record if k in names] if isinstance(record, dict) else []
        return df.select(*[col(c) for c in dict.fromkeys([*first, *names])])


def write_table(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Write ``.csv`` with a header, or ``.json`` as JSON lines, without an index column."""
    kind = _extension(path)
    writer = df.write if compression is None else df.write.option("compression", compression)
    if kind == ".csv":
        writer.options(header=True, **CSV_RULES).csv(path)
    elif kind == ".json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"cannot write {kind or 'a file without extension'}: only .csv and .json")


def list_inputs(
    spark: SparkSession, directory: str, extensions: Sequence[str] = INPUT_EXTENSIONS
) -> DataFrame:
    """Rows ``(path, name, extension)`` of the files in ``directory``, not below it.

    The extension test ignores case.  File contents are not read: only the
    listing columns are selected.
    """
    files = spark.read.format("binaryFile").load(directory).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = [e.lower() for e in extensions]
    suffix = F.lower(F.regexp_extract(F.col("name"), r"[^.](\.[^.]+)$", 1))
    return (
        files.withColumn("name", name)
        .withColumn("extension", suffix)
        .filter(F.col("extension").isin(wanted))
    )


def pick_input(
    spark: SparkSession, directory: str, extensions: Sequence[str] = INPUT_EXTENSIONS
) -> str | None:
    """The first input in path order, or ``None``."""
    first = list_inputs(spark, directory, extensions).orderBy("path").select("path").head(1)
    return first[0]["path"] if first else None


def stamped_name(path: str, now: datetime | None = None) -> str:
    stamp = (now or datetime.now()).strftime(STAMP_FORMAT)
    return f"{stamp}_{posixpath.basename(path.rstrip('/'))}"


def _root(spark: SparkSession, source: str) -> str:
    """The full path of ``source`` as file listings spell it, up to its first pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = system.makeQualified(path).toString().split("/")
    plain = next((k for k, part in enumerate(parts) if re.search(r"[*?\[{]", part)), len(parts))
    return "/".join(parts[:plain]).rstrip("/")


def archive(
    spark: SparkSession,
    source: str,
    out_dir: str,
    compress: bool = False,
    now: datetime | None = None,
) -> str:
    """Copy the files of a table to ``out_dir`` under a time-stamped name, gzipped if asked.

    Executors copy byte by byte, a file each and in small pieces, so the copy is identical to its source
    whatever it holds.  A file keeps its path relative to the source, so the folders of a partitioned table stay,
    and appears under its name when it is complete.
    """
    target = f"{out_dir.rstrip('/')}/{stamped_name(source, now)}"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, inside in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Listings spell paths as they are, also with per cent signs and spaces in names of partitions.
                files, place = fs.FileSystem.from_uri(quote(path, safe="/:@=+,;&"))
                out, base = fs.FileSystem.from_uri(target)
                name = f"{base}/{inside}" + ".gz" * compress
                folder = posixpath.dirname(name)
                out.create_dir(folder, recursive=True)
                temporary = f"{folder}/.{posixpath.basename(name)}.{uuid.uuid4().hex}"
                with files.open_input_stream(place, compression=None) as reader:
                    with out.open_output_stream(temporary, compression="gzip" if compress else None) as writer:
                        while piece := reader.read(1 << 20):
                            writer.write(piece)
                out.move(temporary, name)
            yield batch

    # Listing files does not read them.  A table has few enough files for one row each.
    files_read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path")
    hidden = F.element_at(F.split("path", "/"), -1).rlike("^[._]")
    root = _root(spark, source)
    below = F.when(F.col("path").startswith(f"{root}/"), F.col("path").substr(len(root) + 2, 1 << 30))
    name = F.when(F.col("path") == root, F.element_at(F.split("path", "/"), -1)).otherwise(below)
    listed = files_read.filter(~hidden).withColumn("name", name)
    clash = listed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or name is null").head(1)
    if clash:
        raise ValueError(f"{clash[0]['n']} files of {source} have no place of their own in the archive ({clash[0]['name']})")
    listed = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    listed.mapInArrow(copy, "path string, name string").write.format("noop").mode("overwrite").save()
    return target


def write_artifact(df: DataFrame, out_dir: str, prefix: str, extension: str, now: datetime | None = None) -> str:
    """Write a small result table as one stamped file set: ``<prefix>_<stamp><ext>``."""
    stamp = (now or datetime.now()).strftime(STAMP_FORMAT)
    path = f"{out_dir.rstrip('/')}/{prefix}_{stamp}{extension}"
    write_table(df.coalesce(1), path)
    return path


def list_artifacts(spark: SparkSession, out_dir: str, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(kind, artifact)`` of the artifacts with one of the ``(prefix, extension)`` kinds.

    An artifact is a folder of part files, so its name is the parent of a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out_dir)
    artifact = F.element_at(F.split("path", "/"), -2)
    kind = F.lit(None).cast("string")
    for prefix, extension in kinds:
        matches = F.col("artifact").startswith(f"{prefix}_") & F.lower("artifact").endswith(extension)
        kind = F.when(matches, F.lit(f"{prefix}{extension}")).otherwise(kind)
    return (
        files.select(artifact.alias("artifact"))
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("kind", "artifact")
        .distinct()
    )


def latest_artifacts(spark: SparkSession, out_dir: str, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """The last artifact of each kind; stamps sort by time."""
    return list_artifacts(spark, out_dir, kinds).groupBy("kind").agg(F.max("artifact").alias("artifact"))

"""Token ids in Arrow files whose batches hold fixed-size lists: equal-length sequences and masks.

Documents are dealt to shards by ranges of their id and sorted inside them, so that
shards in order hold all documents in ascending order.  Each task encodes its shard
document by document and streams it into one Arrow file of ``input_ids`` (fixed-size
lists of unsigned integers, the narrowest type that holds the vocabulary) and ``mask``
(fixed-size lists of booleans, false where the last sequence of a shard is filled up), and
one of document positions.  A local file is mapped into memory, so any sequence
is read without a copy.  The files lie in a folder that all executors share; a task writes
under a name of its own and renames at the end, so repeated attempts leave one file.

Null or empty texts have the end id alone; a null id counts as the smallest, and rows with
equal ids are ordered by text.  An empty table writes no files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.llm.frames import decoded, shuffle_partitions, sliced, text_bytes
from tabaudit.llm.tokens import encoder

SEQUENCE_LENGTH = 2048
SEQUENCES_PER_BATCH = 256


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class SequenceWriter:
    """Stream ids of one shard into sequences of equal length."""

    def __init__(self, path: str, attempt: str, length: int, dtype: np.dtype, per_batch: int = SEQUENCES_PER_BATCH) -> None:
        self.files, self.path = _opened(path)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.length, self.dtype, self.per_batch = length, np.dtype(dtype), per_batch
        self.temporary = {kind: f"{self.path}.{kind}.{attempt}.part" for kind in ("sequences", "documents")}
        lists = pa.list_(pa.from_numpy_dtype(self.dtype), length), pa.list_(pa.bool_(), length)
        schemas = {
            "sequences": pa.schema([("input_ids", lists[0]), ("mask", lists[1])]),
            "documents": pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]),
        }
        self.schemas = schemas
        self.sinks = {k: self.files.open_output_stream(p) for k, p in self.temporary.items()}
        self.writers = {k: pa.ipc.new_file(s, schemas[k]) for k, s in self.sinks.items()}
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.n_docs = self.n_sequences = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_tokens, len(ids)))
        self.waiting.append(ids.astype(self.dtype))
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.n_waiting >= self.length * self.per_batch:
            self._flush(False)
        if len(self.rows) >= 10_000:
            self._flush_documents()

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        step = self.length * self.per_batch
        done = 0
        while len(ids) - done >= step or last and done < len(ids):
            part = ids[done : done + step]
            done += len(part)
            filled = -(-len(part) // self.length) * self.length
            mask = np.ones(filled, bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(filled - len(part), self.dtype)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.writers["sequences"].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schemas["sequences"]))
            self.n_sequences += filled // self.length
        self.waiting, self.n_waiting = [ids[done:]], len(ids) - done

    def _flush_documents(self) -> None:
        if self.rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*self.rows)]
            self.writers["documents"].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schemas["documents"]))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        self._flush_documents()
        for kind, name in self.temporary.items():
            self.writers[kind].close()
            self.sinks[kind].close()
            self.files.move(name, f"{self.path}.{kind}.arrow")


class SequenceFile:
    """Random access to one shard; local files are mapped, so nothing is copied."""

    def __init__(self, path: str) -> None:
        files, self.path = _opened(path)
        self.sequences, self.documents = (
            pa.ipc.open_file(self._source(files, f"{self.path}.{kind}.arrow")) for kind in ("sequences", "documents")
        )
        self.length = self.sequences.schema.field("input_ids").type.list_size
        # All batches but the last have as many sequences as the first.
        self.per_batch = self.sequences.get_batch(0).num_rows if self.sequences.num_record_batches else 1

    @staticmethod
    def _source(files: fs.FileSystem, name: str):
        return pa.memory_map(name) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(name)

    def __getitem__(self, index: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of one sequence of the shard."""
        at, row = divmod(index, self.per_batch)
        if not 0 <= at < self.sequences.num_record_batches:
            raise IndexError(index)
        batch = self.sequences.get_batch(at)
        if row >= batch.num_rows:
            raise IndexError(index)
        ids, mask = (batch.column(i).slice(row, 1).flatten() for i in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def each_document(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """Id, start in the shard, length and ids (in parts, as batches end) of each document."""
        held, first, values = -1, 0, np.zeros(0, np.uint16)
        step = self.length * self.per_batch

        def parts(start: int, n: int) -> Iterator[np.ndarray]:
            nonlocal held, first, values
            while n > 0:
                if start // step != held:
                    held, first = start // step, start // step * step
                    column = self.sequences.get_batch(held).column(0)
                    values = column.flatten().to_numpy(zero_copy_only=True)
                part = values[start - first : start - first + n]
                yield part
                start, n = start + len(part), n - len(part)

        for i in range(self.documents.num_record_batches):
            for doc_id, start, n in zip(*(c.to_pylist() for c in self.documents.get_batch(i).columns)):
                yield doc_id, start, n, parts(start, n)


def write_sequences(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    sequence_length: int = SEQUENCE_LENGTH,
    sequences_per_batch: int = SEQUENCES_PER_BATCH,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Write all documents below ``folder``; returns the manifest, one row for each shard.

    The manifest (``shard``, ``file``, ``n_docs``, ``n_tokens``, ``n_sequences``, ``start``: ids in
    the shards before) is written as a table beside the files, so reading it starts no encoding.
    """
    shards = shuffle_partitions(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode, writer = encoder(path), None
        dtype = np.uint16 if max(encode.size, end_id + 1) <= 1 << 16 else np.uint32
        end = np.array([end_id], "<u4").tobytes()
        name = f"{folder}/shard-{task.partitionId():06d}"
        for batch in sliced(batches):
            if writer is None and batch.num_rows:
                writer = SequenceWriter(name, str(task.taskAttemptId()), sequence_length, dtype, sequences_per_batch)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer.add(doc_id, np.frombuffer(encode(decoded(text)) + end, "<u4"))
        if writer is not None:
            writer.close()
            row = [[task.partitionId()], [name], [writer.n_docs], [writer.n_tokens], [writer.n_sequences]]
            names = ["shard", "file", "n_docs", "n_tokens", "n_sequences"]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=names)

    ordered = (
        docs.select(col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    written = materialize(
        ordered.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long, n_sequences long"), "shards"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the files back: ``doc_id``, ``start`` over all shards, ``n_tokens`` and ``ids_crc32`` of each document."""
    shards = shuffle_partitions(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, at, n, parts in SequenceFile(file).each_document():
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part.astype("<u4"), crc)
                    rows.append((doc_id, start + at, n, crc))
                    if len(rows) >= 10_000:
                        yield _rows(rows, types)
                        rows = []
                if rows:
                    yield _rows(rows, types)

    return (
        manifest.select("file", "start")
        .repartition(shards, "file")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def _rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))

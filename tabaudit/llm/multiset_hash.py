"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (the text between line breaks) is hashed to a wide vector, and the vectors of a
document are summed lane by lane modulo powers of two.  So the order of paragraphs doesn't
matter, a paragraph is inserted by adding its vector and deleted by subtracting it, and two
documents can be joined by adding their fingerprints.  A vector has two parts:

* ``IDENTITY_LANES`` lanes modulo 2**64 filled from one strong hash of the whole paragraph: equal
  sums mean equal multisets of paragraphs (up to a chance of about 2**-512 for texts not made to collide);
* ``LIKENESS_LANES`` lanes modulo 2**32 to which each window of ``WINDOW`` bytes of the paragraph (a shorter
  paragraph: the whole) adds +1 or -1 in one lane chosen by hash.  Inner products of such sums estimate how many windows
  two documents share, so likeness can be read from two fingerprints alone.

Likeness is the cosine between these sums, from 0 to 1; its standard error is about
1 / sqrt(LIKENESS_LANES).  Equal fingerprints have likeness 1, and an empty text has likeness 0 to any other.
A window that occurs more than 2**31 times wraps around; identity is not affected.

Nulls count as empty texts, whose fingerprint is that of no paragraph.  Repeated rows have equal
fingerprints.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.ranking import with_bucket
from tabaudit.llm.frames import decoded, id_type, map_texts, shuffle_partitions, sliced, text_bytes

IDENTITY_LANES = 8
LIKENESS_LANES = 128
WINDOW = 8  # bytes, one 64-bit integer
BLOCK = 1 << 20

_SPREAD, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _lane_counts(paragraph: bytes) -> np.ndarray:
    """How many windows of the paragraph fall on each lane with plus, then with minus."""
    padded = np.frombuffer(paragraph.ljust(WINDOW, b"\0"), np.uint8)
    found = np.zeros(2 * LIKENESS_LANES, np.int64)
    for at in range(0, len(padded) - WINDOW + 1, BLOCK):  # a long paragraph in parts, to bound memory
        windows = np.lib.stride_tricks.sliding_window_view(padded[at : at + BLOCK + WINDOW - 1], WINDOW)
        with np.errstate(over="ignore"):
            hashes = np.ascontiguousarray(windows).view("<u8").ravel() * _SPREAD
            hashes = (hashes ^ (hashes >> np.uint64(32))) * _STIR
        slots = (hashes >> np.uint64(64 - (2 * LIKENESS_LANES).bit_length() + 1)).astype(np.int64)
        found += np.bincount(slots, minlength=2 * LIKENESS_LANES)
    return found


class Fingerprint:
    """A sum of paragraph vectors; supports ``+``, ``-``, ``insert`` and ``delete``."""

    __slots__ = ("identity", "likeness_lanes")

    def __init__(self, identity: np.ndarray | None = None, lanes: np.ndarray | None = None) -> None:
        self.identity = np.zeros(IDENTITY_LANES, np.uint64) if identity is None else identity
        self.likeness_lanes = np.zeros(LIKENESS_LANES, np.uint32) if lanes is None else lanes

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        """Sum of the vectors of all paragraphs; empty paragraphs count for identity only."""
        if not text:
            return cls()
        paragraphs = text.split("\n")
        digests = b"".join(hashlib.blake2b(p.encode(), digest_size=8 * IDENTITY_LANES).digest() for p in paragraphs)
        with np.errstate(over="ignore"):
            identity = np.frombuffer(digests, "<u8").reshape(-1, IDENTITY_LANES).sum(0, dtype=np.uint64)
        counts = sum((_lane_counts(p.encode()) for p in paragraphs if p), np.zeros(2 * LIKENESS_LANES, np.int64))
        lanes = counts[:LIKENESS_LANES] - counts[LIKENESS_LANES:]
        return cls(identity, lanes.astype(np.uint32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        with np.errstate(over="ignore"):
            return Fingerprint(self.identity + other.identity, self.likeness_lanes + other.likeness_lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        with np.errstate(over="ignore"):
            return Fingerprint(self.identity - other.identity, self.likeness_lanes - other.likeness_lanes)

    def insert(self, paragraph: str) -> Fingerprint:
        return self + Fingerprint.of(paragraph)

    def delete(self, paragraph: str) -> Fingerprint:
        return self - Fingerprint.of(paragraph)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.to_bytes() == other.to_bytes()

    __hash__ = None

    def to_bytes(self) -> bytes:
        return self.identity.astype("<u8").tobytes() + self.likeness_lanes.astype("<u4").tobytes()

    def to_text(self) -> str:
        return base64.b64encode(self.to_bytes()).decode()

    @classmethod
    def from_text(cls, value: str) -> Fingerprint:
        raw = base64.b64decode(value)
        return cls(np.frombuffer(raw, "<u8", IDENTITY_LANES), np.frombuffer(raw, "<u4", LIKENESS_LANES, 8 * IDENTITY_LANES))

    def likeness(self, other: Fingerprint) -> float:
        if self == other:
            return 1.0
        a, b = (x.likeness_lanes.astype(np.int32).astype(np.float64) for x in (self, other))
        total = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, (a @ b) / total))) if total else 0.0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [Fingerprint.of(decoded(t)).to_text() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return map_texts(docs, id_column, text_column, run, f"doc_id {id_type(docs, id_column)}, fingerprint string")


def with_neighbour(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows ``cell``, ``doc_id``, ``text``, ``own`` sorted by id inside cells of one task each.

    Cells are ranges of ids between sketched quantiles.  The last row of each cell is also sent to
    the next cell that has rows (of the last cell: to the first), with ``own`` false, so that each row finds the
    document with the next smaller id in front of it without a window over the whole table.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    cells = 4 * parts
    rows = docs.select(col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    steps = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    points = rows.agg(F.percentile_approx("doc_id", steps, 20 * cells).alias("p")).first()["p"] or []
    bounds = sorted(set(points))  # at most cells - 1 numbers
    position = F.coalesce("doc_id", F.lit(-(2**63)))  # a null id is the smallest
    rows = with_bucket(rows.withColumn("position", position), "position", bounds, "cell").drop("position")
    ends = rows.groupBy("cell").agg(F.max("doc_id").alias("last")).collect()  # one row for each cell
    order = sorted(r["cell"] for r in ends)
    last = {r["cell"]: r["last"] for r in ends}
    target = {a: b for a, b in zip(order, [*order[1:], *order[:1]])}
    places = spark.createDataFrame(
        [(c, last[c], target[c]) for c in order], "cell int, last long, next_cell int"
    )
    # Several rows may share the last id of a cell; the reader takes the last of them by text.
    sent = rows.join(F.broadcast(places), "cell").withColumn(
        "to",
        F.when(
            F.col("doc_id").eqNullSafe(F.col("last")),
            F.array(F.struct(F.col("cell"), F.lit(True).alias("own")), F.struct(F.col("next_cell").alias("cell"), F.lit(False).alias("own"))),
        ).otherwise(F.array(F.struct(F.col("cell"), F.lit(True).alias("own")))),
    )
    dealt = sent.select(F.explode("to").alias("to"), "doc_id", "text").select("to.cell", "to.own", "doc_id", "text")
    return dealt.repartition(parts, "cell").sortWithinPartitions("cell", "own", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, and compare it to that and to the next document.

    The next document is the one with the next smaller id (of the smallest: the largest).
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, before, mark = None, "", Fingerprint()
        for batch in sliced(batches):
            rows = []
            for at, own, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns)):
                text = decoded(raw)
                if at != cell and own:
                    raise ValueError("a cell begins without the row before it")
                cell = at
                found = Fingerprint.of(text)
                if own:
                    edited = edited_text(text, before)
                    changed = Fingerprint.of(edited)
                    rows.append(
                        (
                            doc_id,
                            len(text),
                            hashlib.sha256(edited.encode()).hexdigest(),
                            found.to_text(),
                            changed.to_text(),
                            found.likeness(changed),
                            found.likeness(mark),
                        )
                    )
                before, mark = text, found
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return with_neighbour(docs, id_column, text_column).mapInArrow(run, schema)

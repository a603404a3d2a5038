"""Pack documents into sequences: Martello-Toth dominance reduction, then best fit.

Only lengths decide a packing, and there are at most ``capacity`` of them.  So the plan is
made for counts of lengths: the driver gets one row per length (2,048 at most, whatever the
table holds) and makes *runs*: "of the pieces of length L, numbers a to b go into
sequences s, s+1, ..., q to each, from offset o on".  Pieces then look up their run by
length and by their number among the pieces of that length.  The numbers are counted
inside cells, so a length that a third of all pieces has is spread over many tasks.

Reduction: for a length L, a small set of pieces that holds one of length L *dominates* when
any sequence with an L could take that set instead without needing more sequences.
Such sets are fixed for good, as often as their counts allow, and what is left is a smaller
instance.  The rest is packed best fit, longest first.

Null and empty texts have only the end id.  A longer document is cut into pieces of the
capacity, and only its last piece may be shorter.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.llm.frames import decoded, hash_cell, id_type, map_texts, shuffle_partitions, sliced
from tabaudit.llm.tokens import KEPT_WORDS, encoder, packed

CAPACITY = 2048


class Run(NamedTuple):
    """``n`` pieces of one length, from number ``first`` on, ``per_bin`` to a sequence."""

    length: int
    first: int
    n: int
    per_bin: int
    offset: int
    sequence: int


class Plan:
    """Runs for a histogram of lengths; ``fixed`` counts sequences that the reduction closed."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {k: n for k, n in sorted(histogram.items(), reverse=True) if n > 0}
        if self.left and not 1 <= min(self.left) <= max(self.left) <= capacity:
            raise ValueError(f"lengths must be between 1 and {capacity}")
        self.used: Counter[int] = Counter()
        self.runs: list[Run] = []
        self.sequences = 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _place(self, length: int, bins: int, per_bin: int, offset: int, sequence: int) -> None:
        n = bins * per_bin
        self.runs.append(Run(length, self.used[length], n, per_bin, offset, sequence))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _fix(self, chosen: tuple[int, ...]) -> None:
        """Close sequences with these lengths, as many as the counts allow."""
        need = Counter(chosen)
        bins = min(self.left[k] // n for k, n in need.items())
        offset = 0
        for length, n in need.items():
            self._place(length, bins, n, offset, self.sequences)
            offset += n * length
        self.sequences += bins

    def _reduce(self) -> None:
        found = True
        while found:
            found = False
            for length in list(self.left):
                while self.left.get(length) and (chosen := self._dominant(length)):
                    self._fix(chosen)
                    found = True

    def _others(self, length: int) -> dict[int, int]:
        """Counts without one piece of ``length``, descending."""
        rest = dict(self.left)
        rest[length] -= 1
        return {k: n for k, n in rest.items() if n}

    def _dominant(self, length: int) -> tuple[int, ...] | None:
        """A set of at most three pieces with ``length`` that dominates all others, if there is one."""
        room = self.capacity - length
        others = self._others(length)
        smallest = self._smallest(others, 3)
        if not smallest or smallest[0] > room:
            return (length,)  # nothing else fits
        largest = next(k for k in others if k <= room)
        if largest == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
            return (length, largest)  # it fills the rest, or one more piece fits at most
        if len(smallest) == 3 and sum(smallest) <= room:
            return None  # three more may fit: no small set is known to dominate
        pair, middle = self._best_pair(others, room)
        if sum(pair) <= largest:
            return (length, largest)  # whatever pair fits could take the place of the largest
        if pair[0] == largest and pair[1] >= middle:
            return (length, *pair)
        return None

    @staticmethod
    def _smallest(counts: dict[int, int], n: int) -> list[int]:
        found: list[int] = []
        for k in reversed(counts):
            found += [k] * min(counts[k], n - len(found))
            if len(found) == n:
                break
        return found

    @staticmethod
    def _best_pair(counts: dict[int, int], room: int) -> tuple[tuple[int, int], int]:
        """The pair with the largest sum that fits (the larger piece as long as can be), and the
        longest piece that is the smaller one of any pair that fits."""
        lengths = list(counts)  # descending
        best, middle, j = (0, 0), 0, len(lengths) - 1
        low = lengths[::-1]
        i = len(low) - 1
        for small_at, small in enumerate(low):
            while i >= 0 and low[i] + small > room:
                i -= 1
            if i < small_at or i == small_at and counts[small] < 2:
                break
            if (low[i] + small, low[i]) > (sum(best), best[0]):
                best = (low[i], small)
            middle = small
        return best, middle

    def _best_fit(self) -> None:
        """Longest first, each into the fullest sequence that has room; equal cases at once."""
        open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length in list(self.left):
            room = length
            while n := self.left.get(length, 0):
                while room < self.capacity and not open_bins.get(room):
                    room += 1
                if room < self.capacity:
                    sequence, bins = open_bins[room].pop()
                else:
                    sequence, bins = self.sequences, -(-n // (self.capacity // length))
                    self.sequences += bins
                per_bin = min(room // length, n)
                filled = min(bins, n // per_bin)
                self._place(length, filled, per_bin, self.capacity - room, sequence)
                open_bins[room - per_bin * length].append((sequence, filled))
                if bins > filled:
                    open_bins[room].append((sequence + filled, bins - filled))


def bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: total length, or pieces above half with what cannot join them."""
    total = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best = total
    for limit in range(1, capacity // 2 + 1):
        alone = sum(n for k, n in histogram.items() if k > capacity - limit)
        halves = {k: n for k, n in histogram.items() if capacity // 2 < k <= capacity - limit}
        room = sum(n * (capacity - k) for k, n in halves.items())
        small = sum(k * n for k, n in histogram.items() if limit <= k <= capacity // 2)
        best = max(best, alone + sum(halves.values()) + max(0, -(-(small - room) // capacity)))
    return best


def pieces(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
    kept: int = KEPT_WORDS,
) -> DataFrame:
    """Encode each document, end it with ``end_id`` and cut it into pieces of at most ``capacity`` ids.

    ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids`` as
    little-endian unsigned 32-bit integers.  ``kept`` words stay encoded in a Python worker, which saves time only.
    """
    kind = id_type(docs, id_column)
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, kept), packed([end_id])
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in sliced(batches):
            owner, rows, blobs = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(decoded(text)) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    blob = ids[at : at + 4 * capacity]
                    owner.append(i)
                    rows.append((piece, at // 4, len(blob) // 4, zlib.crc32(blob)))
                    if with_ids:
                        blobs.append(blob)
            if rows:
                columns = [batch.column(0).take(pa.array(owner))]
                columns += [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                columns += [pa.array(blobs, pa.binary())] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(docs, id_column, text_column, cut, schema)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number rows of one ``length`` from 0 on in column ``number``; a hot length has many cells."""
    cells = 4 * shuffle_partitions(rows.sparkSession)
    celled = rows.withColumn("cell", hash_cell(cells, *order))
    sizes = celled.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "cell").orderBy(*order)
    placed = celled.withColumn("number", F.row_number().over(inside) - 1).join(offsets, ["length", "cell"])
    return placed.withColumn("number", F.col("number") + F.col("earlier")).drop("cell", "earlier")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a written table with ``doc_id``, ``piece``, ``length``)."""
    spark = rows.sparkSession
    counts = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity rows at most
    plan = Plan({r["length"]: r["n"] for r in counts}, capacity)
    schema = "length long, first long, n long, per_bin long, run_offset long, run_sequence long"
    # A length takes part in as many runs as there are distinct rooms and fixed sets, so the runs are
    # bounded by the square of the capacity, and are some thousand in practice; they never grow with the pieces.
    runs = spark.createDataFrame([tuple(r) for r in plan.runs], schema)
    number = F.col("number") - F.col("first")
    inside = (number >= 0) & (number < F.col("n"))
    found = numbered(rows, ["doc_id", "piece", "ids_crc32"]).join(F.broadcast(runs), "length").where(inside)
    return found.select(
        *[col(c) for c in rows.columns],
        (F.col("run_sequence") + F.floor(number / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + F.pmod(number, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, kept: int = KEPT_WORDS
) -> DataFrame:
    """All pieces of ``docs`` with their place: encode once, write the pieces, plan, look up."""
    return pack(materialize(pieces(docs, path, capacity, end_id, with_ids=with_ids, kept=kept), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: the packed ids, from pieces that carry ``ids``; a group is at most the capacity."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda done, piece: F.concat(done, piece["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))

"""Ranked lexical search over a sharded inverted index, by Block-Max MaxScore.

``build_index`` reads whole texts in shards of bounded size and writes one row for each (shard, term): the places of
the term's documents in the shard, cut into blocks of 256 places, their term frequencies, and the largest frequency
and shortest document of each block.  Terms are found with numpy as hashes and carry their spelling, by which queries find them.

``search`` joins the postings of the query terms to each shard and works through every query there, the term with
the largest bound first.  As soon as the bounds of the lists left add up to less than the tenth best score so far, no
document that only they hold can enter: those lists are *non-essential*.  From then on only documents seen so far
stay, each with the bounds of the blocks in which it lies, and blocks without a document that may still enter
are never decompressed.  The ten best of all shards are merged by Spark.

Scores are integers, so results are exact: bounds are scores of (largest frequency, shortest document), which no document
exceeds, and only documents that are strictly worse than ten others go.  Ties end by ascending id.

Texts: terms are maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased.  Null and
empty texts have no terms and are found by no query, and the same holds for queries.  Repeated rows are ranked one by
one; null ids come last among equal scores.  Repeated queries give repeated results.  A very long text is a shard of its own.
Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.llm.frames import Batches, text_bytes
from tabaudit.llm.words import byte_classes, gathered, joined, word_hashes, word_spans

TOP = 10
SHARD_BYTES = 12 << 20
BLOCK = 256  # places in a block, so that a place inside it is one byte
# Queries are read in lots of so many bytes of text; a lot and its terms are broadcast.
LOT_BYTES = 16 << 20
_ESCAPE = 255

CLASSES = byte_classes(gaps=bytes(b for b in range(128) if not chr(b).isalnum()), breaks=b"")

_INDEX_SCHEMA = "shard long, term binary, df long, blocks binary, payload binary, n_docs long, n_terms long"
_HITS_SCHEMA = "query int, doc_id long, score long"


@dataclass
class Index:
    """Postings with a header row (null term) for each shard, and the counts that scores need."""

    postings: DataFrame
    n_docs: int
    n_terms: int


# -- building ---------------------------------------------------------------------------------


def _slices(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary array of the byte ranges between offsets."""
    data = np.ascontiguousarray(data).view(np.uint8)
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


_BLOCK_TYPE = np.dtype([("block", "<u4"), ("size", "<u2"), ("max_tf", "<u4"), ("min_terms", "<u4")])


def encode_shard(shard: int, ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    """The index rows of some documents; the first row has no term and holds ids and lengths."""
    buffer, begins = joined(texts)
    starts, ends = word_spans(buffer, CLASSES)
    hashes = word_hashes(buffer, starts, ends)
    document = np.searchsorted(begins, starts, "right") - 1
    n_terms = np.bincount(document, minlength=len(texts)).astype(np.uint32)

    # Number terms by hash, then count (term, document) pairs; sorted by term and place.
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    pairs, tf = np.unique(term * len(texts) + document, return_counts=True)
    term, place = pairs // max(len(texts), 1), pairs % max(len(texts), 1)
    df = np.bincount(term, minlength=len(first))

    # Blocks of each list.
    keys = term * (len(texts) // BLOCK + 1) + place // BLOCK
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    blocks = np.zeros(len(heads), _BLOCK_TYPE)
    if len(heads):
        blocks["block"] = place[heads] // BLOCK
        blocks["size"] = np.diff(heads, append=len(keys))
        blocks["max_tf"] = np.maximum.reduceat(tf, heads)
        blocks["min_terms"] = np.minimum.reduceat(n_terms[place], heads)
    per_term = np.bincount(term[heads], minlength=len(first)) if len(heads) else np.zeros(len(first), np.int64)

    # Payload of a term: a byte for each place, a byte for each frequency, four bytes for each frequency above 254.
    large = tf >= _ESCAPE
    escaped = np.bincount(term, large, len(first)).astype(np.int64)
    sizes = 2 * df + 4 * escaped
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(offsets[-1], np.uint8)
    rank = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
    payload[offsets[term] + rank] = place % BLOCK
    payload[offsets[term] + df[term] + rank] = np.minimum(tf, _ESCAPE)
    which = np.flatnonzero(large)
    order = np.arange(len(which)) - (np.cumsum(escaped) - escaped)[term[which]]
    at = offsets[term[which]] + 2 * df[term[which]] + 4 * order
    four = tf[which].astype("<u4").view(np.uint8).reshape(-1, 4)
    for i in range(4):
        payload[at + i] = four[:, i]

    block_offsets = np.concatenate([[0], np.cumsum(per_term)]) * _BLOCK_TYPE.itemsize
    header_ids = np.array([0 if i is None else i for i in ids], "<i8")
    known = np.array([i is not None for i in ids], np.uint8)
    head = b"".join([header_ids.tobytes(), n_terms.astype("<u4").tobytes(), known.tobytes()])
    count = len(first)

    def whole(array: pa.Array, header: bytes | None) -> pa.Array:
        return pa.concat_arrays([pa.array([header], pa.binary()), array.cast(pa.binary())])

    numbers = pa.nulls(count, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(count + 1, shard, np.int64)),
            whole(gathered(buffer, starts[first], ends[first]), None),
            pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(df.astype(np.int64))]),
            whole(_slices(blocks, block_offsets), None),
            whole(_slices(payload, offsets), head),
            pa.concat_arrays([pa.array([int((n_terms > 0).sum())], pa.int64()), numbers]),
            pa.concat_arrays([pa.array([int(n_terms.sum())], pa.int64()), numbers]),
        ],
        names=["shard", "term", "df", "blocks", "payload", "n_docs", "n_terms"],
    )


def _shards(shard_bytes: int):
    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for doc_id, text in zip(*(batch.column(i).slice(at, 200).to_pylist() for i in (0, 1))):
                    if ids and size + len(text or b"") > shard_bytes:
                        yield encode_shard(number, ids, texts)
                        number, ids, texts, size = number + 1, [], [], 0
                    ids.append(doc_id)
                    texts.append(text or b"")
                    size += len(text or b"")
        if ids:
            yield encode_shard(number, ids, texts)

    return run


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every row of ``doc_id``, ``text``; the index is written to the shared folder."""
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_bytes("text"))
    postings = materialize(rows.mapInArrow(_shards(shard_bytes), _INDEX_SCHEMA), "postings")
    totals = postings.where(F.col("term").isNull()).agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    return Index(postings, totals["docs"] or 0, totals["terms"] or 0)


# -- searching ----------------------------------------------------------------------------------


def length_norm(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """25 for an empty document, 100 for one of average length."""
    return 25 + (75 * n_terms.astype(np.int64) * n_docs) // max(all_terms, 1)


def saturation(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class PostingList:
    """The list of a term in a shard: bounds at once, documents block by block when asked for."""

    def __init__(self, df: int, blocks: bytes, payload: bytes, weight: int, norms: np.ndarray, scale: tuple[int, int]):
        self.df, self.payload, self.weight, self.norms = df, np.frombuffer(payload, np.uint8), weight, norms
        table = np.frombuffer(blocks, _BLOCK_TYPE)
        self.blocks = table["block"].astype(np.int64)
        self.sizes = table["size"].astype(np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bounds = weight * saturation(table["max_tf"], length_norm(table["min_terms"], *scale))
        self.bound = int(self.bounds.max())
        self.decoded = 0

    def decode(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and score parts of the documents in the blocks with these numbers in the list."""
        sizes = self.sizes[wanted]
        at = np.repeat(self.firsts[wanted] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        place = np.repeat(self.blocks[wanted] * BLOCK, sizes) + self.payload[at]
        tf = self.payload[self.df + at].astype(np.int64)
        if (tf == _ESCAPE).any():
            codes = self.payload[self.df : 2 * self.df] == _ESCAPE
            large = self.payload[2 * self.df :].view("<u4")
            which = np.cumsum(codes) - 1
            high = tf == _ESCAPE
            tf[high] = large[which[at[high]]]
        self.decoded += len(wanted)
        return place, self.weight * saturation(tf, self.norms[place])

    def block_bounds(self, n_blocks: int) -> np.ndarray:
        found = np.zeros(n_blocks, np.int64)
        found[self.blocks] = self.bounds
        return found


@dataclass
class Work:
    """How much of the lists a search has read."""

    blocks: int = 0
    decoded: int = 0
    essential: int = 0
    lists: int = 0


@dataclass
class Shard:
    ids: np.ndarray
    known: np.ndarray
    norms: np.ndarray
    work: Work = field(default_factory=Work)

    @classmethod
    def from_header(cls, payload: bytes, scale: tuple[int, int]) -> Shard:
        count = len(payload) // 13
        ids = np.frombuffer(payload, "<i8", count)
        terms = np.frombuffer(payload, "<u4", count, 8 * count)
        known = np.frombuffer(payload, np.uint8, count, 12 * count) > 0
        return cls(ids, known, length_norm(terms, *scale))

    def best(self, lists: list[tuple[PostingList, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``top`` documents for lists and how often the query has their terms."""
        lists = sorted(lists, key=lambda x: -x[0].bound * x[1])
        n_blocks = len(self.ids) // BLOCK + 1
        scores = np.zeros(len(self.ids), np.int64)
        left = np.array([x.bound * times for x, times in lists], np.int64)
        left = left[::-1].cumsum()[::-1]  # what a document can still gain from this list on
        least = 0  # the score that enters the best
        seen: np.ndarray | None = None  # documents that may still enter, once no others can
        by_block: np.ndarray | None = None
        self.work.lists += len(lists)
        for i, (postings, times) in enumerate(lists):
            self.work.blocks += len(postings.blocks)
            if seen is None and left[i] < least:
                seen = np.flatnonzero(scores)
                by_block = np.zeros((len(lists) - i + 1, n_blocks), np.int64)
                for k in range(len(lists) - 1, i - 1, -1):
                    by_block[k - i] = by_block[k - i + 1] + lists[k][0].block_bounds(n_blocks) * lists[k][1]
                split = i
            if seen is None:
                place, part = postings.decode(np.arange(len(postings.blocks)))
                scores[place] += part * times
                self.work.essential += 1
            else:
                seen = seen[scores[seen] + by_block[i - split][seen // BLOCK] >= least]
                wanted = np.flatnonzero(np.isin(postings.blocks, np.unique(seen // BLOCK)))
                if len(wanted):
                    place, part = postings.decode(wanted)
                    scores[place] += part * times
            self.work.decoded += postings.decoded
            postings.decoded = 0
            if i + 1 < len(lists) and len(self.ids) >= top:
                # Of documents that left, scores are only part of the truth, which is safe: they only grow.
                least = max(least, int(np.partition(scores, -top)[-top]))
        hits = np.flatnonzero(scores > 0) if seen is None else seen[scores[seen] > 0]
        order = np.lexsort((self.ids[hits], ~self.known[hits], -scores[hits]))[:top]
        return hits[order], scores[hits[order]]


def _search_shard(sent: Broadcast, scale: tuple[int, int], top: int):
    def run(table: pa.Table) -> pa.Table:
        queries, weights = sent.value
        rows = table.select(["term", "df", "blocks", "payload"]).to_pylist()
        head = next((r for r in rows if r["term"] is None), None)
        found: list[tuple[int, int | None, int]] = []
        if head is not None:
            shard = Shard.from_header(head["payload"], scale)
            lists = {
                r["term"]: PostingList(r["df"], r["blocks"], r["payload"], weights[r["term"]], shard.norms, scale)
                for r in rows
                if r["term"] is not None and weights[r["term"]] > 0
            }
            for number, terms in enumerate(queries):
                mine = [(lists[t], times) for t, times in terms.items() if t in lists]
                if mine:
                    places, scores = shard.best(mine, top)
                    found += [
                        (number, int(shard.ids[p]) if shard.known[p] else None, int(s)) for p, s in zip(places, scores)
                    ]
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"]
        )

    return run


def query_terms(text: str | None) -> dict[bytes, int]:
    """Terms of a query and how often it has them."""
    if not text:
        return {}
    buffer, _ = joined([text.encode("utf-8", "replace")])
    counts: dict[bytes, int] = {}
    for start, end in zip(*word_spans(buffer, CLASSES)):
        word = buffer[start:end].tobytes()
        counts[word] = counts.get(word, 0) + 1
    return counts


def _lots(queries: DataFrame, lot_bytes: int) -> Iterator[list[Row]]:
    lot: list[Row] = []
    size = 0
    for row in queries.toLocalIterator():
        if lot and size + len(row["text"] or "") > lot_bytes:
            yield lot
            lot, size = [], 0
        lot.append(row)
        size += len(row["text"] or "")
    if lot:
        yield lot


def term_weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1))).cast("long")


def search(index: Index, queries: DataFrame, top: int = TOP, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """The ``top`` documents of each row of ``item_id``, ``text``: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = queries.sparkSession
    found = spark.createDataFrame([], "item_id long, query int, doc_id long, score long")
    items = queries.select(col("item_id").cast("long").alias("item_id"), col("text").cast("string").alias("text"))
    start = 0
    for lot in _lots(items, lot_bytes):
        found = found.unionByName(_search_lot(spark, index, lot, start, top))
        start += len(lot)
    order = Window.partitionBy("item_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_lot(spark: SparkSession, index: Index, lot: list[Row], start: int, top: int) -> DataFrame:
    parsed = [query_terms(r["text"]) for r in lot]
    words = sorted(set().union(*parsed))
    terms = spark.createDataFrame([(w,) for w in words], "term binary")
    matched = index.postings.join(F.broadcast(terms), "term", "left_semi")  # at most the words of a lot
    weights = matched.groupBy("term").agg(F.sum("df").alias("df")).select("term", term_weight(F.col("df"), index.n_docs).alias("w"))
    # One row for each word of the lot.
    weight_of = {bytes(t): w for t, w in zip(*weights.toArrow().to_pydict().values())}
    sent = spark.sparkContext.broadcast((parsed, weight_of))
    scale = (index.n_docs, index.n_terms)
    rows = matched.unionByName(index.postings.where(F.col("term").isNull())).select("shard", "term", "df", "blocks", "payload")
    hits = rows.groupBy("shard").applyInArrow(_search_shard(sent, scale, top), _HITS_SCHEMA)
    items = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(lot)], "query int, item_id long")
    return hits.join(F.broadcast(items), "query").select("item_id", (F.col("query") + start).alias("query"), "doc_id", "score")

"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when their sets' Jaccard similarity reaches a threshold.  The
result has every document with the size of its set and the smallest document reachable by links.  It is exact.

1. **Copies.**  Rows with equal sets are one node with a number of its own; the row with the smallest id lends its text.
2. **Candidates.**  With shingles in the order of their hashes, two linked sets share at least l of
   their first n - ceil(t n) + l shingles (*keys*).  l grows with the set, so a document that has fewer than l
   keys in common with any others links to nothing.  This drops documents that merely
   share a passage.  It is repeated, as each drop makes other keys unique.  Of the others the l - 1
   keys that most documents have are left out, as the rarest common key of two linked documents remains.
3. **Clusters.**  What is left falls into connected components by common keys.  No link crosses clusters,
   so each document is sent to one place only.  Clusters above ``UNIT`` documents are cut into blocks by set size, and only
   pairs of blocks whose size ranges can link are compared.
4. **Signature trees.**  A unit builds a tree over its documents.  Each node holds the OR of the token bitmaps
   below it, the range of set sizes, and the most shingles that share bits.  A dual traversal starts at (root,
   root) and leaves out pairs of nodes whose largest possible overlap is too small, and pairs whose documents
   are in one component already.  Pairs of documents that remain are checked on the whole sets.
5. A unit returns one edge to its representative for each linked document (never all pairs), and the components of these
   edges are the result.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Fewer words than a shingle are one shingle; null
texts and texts without words have an empty set and link to nothing.  Rows with equal ids count
as one document with several texts; a null id is its own component (null).  Shingles are compared by 64-bit hashes.
A row is found again by its id and a 64-bit hash of its text, so only its own text comes with it.
``keep_one`` works on rows: an id with two texts is two rows that stay or go by their texts, as are rows without id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.llm.components import connected_components
from tabaudit.llm.frames import decoded, fresh, shuffle_partitions, sliced, text_bytes

WORDS = 4
PERCENT = 85
EXTRA_PERCENT = 10  # of a set: how many more keys than one a link must share
UNIT = 8192
PRUNINGS = 2
LEAF, FANOUT = 16, 8

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_hash = xxhash.xxh3_64_intdigest


def shingles(text: str, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([_hash(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        found = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            found = (found ^ (found >> np.uint64(31))) * _MIX[i % 4] + hashes[i : i + len(found)]
        found = (found ^ (found >> np.uint64(29))) * _MIX[1]
        found ^= found >> np.uint64(32)
    return np.unique(found)


def least_overlap(n: int, percent: int) -> int:
    """A set of ``n`` shares at least so many shingles with any that it links to."""
    return -(-percent * n // 100)


def shared_keys(n: int, percent: int, extra: int) -> int:
    """How many keys a set of ``n`` shares with every other set as large or larger that it links to."""
    return 1 + extra * n // 100


def n_keys(n: int, percent: int, extra: int) -> int:
    return min(n, n - least_overlap(n, percent) + shared_keys(n, percent, extra))


def needed_keys(n: int, percent: int, extra: int) -> int:
    """The fewest keys shared with any partner: that of the smallest set it can link to."""
    return shared_keys(least_overlap(n, percent), percent, extra)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class Node:
    """Documents ``first`` to ``last`` of the tree's order, with what bounds any overlap with them."""

    __slots__ = ("first", "last", "children", "bits", "smallest", "largest", "slack", "sides")

    def __init__(self, first: int, last: int, children: list[Node], bits, smallest: int, largest: int, slack: int, sides: int) -> None:
        self.first, self.last, self.children = first, last, children
        self.bits, self.smallest, self.largest, self.slack, self.sides = bits, smallest, largest, slack, sides


class SignatureTree:
    """Tree over sets; ``sides`` (1 or 2 for each set) restricts comparisons to sets of different sides."""

    def __init__(self, sets: list[np.ndarray], sides: list[int], percent: int) -> None:
        self.percent = percent
        # Near copies mostly share their smallest hash, which puts them side by side.
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]), i))
        self.order, self.sets = order, [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.sides = np.array([sides[i] for i in order], np.int64)
        self.cross = len(set(sides)) > 1
        width = 512
        while width < 2 * np.quantile(self.sizes, 0.9) and width < 32_768:
            width *= 2
        self.bitmaps = np.zeros((len(sets), width // 64), np.uint64)
        for row, values in enumerate(self.sets):
            places = values % np.uint64(width)
            np.bitwise_or.at(self.bitmaps[row], (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
        # Shingles beyond one for each bit: they may match although no further bit does.
        self.slacks = self.sizes - np.bitwise_count(self.bitmaps).sum(1, dtype=np.int64)
        nodes = [self._leaf(i, min(i + LEAF, len(sets))) for i in range(0, len(sets), LEAF)]
        while len(nodes) > 1:
            nodes = [self._parent(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        self.root = nodes[0]
        self.forest = Forest(len(sets))

    def _leaf(self, first: int, last: int) -> Node:
        sizes = self.sizes[first:last]
        return Node(
            first, last, [], np.bitwise_or.reduce(self.bitmaps[first:last]), int(sizes.min()), int(sizes.max()),
            int(self.slacks[first:last].max()), int(np.bitwise_or.reduce(self.sides[first:last])),
        )

    @staticmethod
    def _parent(nodes: list[Node]) -> Node:
        return Node(
            nodes[0].first, nodes[-1].last, nodes, np.bitwise_or.reduce([n.bits for n in nodes]), min(n.smallest for n in nodes),
            max(n.largest for n in nodes), max(n.slack for n in nodes), reduce(lambda a, b: a | b, (n.sides for n in nodes)),
        )

    def _possible(self, p: Node, q: Node) -> bool:
        """Whether any set of ``p`` can link to one of ``q``."""
        if 100 * p.largest < self.percent * q.smallest or 100 * q.largest < self.percent * p.smallest:
            return False
        if self.cross and p.sides == q.sides and p.sides != 3:
            return False
        most = int(np.bitwise_count(p.bits & q.bits).sum()) + min(p.slack, q.slack)
        most = min(most, p.largest, q.largest)
        return (100 + self.percent) * most >= self.percent * (p.smallest + q.smallest)

    def _connected(self, p: Node, q: Node) -> bool:
        root = self.forest.find(p.first)
        return all(self.forest.find(i) == root for n in (p, q) for i in range(n.first, n.last))

    def join(self) -> Forest:
        """Dual traversal; returns which sets of ``order`` belong together."""
        waiting = [(self.root, self.root)]
        while waiting:
            p, q = waiting.pop()
            if not self._possible(p, q) or self._connected(p, q):
                continue
            if not p.children and not q.children:
                self._compare(p, q)
            elif p is q:
                waiting += [(a, b) for i, a in enumerate(p.children) for b in p.children[i:]]
            elif p.children and (not q.children or p.last - p.first >= q.last - q.first):
                waiting += [(a, q) for a in p.children]
            else:
                waiting += [(p, b) for b in q.children]
        return self.forest

    def _compare(self, p: Node, q: Node) -> None:
        a, b = slice(p.first, p.last), slice(q.first, q.last)
        common = np.bitwise_count(self.bitmaps[a, None, :] & self.bitmaps[None, b, :]).sum(2, dtype=np.int64)
        most = common + np.minimum(self.slacks[a, None], self.slacks[None, b])
        most = np.minimum(most, np.minimum(self.sizes[a, None], self.sizes[None, b]))
        possible = (100 + self.percent) * most >= self.percent * (self.sizes[a, None] + self.sizes[None, b])
        if self.cross:
            possible &= self.sides[a, None] != self.sides[None, b]
        for i, j in np.argwhere(possible).tolist():
            i, j = i + p.first, j + q.first
            if i != j and self.forest.find(i) != self.forest.find(j) and links(self.sets[i], self.sets[j], self.percent):
                self.forest.union(i, j)


def row_key(id_column: str, text_column: str) -> tuple[Column, Column]:
    """What finds a row again: its id (rows without id: a hash of the text), and a hash of the text."""
    number, text = col(id_column).cast("long"), text_bytes(text_column)
    return F.coalesce(number, F.xxhash64(text)), F.xxhash64(number.isNull(), text)


def document_sets(docs: DataFrame, width: int, percent: int, extra: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id``, the ``row_key`` (``k1``, ``k2``), ``n``, a 128-bit hash of the set (``h1``, ``h2``) and its ``keys``."""
    types = {"n": pa.int64(), "h1": pa.int64(), "h2": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, keys = [], []
            for text in batch.column(3).to_pylist():
                found = shingles(decoded(text), width)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                rows.append((len(found), int(digest[0]), int(digest[1])))
                keys.append(found[: n_keys(len(found), percent, extra)])
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64)
            columns = [*batch.columns[:3], *[pa.array(c, t) for c, t in zip(zip(*rows), types.values())]]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", *types, "keys"])

    k1, k2 = row_key(id_column, text_column)
    rows = docs.select(col(id_column).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text_bytes(text_column))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, h1 long, h2 long, keys array<long>")


def _needed(percent: int, extra: int):
    least = F.expr(f"({percent} * n + 99) div 100")
    return 1 + F.floor(F.lit(extra) * least / 100)


def _prune(shared: DataFrame, percent: int, extra: int) -> DataFrame:
    """Rows (``key``, ``rep``, ``n``) of keys with two documents or more and of documents with enough of them."""
    holders = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = materialize(shared.withColumn("holders", holders).where(F.col("holders") > 1).drop("holders"), "shared")
    enough = shared.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= _needed(percent, extra))
    return shared.join(enough.select("rep"), "rep")


def _rarest(shared: DataFrame, percent: int, extra: int) -> DataFrame:
    """Leave out each document's most frequent keys, one fewer than any link shares.

    The rarest key that two linked documents share stays with both, so passages that many
    documents have do not tie these together.
    """
    held = shared.withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("key")))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("holders"), "key"))
    return held.withColumn("place", place).where(F.col("place") >= _needed(percent, extra)).select("key", "rep", "n")


def _clusters(shared: DataFrame) -> DataFrame:
    """``rep``, ``n``, ``cluster``: documents connected by common keys."""
    centre = shared.groupBy("key").agg(F.min("rep").alias("b"))
    edges = shared.join(centre, "key").select(F.col("rep").alias("a"), "b").distinct()
    found = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    return shared.select("rep", "n").distinct().join(found, "rep")


def _units(clusters: DataFrame, percent: int, unit: int) -> tuple[DataFrame, bool]:
    """``rep``, ``unit``, ``side``: where each document goes; a cluster above ``unit`` documents is cut into blocks by size."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    clusters = clusters.join(sizes.where(F.col("size") > 1).select("cluster"), "cluster", "left_semi")
    large = materialize(sizes.where(F.col("size") > unit), "large-clusters")
    if not large.limit(1).count():
        return clusters.select("rep", F.concat_ws(":", "cluster").alias("unit"), F.lit(1).alias("side")), False
    marked = clusters.join(large, "cluster", "left")
    small = marked.where(F.col("size").isNull()).select("rep", F.concat_ws(":", "cluster").alias("unit"), F.lit(1).alias("side"))
    # Positions by size inside a large cluster come from counts of sizes: documents of one size are cut by hash.
    big = marked.where(F.col("size").isNotNull()).withColumn("slot", F.pmod(F.xxhash64("rep"), F.greatest(F.expr(f"size div {unit // 4}"), F.lit(1))))
    counts = big.groupBy("cluster", "n", "slot").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("cluster").orderBy("n", "slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("block", F.expr("0") + F.floor(F.coalesce(F.sum("held").over(before), F.lit(0)) / unit))
    big = big.join(counts.select("cluster", "n", "slot", "block"), ["cluster", "n", "slot"])
    blocks = counts.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # Top level of the tree: pairs of blocks, without those whose size ranges cannot link.
    other = blocks.select("cluster", F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    pairs = blocks.join(other, "cluster").where((F.col("block") <= F.col("other")) & (100 * F.col("high") >= percent * F.col("other_low")))
    name = F.concat_ws(":", "cluster", "block", "other").alias("unit")
    sent = pairs.select("cluster", "block", name, F.lit(1).alias("side")).unionByName(
        pairs.where(F.col("block") < F.col("other")).select("cluster", F.col("other").alias("block"), name, F.lit(2).alias("side"))
    )
    return small.unionByName(big.select("rep", "cluster", "block").join(sent, ["cluster", "block"]).select("rep", "unit", "side")), True


def _compare_units(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges ``a`` (document), ``b`` (its representative in the unit) of units with ``text``."""

    def edges(ids: list[int], sides: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        if len(sets) < 2:
            return []
        tree = SignatureTree(sets, sides, percent)
        forest = tree.join()
        groups: dict[int, list[int]] = {}
        for i in range(len(sets)):
            groups.setdefault(forest.find(i), []).append(ids[tree.order[i]])
        return [(a, min(g)) for g in groups.values() if len(g) > 1 for a in g]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, sides, sets = None, [], [], []
        found: list[tuple[int, int]] = []
        for batch in sliced(batches):
            for at, side, rep, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != unit:
                    found += edges(ids, sides, sets)
                    unit, ids, sides, sets = at, [], [], []
                elif ids and ids[-1] == rep and sides[-1] == side:
                    continue  # the same row again
                ids.append(rep)
                sides.append(side)
                sets.append(shingles(decoded(text), width))
            if found:
                yield _edge_batch(found)
                found = []
        found += edges(ids, sides, sets)
        if found:
            yield _edge_batch(found)

    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.select("unit", "side", "rep", "text").repartition(parts, "unit").sortWithinPartitions("unit", "side", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _linked_sets(
    docs: DataFrame, width: int, percent: int, extra: int, unit: int, id_column: str, text_column: str, by_id: bool
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, distinct sets, members and links.

    Distinct sets have a number ``rep``, their smallest ``doc_id`` and the ``row_key`` of its row; members are the rows with
    a set and its ``rep``; links have the smallest ``component`` for each ``rep`` with any.  ``by_id`` leaves rows without
    id out and links the sets of one id.
    """
    sets = materialize(document_sets(docs, width, percent, extra, id_column, text_column), "sets")
    filled = sets.where(F.col("n") > 0)
    if by_id:
        filled = filled.where(F.col("doc_id").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")).alias("first")
    least = filled.groupBy("h1", "h2", "n").agg(first).select("h1", "h2", "n", F.monotonically_increasing_id().alias("rep"), "first.*")
    least = materialize(least, "distinct-sets")  # written, so numbers stay
    named = least.select("h1", "h2", "n", "rep", F.col("doc_id").alias("least_id"), F.col("k1").alias("first_k1"), F.col("k2").alias("first_k2"))
    rows = filled.select("doc_id", "k1", "k2", "n", "h1", "h2").join(named, ["h1", "h2", "n"])
    is_first = (F.col("k1") == F.col("first_k1")) & (F.col("k2") == F.col("first_k2"))
    members = materialize(rows.select("doc_id", "k1", "k2", "n", "rep", "least_id", is_first.alias("is_first")), "members")
    firsts = members.where("is_first").select("k1", "k2", "rep").distinct()
    keys = filled.select("k1", "k2", "n", "keys").join(firsts, ["k1", "k2"])
    shared = keys.select("rep", "n", F.explode("keys").alias("key")).select("key", "rep", "n")
    for _ in range(PRUNINGS):
        shared = _prune(shared, percent, extra)
    shared = materialize(_rarest(shared, percent, extra), "candidates")
    units, cut = _units(materialize(_clusters(shared), "clusters"), percent, unit)
    k1, k2 = row_key(id_column, text_column)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), text_bytes(text_column).alias("text"))
    # The units grow with the documents, so they are never broadcast: one plan for every size.
    dealt = firsts.join(units.hint("merge"), "rep")
    edges = materialize(_compare_units(texts.join(dealt.hint("merge"), ["k1", "k2"]), width, percent), "links")
    if by_id:
        several = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where(F.col("b") < F.col("last"))
        several = materialize(several.select("doc_id", "b"), "several-texts")
        if several.limit(1).count():
            edges = edges.unionByName(members.join(several, "doc_id").select(F.col("rep").alias("a"), "b").distinct())
            cut = True
    if cut:
        found = connected_components(edges).select(F.col("node").alias("rep"), "component")
    else:
        found = edges.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("component"))
    return sets, least, members, found


def jaccard_components(
    docs: DataFrame,
    width: int = WORDS,
    percent: int = PERCENT,
    extra: int = EXTRA_PERCENT,
    unit: int = UNIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every document."""
    sets, least, members, found = _linked_sets(docs, width, percent, extra, unit, id_column, text_column, True)
    smallest = found.join(least.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = found.join(smallest, "component").select("rep", "component_id")
    linked = members.join(named, "rep", "left")
    result = linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "least_id").alias("component_id"))
    alone = sets.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"))
    if alone.join(members, "doc_id", "left_semi").limit(1).count():
        # An empty text of a document that has others.
        result = materialize(result, "components")
        alone = alone.join(result.select("doc_id", "component_id").distinct(), "doc_id", "left")
        alone = alone.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    else:
        alone = alone.withColumn("component_id", F.col("doc_id"))
    return result.unionByName(alone)


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of rows with equal or linked sets stays, that with the smallest id (none is the largest).

    Rows with an empty set stay, but for repeated rows of one id and text.
    """
    sets, least, _, found = _linked_sets(docs, width, percent, EXTRA_PERCENT, UNIT, "doc_id", "text", False)
    group = F.coalesce("component", "rep").alias("group")
    first = F.min(F.struct("nameless", "doc_id", "k1", "k2")).alias("first")
    kept = least.join(found, "rep", "left").groupBy(group).agg(first).select("first.k1", "first.k2")
    kept = kept.unionByName(sets.where(F.col("n") == 0).select("k1", "k2"))
    k1, k2 = fresh(docs, "k1", "k2")
    rows = docs.withColumns(dict(zip((k1, k2), row_key("doc_id", "text"))))
    rows = rows.join(kept.toDF(k1, k2), [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return rows.select(*[col(c) for c in docs.columns])

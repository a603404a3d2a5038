"""Phrase collocations: candidates in double-array tries that numpy walks for all text positions at once.

Four passes over the texts, each a map with sums before the shuffle, and a fifth over what the fourth found:

1. words are counted by language;
2. adjacent words that are both frequent are counted by a hash of the pair;
3. runs of three and four words all of whose pairs may be frequent are counted by a hash;
4. every place of a word that may be frequent becomes a window: the words from there to the end of the longest run
   whose hash may be frequent.  Equal windows are counted together and dealt by the hash of their first pair.
   Frequent words, pairs and runs are sent as bitmaps of fixed size and counted by 40 bits of their hash, so these
   tests err only towards more candidates (no part of a frequent phrase is rarer than the phrase);
5. all windows that begin with a pair meet in one range of hashes.  There the beginnings of windows that reach the
   limit become candidates, which are cut into double-array tries of bounded size.  All windows take their first step
   together, those that are still in the trie the second, and so on; states are counted by ``bincount``.

A place of a text walks the tries of its own range only, so the work grows with the texts, not with texts times tries.
Counts by hash leave a task as packed arrays, one for each range of hashes, and are added up there with numpy; ranges
become more with the words of the table, so that one stays small.

The counts of the fifth pass decide.  Those of single words, added up over ranges, must equal the counts by spelling of
the first pass, which proves that no hash of a word is shared; otherwise all passes are repeated with another seed.

Texts: null is empty; letters A-Z are lower-cased; ``.,;:!?`` and line ends cut pieces, spaces and tabs words.
Null languages are ``und``.  Repeated rows count as often as they occur.  Very long texts are read whole,
in parts that end at a cut.  Empty tables have no phrases.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabaudit.functions.columns import col
from tabaudit.functions.storage import materialize
from tabaudit.llm.frames import Batches, shuffle_partitions, text_bytes
from tabaudit.llm.words import BREAK, byte_classes, gathered, joined, mixed, word_hashes, word_spans

MIN_COUNT, TOP, LONGEST = 30, 2000, 4
ABSORB_PERCENT = 80
# A trie of so many phrases takes about 30 MB; a bitmap of 2**27 bits 16 MB.
TRIE_PHRASES = 400_000
BITMAP_BITS = 27
# Nodes with more children are placed one by one; of n candidates at most n / LARGE_NODE.
LARGE_NODE = 64
_PART_BYTES = 1 << 20
_HELD_WORDS = 600_000
_CHUNK_BITS = 1 << 15  # of Spark's bitmap functions
# Words of the texts for each range of hashes, at most.
_RANGE_WORDS = 4_000_000

CLASSES = byte_classes(gaps=b" \t", breaks=b".,;:!?\n\x0b\x0c\r")
_CUT = re.compile(rb"[.,;:!?\x0a-\x0d]")
_HASHES = [f"h{i}" for i in range(1, LONGEST + 1)]


# -- reading texts ---------------------------------------------------------------------------


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``_PART_BYTES`` that end where a piece ends."""
    at = 0
    while len(text) - at > _PART_BYTES:
        cut = _CUT.search(text, at + _PART_BYTES)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def _lang_number(lang: str) -> np.uint64:
    value = 1469598103934665603
    for byte in lang.encode():
        value = (value ^ byte) * 1099511628211 % (1 << 64)
    return np.uint64(value)


class Words:
    """Words of some texts of one language: hashes, and whether the next word is in the same piece."""

    def __init__(self, lang: str, texts: list[bytes], seed: int):
        self.lang = lang
        self.buffer, _ = joined(texts)
        self.starts, self.ends = word_spans(self.buffer, CLASSES)
        hashes = mixed(word_hashes(self.buffer, self.starts, self.ends, seed) ^ _lang_number(lang))
        self.hashes = np.maximum(hashes, np.uint64(1))  # 0 stands for no word
        breaks = np.flatnonzero(CLASSES[self.buffer] == BREAK)
        piece = np.searchsorted(breaks, self.starts)
        self.linked = np.zeros(len(self.starts), bool)
        self.linked[:-1] = piece[1:] == piece[:-1]


def _read(batches: Batches, seed: int) -> Iterator[Words]:
    """Words of whole texts, gathered by language into parts of bounded size."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at in range(0, batch.num_rows, 200):
            for lang, text in zip(langs[at : at + 200], batch.column(1).slice(at, 200).to_pylist()):
                for part in _parts(text or b""):
                    if not part:
                        continue
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= _PART_BYTES:
                        yield Words(lang, held.pop(lang), seed)
                        sizes[lang] = 0
                    if len(held) > 64:  # languages are few; many tags must not hold many parts
                        lang, texts = held.popitem()
                        sizes[lang] = 0
                        yield Words(lang, texts, seed)
    for lang, texts in held.items():
        yield Words(lang, texts, seed)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(_changes(keys))
    return keys[starts], order[starts], _totals(counts[order], starts)


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value is not that before it."""
    return np.append(np.ones(min(len(values), 1), bool), values[1:] != values[:-1])


def _totals(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``counts`` that begin at ``starts``."""
    return np.add.reduceat(counts, starts) if len(starts) else counts[:0]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


# -- pass 1: words -----------------------------------------------------------------------------

_WORD_SCHEMA = "lang string, word binary, hash long, n long"


def _count_words(seed: int) -> Callable[[Batches], Batches]:
    def flushed(lang: str, held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
        hashes, first, counts = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        words = pa.concat_arrays([h[2] for h in held]).take(pa.array(first)).cast(pa.binary())
        # The row without a word holds the number of all words.
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(hashes) + 1), pa.string()),
                pa.concat_arrays([words, pa.nulls(1, pa.binary())]),
                pa.array(np.append(_signed(hashes), 0)),
                pa.array(np.append(counts, counts.sum())),
            ],
            names=["lang", "word", "hash", "n"],
        )

    def run(batches: Batches) -> Batches:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, pa.Array]]] = {}
        for part in _read(batches, seed):
            if not len(part.hashes):
                continue
            hashes, first, counts = np.unique(part.hashes, return_index=True, return_counts=True)
            held.setdefault(part.lang, []).append((hashes, counts, gathered(part.buffer, part.starts[first], part.ends[first])))
            if sum(len(h[0]) for h in held[part.lang]) > _HELD_WORDS:
                yield flushed(part.lang, held.pop(part.lang))
        for lang, rows in held.items():
            yield flushed(lang, rows)

    return run


# -- passes 2 to 4: pairs, runs and candidates ---------------------------------------------------------


def _bitmap(spark: SparkSession, hashes: DataFrame, bits: int) -> Broadcast:
    """The top ``bits`` bits of column ``hash`` as a broadcast bitmap of fixed size."""
    place = F.shiftrightunsigned("hash", 64 - bits) + 1
    chunks = (
        hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
        .toArrow()  # 2**bits / 8 bytes at most
    )
    found = np.zeros(max(1 << bits, _CHUNK_BITS) // 8, np.uint8)
    for bucket, chunk in zip(chunks["bucket"].to_pylist(), chunks["bitmap"].to_pylist()):
        at = (bucket - 1) * _CHUNK_BITS // 8
        found[at : at + len(chunk)] = np.frombuffer(chunk, np.uint8)
    return spark.sparkContext.broadcast(found)


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first * np.uint64(0xD6E8FEB86659FD93) + second)


def _frequent_pairs(part: Words, frequent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that may be frequent and are followed by another one, and the pair's hash."""
    may = _in_bitmap(frequent, part.hashes, bits)
    places = np.flatnonzero(part.linked[:-1] & may[:-1] & may[1:]) if len(may) else np.zeros(0, np.int64)
    return places, _pair_hashes(part.hashes[places], part.hashes[places + 1])


# Bytes of a hash below the bits of its range that counts keep.
_KEPT_BYTES = 5
_PACKED = "range int, data binary"


def _range_bits(spark: SparkSession, words: int) -> int:
    """Bits of the number of ranges: one for each shuffle partition and for ``_RANGE_WORDS`` words of the texts at least."""
    return max((max(shuffle_partitions(spark), -(-words // _RANGE_WORDS)) - 1).bit_length(), 1)


def _packed_counts(hashes: np.ndarray, counts: np.ndarray, bits: int, min_count: int) -> pa.RecordBatch:
    """Sorted distinct hashes and their counts, a row for each range.  Counts beyond the limit need not be known."""
    ranges = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    ends = np.searchsorted(ranges, np.arange((1 << bits) + 1))
    kept = ((hashes << np.uint64(bits)) >> np.uint64(64 - 8 * _KEPT_BYTES)).astype("<u8")
    keys = kept.view(np.uint8).reshape(-1, 8)[:, :_KEPT_BYTES]
    number = np.minimum(counts, min_count).astype(_count_type(min_count))
    used = np.flatnonzero(np.diff(ends))
    data = [keys[ends[r] : ends[r + 1]].tobytes() + number[ends[r] : ends[r + 1]].tobytes() for r in used]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], names=["range", "data"])


def _count_type(min_count: int) -> np.dtype:
    return np.dtype(np.uint8 if min_count <= 255 else "<u4")


def _frequent_hashes(bits: int, min_count: int) -> Callable[[pa.Table], pa.Table]:
    """The hashes of a range whose counts add up to the limit; the bits that were not kept are 0."""
    kind = _count_type(min_count)

    def run(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for data in table.column("data").to_pylist():
            n = len(data) // (_KEPT_BYTES + kind.itemsize)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :_KEPT_BYTES] = np.frombuffer(data, np.uint8, n * _KEPT_BYTES).reshape(n, _KEPT_BYTES)
            keys.append(wide.view("<u8")[:, 0])
            counts.append(np.frombuffer(data, kind, n, n * _KEPT_BYTES).astype(np.int64))
        unique, _, total = _summed(np.concatenate(keys), np.concatenate(counts))
        high = np.uint64(table.column("range")[0].as_py()) << np.uint64(64 - bits)
        found = (unique[total >= min_count] << np.uint64(64 - 8 * _KEPT_BYTES - bits)) | high
        return pa.table([pa.array(_signed(found))], names=["hash"])

    return run


def _count_hashes(seed: int, bits: int, ranges: int, min_count: int, words: Broadcast, pairs: Broadcast | None) -> Callable[[Batches], Batches]:
    """Packed counts of pairs, or, when these are known, of longer runs."""

    def flushed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, _, counts = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return _packed_counts(hashes, counts, ranges, min_count)

    def run(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in _read(batches, seed):
            found = [h for size, _, h in _runs(part, words.value, None if pairs is None else pairs.value, bits) if (size == 2) == (pairs is None)]
            held += [np.unique(h, return_counts=True) for h in found]
            if sum(len(h[0]) for h in held) > 4 * _HELD_WORDS:
                yield flushed(held)
                held = []
        if held:
            yield flushed(held)

    return run


def _runs(part: Words, words: np.ndarray, pairs: np.ndarray | None, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, places and hashes of runs: all pairs of words that may be frequent, and the runs of such pairs that may be."""
    places, hashes = _frequent_pairs(part, words, bits)
    if pairs is None:
        yield 2, places, hashes
        return
    may = _in_bitmap(pairs, hashes, bits)
    yield 2, places[may], hashes[may]
    # Whether such a pair starts at a word; a longer run needs one at each of its words but the last.
    starts = np.zeros(len(part.hashes) + LONGEST, bool)
    starts[places[may]] = True
    runs = starts[: len(part.hashes)].copy()
    for size in range(3, LONGEST + 1):
        runs &= starts[size - 2 : size - 2 + len(runs)]
        at = np.flatnonzero(runs)
        found = part.hashes[at]
        for i in range(1, size):
            found = _pair_hashes(found, part.hashes[at + i])
        yield size, at, found


def _summed_rows(rows: np.ndarray) -> np.ndarray:
    """Distinct columns of words (0 after the end) with the sums of their counts, which are in the last row."""
    words = rows[:LONGEST]
    keys = words[0]
    for word in words[1:]:
        keys = _pair_hashes(keys, word)
    order = np.argsort(keys)
    change = _changes(keys[order])
    if any((_changes(word[order]) & ~change).any() for word in words):  # a hash is shared
        order = np.lexsort(words)
        change = np.logical_or.reduce([_changes(word[order]) for word in words])
    starts = np.flatnonzero(change)
    return np.concatenate([words[:, order[starts]], _totals(rows[LONGEST][order], starts)[None]])


def _windows(part: Words, words: np.ndarray, pairs: np.ndarray, longer: np.ndarray, bits: int) -> np.ndarray:
    """The words from every word that may be frequent to the end of the longest run that may be, and how often they occur."""
    size = _in_bitmap(words, part.hashes, bits).astype(np.int8)
    for length, at, hashes in _runs(part, words, pairs, bits):
        size[at if length == 2 else at[_in_bitmap(longer, hashes, bits)]] = length
    at = np.flatnonzero(size)
    rows = np.ones((LONGEST + 1, len(at)), np.uint64)
    following = np.append(part.hashes, np.zeros(LONGEST, np.uint64))
    for i in range(LONGEST):
        rows[i] = np.where(size[at] > i, following[at + i], 0)
    return _summed_rows(rows)


def _find_windows(seed: int, bits: int, ranges: int, words: Broadcast, pairs: Broadcast, longer: Broadcast) -> Callable[[Batches], Batches]:
    """Packed windows and counts; ``range`` is that of the hash of the first pair."""

    def flushed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = _summed_rows(np.concatenate(held, axis=1))
        where = (_pair_hashes(rows[0], rows[1]) >> np.uint64(64 - ranges)).astype(np.int64)
        order = np.argsort(where * (LONGEST + 1) + np.count_nonzero(rows[:LONGEST] == 0, axis=0))  # long ones first
        rows = rows[:, order]
        ends = np.searchsorted(where[order], np.arange((1 << ranges) + 1))
        used = np.flatnonzero(np.diff(ends))
        data = [_packed_windows(rows[:, ends[r] : ends[r + 1]]) for r in used]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], names=["range", "data"])

    def run(batches: Batches) -> Batches:
        held: list[np.ndarray] = []
        for part in _read(batches, seed):
            held.append(_windows(part, words.value, pairs.value, longer.value, bits))
            if sum(h.shape[1] for h in held) > 2 * _HELD_WORDS:
                yield flushed(held)
                held = []
        if held:
            yield flushed(held)

    return run


def _packed_windows(rows: np.ndarray) -> bytes:
    """Windows in falling order of length, without what stands after their ends, and counts of as few bytes as will do."""
    sizes = np.count_nonzero(rows[:LONGEST], axis=1)
    counts = rows[LONGEST].astype(np.min_scalar_type(rows[LONGEST].max()).newbyteorder("<"))
    head = np.append(sizes, counts.itemsize).astype("<u4")
    return b"".join([head.tobytes(), *[word[:n].tobytes() for word, n in zip(rows, sizes)], counts.tobytes()])


def _unpacked_windows(data: bytes) -> np.ndarray:
    *sizes, width = np.frombuffer(data, "<u4", LONGEST + 1).tolist()
    rows = np.zeros((LONGEST + 1, sizes[0]), np.uint64)
    at = 4 * (LONGEST + 1)
    for word, n in zip(rows, sizes):
        word[:n] = np.frombuffer(data, np.uint64, n, at)
        at += 8 * n
    rows[LONGEST] = np.frombuffer(data, f"<u{width}", sizes[0], at)
    return rows


# -- pass 5: double-array tries ---------------------------------------------------------------------


class DoubleArray:
    """A trie of word sequences: from state ``s`` the symbol ``c`` leads to ``base[s] + c`` if ``check`` there is ``s``.

    ``alphabet`` holds the sorted hashes of all words of the trie and ``codes`` their symbols, from 1.
    """

    def __init__(self, alphabet: np.ndarray, codes: np.ndarray, base: np.ndarray, check: np.ndarray):
        self.alphabet, self.codes, self.base, self.check = alphabet, codes, base, check

    @classmethod
    def build(cls, phrases: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
        """The trie of rows of hashes (0 after the end) and the state in which each row ends."""
        words = np.unique(phrases)
        alphabet = words[words != 0]
        # Words that follow others often get small symbols, so that the children of a node lie close together.
        places = np.searchsorted(alphabet, phrases)
        follows = np.bincount(places[:, 1:][phrases[:, 1:] != 0], minlength=len(alphabet))
        codes = np.empty(len(alphabet), np.int32)
        codes[np.argsort(-follows, kind="stable")] = np.arange(1, len(alphabet) + 1, dtype=np.int32)
        symbols = np.zeros(phrases.shape, np.int64)
        symbols[phrases != 0] = codes[places[phrases != 0]]
        # Nodes of each level: distinct prefixes, numbered through all levels; node 0 is the root.
        node = np.zeros(len(symbols), np.int64)
        parents, letters, levels, total = [], [], [], 1
        for level in range(symbols.shape[1]):
            here = symbols[:, level] > 0
            keys = node[here] * (len(alphabet) + 1) + symbols[here, level]
            unique, which = np.unique(keys, return_inverse=True)
            parents.append(unique // (len(alphabet) + 1))
            letters.append(unique % (len(alphabet) + 1))
            node[here] = total + which
            levels.append(len(unique))
            total += len(unique)
        parent, letter = np.concatenate(parents), np.concatenate(letters)
        order = np.lexsort((letter, parent))
        parent, letter = parent[order], letter[order]
        heads, first, size = np.unique(parent, return_index=True, return_counts=True)
        base_of = np.zeros(total, np.int64)
        slots = _Slots(2 * (total + len(alphabet)) + 2)
        by_size = np.lexsort((heads, -size))
        large = by_size[: int((size > LARGE_NODE).sum())]
        for which in large:
            base_of[heads[which]] = slots.place(letter[first[which] : first[which] + size[which]])
        high = LARGE_NODE
        while high > 1:
            those = np.flatnonzero((size > high // 2) & (size <= high))
            base_of[heads[those]] = slots.place_many(letter, first[those], size[those])
            high //= 2
        single = np.flatnonzero(size == 1)
        base_of[heads[single]] = slots.place_singles(letter[first[single]], len(alphabet))
        state = np.zeros(total, np.int64)
        state[order + 1] = base_of[parent] + letter  # node numbers follow the order before sorting
        length = int(state.max(initial=0)) + len(alphabet) + 2
        base = np.zeros(length, np.int32)
        check = np.full(length, -1, np.int32)
        base[state] = base_of
        check[state[order + 1]] = state[parent]
        return cls(alphabet, codes, base, check), state[node]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for words that the trie does not have."""
        if not len(self.alphabet):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == hashes, self.codes[place], 0).astype(np.int64)

    def add_counts(self, counts: np.ndarray, hashes: np.ndarray, linked: np.ndarray, times: np.ndarray | None = None) -> None:
        """Add the visits of every state by all positions, one level of the trie after the other.

        With ``times``, a position is as many visitors, and none where it is 0.
        """
        symbols = self.symbols(hashes)
        at = np.flatnonzero(symbols if times is None else (symbols > 0) & (times > 0))
        state = np.zeros(len(at), np.int64)
        visits = None if times is None else times[at]
        while len(at):
            there = self.base[state] + symbols[at]
            known = self.check[there] == state
            at, state = at[known], there[known]
            visits = None if visits is None else visits[known]
            counts += np.bincount(state, visits, len(counts)).astype(np.int64)
            further = linked[at]
            further[further] = symbols[at[further] + 1] > 0
            at, state = at[further] + 1, state[further]
            visits = None if visits is None else visits[further]

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.alphabet), len(self.base)], np.int64)
        return b"".join(a.tobytes() for a in (sizes, self.alphabet, self.codes, self.base, self.check))

    @classmethod
    def from_bytes(cls, data: bytes) -> DoubleArray:
        words, slots = (int(n) for n in np.frombuffer(data, np.int64, 2))
        codes = 16 + 8 * words
        base = codes + 4 * words
        return cls(
            np.frombuffer(data, np.uint64, words, 16),
            np.frombuffer(data, np.int32, words, codes),
            np.frombuffer(data, np.int32, slots, base),
            np.frombuffer(data, np.int32, slots, base + 4 * slots),
        )


class _Slots:
    """Free slots of a double array while it is built; slot 0 is the root.  Nodes with more children come first."""

    def __init__(self, size: int, window: int = 4096, windows: int = 16):
        self.used = np.zeros(size, bool)
        self.used[0] = True
        self.window, self.windows = window, windows
        self.start = self.end = 1

    def _grow(self, size: int) -> None:
        if size > len(self.used):
            self.used = np.concatenate([self.used, np.zeros(size - len(self.used), bool)])

    def place(self, steps: np.ndarray) -> int:
        """A base at which all ``steps`` (sorted) hit free slots, for a node with many children.

        A few windows are searched on from the last place, then the node gets fresh slots behind all others.
        """
        first, last = int(steps[0]), int(steps[-1])
        at = max(self.start, first)
        for _ in range(self.windows):
            self._grow(at + self.window + last)
            bases = np.flatnonzero(~self.used[at : at + self.window]) + (at - first)
            for step in steps[1:]:
                bases = bases[~self.used[bases + step]]
                if not len(bases):
                    break
            if len(bases):
                break
            at += self.window
        base = int(bases[0]) if len(bases) else max(self.end - first, 0)
        self._grow(base + last + 1)
        self.used[base + steps] = True
        self.end = max(self.end, base + last + 1)
        self.start = max(1, base + first - self.window)
        return base

    def place_many(self, letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bases for many nodes of similar size: all draw one, those that hit free slots alone keep it."""
        draw = np.random.default_rng(len(first))
        found = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        self._grow(int(2.5 * (self.used.sum() + size.sum())) + 2 * int(letters.max(initial=0)))
        rounds = 0
        while len(left):
            sizes = size[left]
            steps = letters[np.repeat(first[left] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            heads = np.cumsum(sizes) - sizes
            bases = draw.integers(0, len(self.used) - int(letters.max()) - 1, len(left))
            slots = np.repeat(bases, sizes) + steps
            node = np.repeat(np.arange(len(left)), sizes)
            owner = np.full(len(self.used), -1, np.int64)
            fits = np.logical_and.reduceat(~self.used[slots], heads)
            owner[slots[fits[node]]] = node[fits[node]]
            fits &= np.logical_and.reduceat(owner[slots] == node, heads)
            self.used[slots[fits[node]]] = True
            found[left[fits]] = bases[fits]
            left = left[~fits]
            rounds += 1
            if rounds % 64 == 0:
                self._grow(len(self.used) + len(self.used) // 2)
        return found

    def place_singles(self, steps: np.ndarray, largest: int) -> np.ndarray:
        """A base for each of many nodes with one child; slots beyond the largest symbol suit any."""
        self._grow(largest + 1 + len(steps) + int(self.used.sum()))
        free = np.flatnonzero(~self.used[largest + 1 :])[: len(steps)] + largest + 1
        self.used[free] = True
        return free - steps


def _candidates(windows: np.ndarray, min_count: int) -> np.ndarray:
    """Beginnings of windows that reach the limit; a single word may begin windows of other ranges too, so all are kept."""
    found = []
    for size in range(1, LONGEST + 1):
        rows = windows[:, windows[size - 1] != 0]
        rows[size:LONGEST] = 0
        rows = _summed_rows(rows)
        found.append(rows[:LONGEST, (rows[LONGEST] >= min_count) | (size == 1)])
    return np.ascontiguousarray(np.concatenate(found, axis=1).T)


def _count_windows(min_count: int, trie_phrases: int) -> Callable[[pa.Table], pa.Table]:
    """Candidates of a range and how often the windows of the range pass them; 0 stands after the end of a phrase."""

    def run(table: pa.Table) -> pa.Table:
        windows = _summed_rows(np.concatenate([_unpacked_windows(d.as_buffer()) for d in table.column("data")], axis=1))
        candidates = _candidates(windows, min_count)
        stream = windows[:LONGEST].T.ravel()
        linked = np.append(stream[1:] != 0, False)
        linked[LONGEST - 1 :: LONGEST] = False
        times = np.zeros(len(stream), np.int64)
        times[::LONGEST] = windows[LONGEST]
        totals = []
        for at in range(0, len(candidates), trie_phrases):
            trie, ends = DoubleArray.build(candidates[at : at + trie_phrases])
            counts = np.zeros(len(trie.base), np.int64)
            trie.add_counts(counts, stream, linked, times)
            totals.append(counts[ends])
        columns = [pa.array(_signed(np.ascontiguousarray(candidates[:, i]))) for i in range(LONGEST)]
        size = (candidates != 0).sum(axis=1).astype(np.int32)
        return pa.table([pa.array(size), *columns, pa.array(np.concatenate(totals))], names=["size", *_HASHES, "n"])

    return run


_COUNT_SCHEMA = "size int, " + ", ".join(f"{h} long" for h in _HASHES) + ", n long"


# -- the whole ------------------------------------------------------------------------------------------


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, trie_phrases: int = TRIE_PHRASES, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to four words found at least ``min_count`` times, and the words of each language.

    The first frame has ``lang``, ``key`` (hashes of the words), ``size``, ``phrase`` (words, as bytes), ``n``;
    the second ``lang``, ``n``.
    """
    for seed in range(4):
        found = _counted(docs, min_count, trie_phrases, bits, seed)
        if found is not None:
            return found
    raise RuntimeError("words share hashes under every seed")


def _counted(docs: DataFrame, min_count: int, trie_phrases: int, bits: int, seed: int) -> tuple[DataFrame, DataFrame] | None:
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(col("lang").cast("string"), F.lit("und")).alias("lang"), text_bytes("text"))
    words = texts.mapInArrow(_count_words(seed), _WORD_SCHEMA).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
    words = materialize(words.where(F.col("word").isNull() | (F.col("n") >= min_count)), "phrase-words")
    totals = words.where(F.col("word").isNull()).select("lang", "n")
    words = words.where(F.col("word").isNotNull())
    if _shared(words):
        return None

    word_map = _bitmap(spark, words, bits)
    ranges = _range_bits(spark, totals.agg(F.sum("n")).first()[0] or 0)

    def frequent(known_pairs: Broadcast | None) -> Broadcast:
        packed = texts.mapInArrow(_count_hashes(seed, bits, ranges, min_count, word_map, known_pairs), _PACKED)
        return _bitmap(spark, packed.groupBy("range").applyInArrow(_frequent_hashes(ranges, min_count), "hash long"), bits)

    pair_map = frequent(None)
    longer_map = frequent(pair_map)
    packed = texts.mapInArrow(_find_windows(seed, bits, ranges, word_map, pair_map, longer_map), _PACKED)
    counted = materialize(packed.groupBy("range").applyInArrow(_count_windows(min_count, trie_phrases), _COUNT_SCHEMA), "phrase-counts")
    # A longer phrase is counted in the range of its first pair, a word in all ranges where windows begin with it.
    longer, single = counted.where(F.col("size") > 1), counted.where(F.col("size") == 1)
    single = single.groupBy("size", *_HASHES).agg(F.sum("n").alias("n"))
    single = materialize(single.where(F.col("n") >= min_count), "phrase-singles")
    spelt = words.select(F.col("hash").alias("h1"), F.col("n").alias("spelt"))
    if single.join(spelt, "h1", "left").where(~F.col("n").eqNullSafe(F.col("spelt"))).limit(1).count():
        return None
    return _spelt(longer.where(F.col("n") >= min_count).unionByName(single), words), totals


def _shared(words: DataFrame) -> bool:
    return words.groupBy("hash").count().where(F.col("count") > 1).limit(1).count() > 0


def _spelt(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with their words, by an ordinary join of each place with the frequent words."""
    hashes = F.slice(F.array(*_HASHES), F.lit(1), F.col("size"))
    key = F.array_join(hashes.cast("array<string>"), " ").alias("key")
    places = phrases.select(key, "size", "n", F.posexplode(hashes).alias("place", "hash"))
    named = places.join(words.select("hash", "lang", "word"), "hash")
    sequence = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"])
    joined_words = F.reduce(
        F.slice(sequence, 2, LONGEST), F.element_at(sequence, 1), lambda a, b: F.concat(a, F.lit(b" "), b)
    )
    return named.groupBy("key", "size", "n", "lang").agg(joined_words.alias("phrase")).select("lang", "key", "size", "phrase", "n")


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    absorb_percent: int = ABSORB_PERCENT,
    trie_phrases: int = TRIE_PHRASES,
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """The ``top`` phrases of two to four words of each language by ``score``.

    ``score`` is ``2000000 * a div (l + r)`` for the cut of the phrase at which it is lowest (of equal ones the
    first).  A phrase inside a longer one that occurs nearly as often is left out.
    """
    phrases, totals = count_phrases(docs, min_count, trie_phrases, bits)
    phrases = materialize(phrases, "phrases")
    longer = phrases.where(F.col("size") > 1)
    hashes = F.split("key", " ")

    # Parts of a phrase are phrases too, as none is rarer.
    cuts = longer.select(
        "key", F.col("n").alias("a"), hashes.alias("hashes"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    ).select(
        "key", "a", "cut", F.array_join(F.slice("hashes", F.lit(1), F.col("cut")), " ").alias("left_key"),
        F.array_join(F.slice("hashes", F.col("cut") + 1, F.lit(LONGEST)), " ").alias("right_key"),
    )
    counts = phrases.select("key", "n")
    cuts = cuts.join(counts.toDF("left_key", "l"), "left_key").join(counts.toDF("right_key", "r"), "right_key")
    cuts = cuts.withColumn("score", F.expr("2000000BD * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("best")
    best = cuts.groupBy("key").agg(lowest).select("key", "best.*")

    inside = longer.where(F.col("size") > 2).select(
        F.col("n").alias("whole"),
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("size") - 1),
                    lambda size: F.transform(
                        F.sequence(F.lit(1), F.col("size") - size + 1), lambda at: F.array_join(F.slice(hashes, at, size), " ")
                    ),
                )
            )
        ).alias("key"),
    )
    absorbing = inside.groupBy("key").agg(F.max("whole").alias("whole"))
    kept = longer.join(absorbing, "key", "left").where(
        F.col("whole").isNull() | (100 * F.col("whole") < absorb_percent * F.col("n"))
    )
    ranked = kept.join(best, "key").select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals.select("lang", "n"), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )

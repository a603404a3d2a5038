"""Words of many texts as 64-bit hashes, found with numpy over the bytes of whole texts.

A word is a maximal run of bytes of class 0.  Texts are joined by line feeds, which no word contains.
Only the letters A-Z are lower-cased, so every byte keeps its place and UTF-8 stays valid.  The hash of
a word is a polynomial modulo 2**64 of a random number for each byte, read off running sums, so its cost
does not depend on the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORD, GAP, BREAK = 0, 1, 2
_BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_classes(gaps: bytes, breaks: bytes) -> np.ndarray:
    """Class of each byte: ``gaps`` end a word, ``breaks`` also end a piece; the rest are words."""
    classes = np.zeros(256, np.uint8)
    classes[list(gaps)] = GAP
    classes[list(breaks)] = BREAK
    return classes


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower_table()


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a value in every bit of the result; one to one."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_numbers(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < size:
        size = max(size, _BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            tables = []
            for base in (_ODD, inverse):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (tables[0], tables[1])
    return _powers


def word_spans(buffer: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of ``buffer``."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = classes[buffer] == WORD
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal hashes."""
    numbers = _byte_numbers(seed)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            first = int(starts[at])
            stop = max(int(np.searchsorted(ends, first + _BLOCK_BYTES, "right")), at + 1)
            size = int(ends[stop - 1]) - first
            powers, inverses = _power_tables(size + 1)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(numbers[buffer[first : first + size]] * powers[:size], out=sums[1:])
            low, high = starts[at:stop] - first, ends[at:stop] - first
            hashes[at:stop] = (sums[high] - sums[low]) * inverses[low]
            at = stop
    return mixed(hashes)


def gathered(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at the given places as an Arrow binary array, without a Python object for each."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    data = np.ascontiguousarray(buffer[places])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts with a line feed between them, and where each text begins."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    return LOWER[np.frombuffer(b"\n".join(texts), np.uint8)], begins


def blocks(texts: Iterator[bytes], limit: int) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``limit`` bytes together; a text is never cut."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held

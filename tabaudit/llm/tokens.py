"""Token ids of whole texts with the ``tokenizers`` library.

The library spends most of its time on normalising and splitting whole texts.  Where a
vocabulary file lower-cases and splits at white space, classes of characters and
contractions, the pieces between the splits are independent, so each distinct piece
is given to the library's BPE model once and its ids are kept.  Words with characters
outside the simple ranges, and vocabulary files with other rules, go to the
library whole.  The kept pieces are bounded (``KEPT_WORDS``) and only save time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import Struct

import pyarrow as pa
from pyspark.sql import DataFrame

from tabaudit.llm.frames import decoded, sliced, text_bytes

# Two generations of as many words and pieces are kept in each Python worker.
KEPT_WORDS = 200_000

# The rules of the vocabulary files for which pieces are independent.
WORD_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Letters of ASCII and Latin-1 after lower-casing; all other characters are left to the library.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_LETTERS}]+").findall
_UNUSUAL = re.compile(r"[^\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]").search


def vocabulary(name: str) -> str:
    """Path of a file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return Struct(f"<{len(ids)}I").pack(*ids)


class Kept(dict):
    """A memo of two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old.clear()  # before the copy, so that there are never three generations
            self.old.update(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Encode texts by a ``tokenizers`` file, without special tokens added."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.characters = byte_characters()
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.reserved = [t["content"] for t in rules.get("added_tokens") or ()]
        self.by_word = self._words_are_independent(rules)
        self.pieces = Kept(self._piece, kept)
        self.words = Kept(self._word, kept)

    @staticmethod
    def _words_are_independent(rules: dict) -> bool:
        normalizer, splitter = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
        steps = splitter.get("pretokenizers") or [{}]
        return (
            normalizer.get("normalizers") == WORD_NORMALIZER
            and steps[0].get("pattern") == {"Regex": WORD_PATTERN}
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and rules["model"].get("type") == "BPE"
            and rules.get("post_processor") is None
        )

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.characters)
        return packed([t.id for t in self.model.tokenize(piece)])

    def _word(self, word: str) -> bytes:
        if _UNUSUAL(word):
            return self._whole(word)
        return b"".join(map(self.pieces.__getitem__, _PIECES(word.lower())))

    def __call__(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not self.by_word or any(r in text for r in self.reserved):
            return self._whole(text)
        if _UNUSUAL(text):
            # White space beyond ASCII, and all that is rare, stays inside its word.
            words = [w.decode() for w in text.encode().split()]
        else:
            words = text.lower().split()
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str, kept: int = KEPT_WORDS) -> TextEncoder:
    """One encoder for each file in a Python worker."""
    return TextEncoder(path, kept)


def token_counts(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """One row ``n_tokens`` for each document; null and empty texts have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in sliced(batches):
            counts = [len(encode(decoded(t))) // 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

    return docs.select(text_bytes(text_column)).mapInArrow(count, "n_tokens long")



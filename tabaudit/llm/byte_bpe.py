"""Byte-level BPE by a rank file: encoding, character offsets and decoding over Arrow batches.

A rank file lists byte strings in merge order.  The ``tokenizers`` library wants the
vocabulary in printable characters (one for each byte) and merges as pairs, so both are
derived from the ranks: whatever two entries join to a third may merge, in rank order.  Text
is first split by a pattern, and each match is encoded by itself.

Matches always part before a single space between two words, so chunks of texts are
encoded once and kept (bounded); texts with rarer white space are split by the library itself.

Ids are little-endian unsigned 32-bit integers in a binary column.  Decoding joins the bytes
of the ids; a character whose bytes lie in several tokens comes out whole, and bytes that
form no character become U+FFFD in the decoded text but stay as they are in the bytes.
Nulls and empty texts have no ids; unknown ids in ``decode`` raise.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabaudit.functions.columns import col
from tabaudit.llm.frames import decoded, id_type, map_texts, sliced
from tabaudit.llm.tokens import Kept, byte_characters, packed

KEPT_CHUNKS = 200_000

# A space inside or at the end of a longer run of white space does not begin a match;
# Python counts four separators as white space that the pattern does not.
_UNCLEAR = re.compile(r"\s \s|\s \Z|[\x1c-\x1f]").search
# Chunks of these characters are split by the same pattern in Python's engine.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile(r"[\x00-\x1b\x20-\xff]*").fullmatch


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0 to n - 1")
    return [found[i] for i in range(len(found))]


class ByteBpe:
    def __init__(self, path: str, pattern: str | None = None, kept: int = KEPT_CHUNKS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.tokens = read_ranks(path)
        self.characters = byte_characters()
        spelled = [t.decode("latin-1").translate(self.characters) for t in self.tokens]
        ids = {s: i for i, s in enumerate(spelled)}
        merges = [
            (s[:i], s[i:]) for s in spelled if len(s) > 1 for i in range(1, len(s)) if s[:i] in ids and s[i:] in ids
        ]
        self.tokenizer = Tokenizer(models.BPE(ids, merges))
        self.model = self.tokenizer.model
        self.pattern = pattern or default_pattern()
        splitter = pre_tokenizers.Split(Regex(self.pattern), "isolated")
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([splitter, spell])
        self.by_chunk = self.pattern == default_pattern()
        own = self.pattern.replace(r"^\s\p{L}\p{N}", rf"^\s{_LETTERS}{_NUMBERS}")
        own = own.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
        self.split = re.compile(own).findall if self.by_chunk else None
        self.matches, self.chunks = Kept(self._match, kept), Kept(self._spaced, kept)

    def _match(self, match: str) -> bytes:
        plain = match[1:] if match[0] == " " else match
        if plain.isascii() and plain.isprintable() and " " not in plain:
            spelled = match.replace(" ", self.characters[32])
        else:
            spelled = match.encode().decode("latin-1").translate(self.characters)
        return packed([t.id for t in self.model.tokenize(spelled)])

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN(chunk):
            return b"".join(map(self.matches.__getitem__, self.split(chunk)))
        return self.whole(chunk)

    def _spaced(self, word: str) -> bytes:
        return self._chunk(" " + word)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or _UNCLEAR(text):
            return self.whole(text)
        words = text.split(" ")
        first = self._chunk(words[0])
        del words[0]
        return first + b"".join(map(self.chunks.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return joined(self.tokens, ids)

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last character of each token.

        A token that begins or ends inside a character counts that character as its own, so
        neighbours that share a character overlap.
        """
        sizes = np.array([len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        return character[first], character[last] + 1


def joined(tokens: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    return read_ranks(path)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str | None = None) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(
    docs: DataFrame,
    path: str,
    pattern: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_offsets: bool = False,
    with_digest: bool = False,
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (binary) and, if wanted, ``starts`` and ``ends`` in characters.

    ``with_digest`` adds ``ids_sha256``, the hash of the decimal ids joined by one space.
    """
    schema = f"doc_id {id_type(docs, id_column)}, n_tokens long, ids binary"
    schema += ", starts array<long>, ends array<long>" * with_offsets + ", ids_sha256 string" * with_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in sliced(batches):
            texts = [decoded(t) for t in batch.column(1).to_pylist()]
            ids = [bpe.encode(t) for t in texts]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if with_offsets:
                found = [bpe.offsets(t, x) for t, x in zip(texts, ids)]
                columns += [pa.array([list(f[k]) for f in found], pa.list_(pa.int64())) for k in (0, 1)]
                names += ["starts", "ends"]
            if with_digest:
                columns.append(pa.array([_digest(x) for x in ids], pa.string()))
                names.append("ids_sha256")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(docs, id_column, text_column, run, schema)


def _digest(ids: bytes) -> str:
    return hashlib.sha256(" ".join(map(str, np.frombuffer(ids, "<u4").tolist())).encode()).hexdigest()


def decode(rows: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """Add ``decoded_bytes`` to rows with packed ids; keeps every other column."""
    names = [c for c in rows.columns if c != "decoded_bytes"]
    schema = rows.select(*[col(c) for c in names]).schema.add("decoded_bytes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        at = names.index(ids_column)
        for batch in sliced(batches):
            found = [joined(tokens, x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*names, "decoded_bytes"])

    return rows.select(*[col(c) for c in names]).mapInArrow(run, schema)

from __future__ import annotations

import random

import numpy as np
import pytest
import tiktoken

from tabaudit.llm import byte_bpe
from tabaudit.llm.tokens import vocabulary
from tests.llm.cases import documents, texts

PATH = vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {token: i for i, token in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def test_equals_the_rank_library(library):
    bpe = byte_bpe.ByteBpe(PATH, kept=100)
    draw = random.Random(1)
    parts = [" ", "  ", "\n", "\t", " ", "\x85", "\x1c", "a", "Th", "'s", "'T", "é", "ß", "1", "²", "!", "漢", "😀", "́", "\r", "the"]
    for text in ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(5000)] + [t for _, t in texts() if t]:
        ids = bpe.encode(text)
        assert unpacked(ids) == library.encode_ordinary(text), text
        assert bpe.decode(ids) == text.encode()


def test_offsets_cover_the_text_and_split_characters():
    bpe = byte_bpe.ByteBpe(PATH)
    for text in ["", "plain words", "naïve 漢字 😀x", "\U0001f9ea\U0001f9ea"]:
        ids = bpe.encode(text)
        starts, ends = bpe.offsets(text, ids)
        at = 0
        for token, start, end in zip(unpacked(ids), starts.tolist(), ends.tolist()):
            token_bytes = bpe.tokens[token]
            assert token_bytes in text[start:end].encode()
            assert start <= at <= end
            at = end
        assert at == len(text)
    starts, ends = bpe.offsets("\U0001f9ea", bpe.encode("\U0001f9ea"))
    assert len(starts) > 1 and set(starts.tolist()) == {0} and set(ends.tolist()) == {1}


def test_tables(spark, library):
    rows = byte_bpe.decode(byte_bpe.encode(documents(spark), PATH, with_offsets=True, with_digest=True), PATH).collect()
    found = sorted((repr(r["doc_id"]), unpacked(bytes(r["ids"])), bytes(r["decoded_bytes"])) for r in rows)
    assert found == sorted((repr(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts())
    assert all(r["n_tokens"] == len(r["starts"]) == len(r["ends"]) for r in rows)


def test_nothing(spark):
    assert byte_bpe.decode(byte_bpe.encode(documents(spark, []), PATH), PATH).count() == 0

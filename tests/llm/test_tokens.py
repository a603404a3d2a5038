from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabaudit.functions.storage import scratch_path
from tabaudit.llm import sequence_files, token_histogram
from tabaudit.llm.tokens import TextEncoder, token_counts, vocabulary
from tests.llm.cases import documents, texts

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text: str | None) -> list[int]:
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    encode = TextEncoder(PATH, kept=50)
    assert encode.by_word
    draw = random.Random(5)
    parts = [" ", "\n", " ", "\x1c", "a", "B", "É", "ß", "'s", "'T", "1", "½", "!!", "́", "İ", "漢", "😀", "<|endoftext|>", "ﬁ", "Σ", "ª"]
    samples = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(3000)] + [t for _, t in texts() if t]
    for text in samples:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(library, text), text


def test_other_vocabularies_are_encoded_whole():
    path = vocabulary("byte_bpe_50k.json")
    encode = TextEncoder(path)
    assert not encode.by_word
    assert np.frombuffer(encode("Two  words"), "<u4").tolist() == Tokenizer.from_file(path).encode("Two  words").ids


def test_histogram(spark, library):
    lengths = [len(ids_of(library, t)) for _, t in texts()]
    sums = token_histogram.suffix_sums(token_histogram.length_histogram(documents(spark), PATH))
    found = {r["n_tokens"]: r for r in sums.collect()}
    assert {k: r["n_docs"] for k, r in found.items()} == Counter(lengths)
    for limit, row in found.items():
        assert row["docs_at_least"] == sum(n >= limit for n in lengths)
        assert row["tokens_at_least"] == sum(n for n in lengths if n >= limit)
        assert row["truncated_total"] == sum(min(n, limit) for n in lengths)
        assert row["docs_truncated"] == sum(n > limit for n in lengths)
        assert row["quantile"] == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    limits = [0, 1, 3, 100, 4096, 10**9]
    totals = {r["context_limit"]: r["truncated_total"] for r in token_histogram.totals_at(sums, limits).collect()}
    assert totals == {k: sum(min(n, k) for n in lengths) for k in limits}
    middle = {r["share"]: r["n_tokens"] for r in token_histogram.quantiles(sums, [0.5, 1.0]).collect()}
    assert middle == {0.5: sorted(lengths)[(len(lengths) + 1) // 2 - 1], 1.0: max(lengths)}


def test_histogram_of_nothing(spark):
    empty = documents(spark, [])
    assert token_counts(empty, PATH).count() == 0
    assert token_histogram.suffix_sums(token_histogram.length_histogram(empty, PATH)).count() == 0


def test_sequence_files(spark, library):
    folder = scratch_path(spark, "sequence-test")
    manifest = sequence_files.write_sequences(documents(spark), folder, PATH, end_id=2, sequence_length=64, sequences_per_batch=4)
    found = [tuple(r) for r in sequence_files.read_documents(manifest).collect()]
    start, wanted = 0, []
    for doc_id, text in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*ids_of(library, text), 2]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == wanted

    row = manifest.where("n_sequences > 5").first()
    shard = sequence_files.SequenceFile(row["file"])
    ids, mask = shard[row["n_sequences"] - 1]
    assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16
    assert sum(mask.to_pylist()) == row["n_tokens"] - 64 * (row["n_sequences"] - 1)
    with pytest.raises(IndexError):
        shard[row["n_sequences"]]


def test_sequence_files_of_nothing(spark):
    manifest = sequence_files.write_sequences(documents(spark, []), scratch_path(spark, "sequence-test"), PATH, end_id=2)
    assert sequence_files.read_documents(manifest).count() == 0

from __future__ import annotations

from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tabaudit.functions.storage import scratch_path
from tabaudit.llm import decision_list, toxicity
from tabaudit.llm.tokens import vocabulary
from tests.llm.cases import documents, labels, prose, texts
from tests.llm.test_decision_list import junk
from tests.llm.test_signature_join import brute
from tests.llm.test_toxicity import toxic


@pytest.fixture(scope="module")
def folder(spark):
    rows = [(i, toxic(i) if i % 5 == 0 else junk(i) if i % 7 == 0 else prose(i, 60)) for i in range(100, 400)]
    rows += [(i + 1000, t + " and more") for i, t in rows if i % 3 == 1] + [(7000, prose(8000, 9000))] + texts()
    judged = [(i, int(i % 7 != 0 or i % 5 == 0), int(i % 5 == 0)) for i in range(100, 400)]
    path = scratch_path(spark, "pipeline-test")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels(spark, judged).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]

    good = corpus_pipeline.quality_rules(spark, docs, folder).cache()
    verdicts = decision_list.judge(docs, judged).where("kept").select("doc_id")
    assert sorted(repr(r["doc_id"]) for r in good.select("doc_id").collect()) == sorted(repr(r["doc_id"]) for r in verdicts.collect())
    assert good.columns == docs.columns
    kept_ids = {r["doc_id"] for r in good.collect()}
    assert all((i in kept_ids) == (i % 5 == 0 or i % 7 != 0) for i in range(100, 400))

    clean = corpus_pipeline.toxic_documents(spark, good, folder).cache()
    model = toxicity.fit(good, judged)
    wanted = [r["doc_id"] for r in good.collect() if toxicity.score(r["text"] or "", model) < 0.3]
    assert sorted(map(repr, wanted)) == sorted(repr(r["doc_id"]) for r in clean.collect())
    assert sum(i is not None and 100 <= i < 400 and i % 5 == 0 for i in wanted) <= 6

    single = corpus_pipeline.near_duplicates(spark, clean, folder).cache()
    named = [(r["doc_id"], r["text"]) for r in clean.collect() if r["doc_id"] is not None]
    components = brute(list(dict.fromkeys(named)), 5, 80)
    wanted = {c for _, c in components.values()} | ({None} if clean.where("doc_id is null").count() else set())
    assert {r["doc_id"] for r in single.collect()} == wanted and single.columns == docs.columns

    packed = corpus_pipeline.packed_sequences(spark, single, folder).collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    sizes, spans = defaultdict(int), defaultdict(list)
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sizes == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in single.collect()}
    for parts in spans.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)


def test_empty_tables(spark):
    path = scratch_path(spark, "pipeline-test")
    documents(spark, []).write.parquet(f"{path}/documents.parquet")
    labels(spark, []).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0

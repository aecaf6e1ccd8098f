"""The pipeline against plain Python, stage by stage, on whole small tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_small import DOCS, components, corpus, linked_by_shingles, prose
from tilewise.llm import packing, quality_classifier
from tilewise.llm.shared import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stored(stage(spark, docs, SF), "stage")
        if k < 4:
            assert docs.columns == first
        old = {r.doc_id: r.text for r in before.collect()}
        if k == 0:
            kept = {r.doc_id for r in quality_classifier.scores(before).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if k == 1:
            rows = sorted(old.items())
            _, linked = linked_by_shingles(rows)
            part = components(range(len(rows)), linked)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({rows[p][0] for p in part.values()})
        if k == 2:
            w = corpus_pipeline.PASSAGE
            n = Counter(t.encode()[i : i + w] for t in old.values() for i in range(len(t.encode()) - w + 1))
            for r in docs.collect():
                b = old[r.doc_id].encode()
                gone = bytearray(len(b))
                for i in range(len(b) - w + 1):
                    if n[b[i : i + w]] > 1:
                        gone[i : i + w] = b"\1" * w
                assert r.text == bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
                assert r.n_chars == len(r.text)
        if k == 3:
            assert all(1 <= c <= 3 for c in Counter(r.doc_id for r in docs.collect()).values())
            assert {r.text for r in docs.collect()} <= set(old.values())
        if k == 4:
            assert docs.agg({"length": "sum"}).first()[0] == sum(len(packing.encode(r.text, packing.public_tokenizers.path("byte_bpe_50k.json"))) // 4 + 1 for r in before.collect())


def test_passages_of_over_50_words_are_cut(spark):
    """Passages of 51 words and more that stand in several documents go, and nothing else."""
    passages = [prose(900 + k, 51 + k) for k in range(4)]
    rows = [(k, prose(k, 120) + "\n" + passages[k % 4] + "\n" + prose(100 + k, 120), "en", "a", 0) for k in range(12)]
    rows += [(50 + k, prose(500 + k, 150), "en", "a", 0) for k in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    for i, text, *_ in rows:
        if i < 50:
            assert not any(p[3:-3] in got[i] for p in passages) and len(text) - len(got[i]) <= len(passages[i % 4]) + 4
        else:
            assert got[i] == text


@pytest.mark.parametrize("rows", ["cases", "none"])
def test_all_stages_on_odd_tables(spark, tmp_path, rows, request):
    """Nulls, blank and long texts, repeated rows and ids, clashing columns; and no rows at all."""
    d = spark.createDataFrame(corpus() + [corpus()[3]] * 3 + [(None, prose(11, 100), None, None, None), (None, None, None, None, None)] if rows == "cases" else [], DOCS)
    names = ["row", "stamp", "key", "node", "size", "bits", "start", "spans", "bin", "label", "m_id", "n_copies"]
    d.withColumns({c: F.lit("extra") for c in names}).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, str(tmp_path)), "stage")
        assert k == 4 or docs.columns == first
    assert (docs.count() > 0) == (rows == "cases")


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

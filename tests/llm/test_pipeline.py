"""The corpus pipeline's stages, one after the other."""

import corpus_pipeline
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS
        now = {r.doc_id: r for r in docs.collect()}
        assert now.items() <= before.items() and len(now) > 50, name
        docs = spark.createDataFrame(list(now.values()), docs.schema)
        before = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == set(before)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(before)


@pytest.mark.parametrize("i", range(5))
def test_stages_take_awkward_and_empty_documents(docs, none, spark, i):
    name, stage = corpus_pipeline.STAGES[i]
    out = stage(spark, docs, SF)
    assert out.count() <= docs.count()
    if i < 4:
        assert out.columns == docs.columns
    if name == "exact dedup":
        assert sum(r.doc_id == 2 for r in out.collect()) <= 1
    assert stage(spark, none, SF).count() == 0


def test_every_dealt_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names

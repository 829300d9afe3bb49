"""Registered queries against their SQL, and the pipeline on odd documents."""

import corpus_pipeline
import pytest

from checks.compare import canonical, connect
from tideline.llm.oracles import ORACLES
from tideline.llm.queries import QUERIES

SAMPLE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    frame = QUERIES[name](spark, SAMPLE)
    answer = connect(SAMPLE).execute(ORACLES[name])
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical([c[0] for c in answer.description], answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_answers_for_every_row(spark, name):
    table = "pages" if name.startswith("op4_") else "documents"
    assert QUERIES[name](spark, SAMPLE).count() == spark.read.parquet(f"{SAMPLE}/{table}.parquet").count()


def test_stages_keep_columns_on_odd_documents(spark, odd_documents, tmp_path):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SAMPLE)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == odd_documents.columns, name
        path = str(tmp_path / name)
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0


def test_stages_on_no_documents(spark, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, SAMPLE).count() == 0, name


def test_pipeline_stages_against_definitions(spark):
    docs = corpus_pipeline.read_table(spark, "/root/testdata/sf0.001", "documents")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, docs, SAMPLE), SAMPLE).collect()}
    exact = QUERIES["op9_dedup"](spark, SAMPLE).where("kept").count()
    assert 0 < len(kept) <= exact
    encoded = corpus_pipeline.run(spark, SAMPLE)
    assert set(encoded.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and encoded.count() > 0

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_stages_filter_what_their_predecessor_kept(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    before, docs = documents, documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, SF)
        assert docs.columns == documents.columns
        rows = docs.cache()
        assert 0 < rows.count() <= before.count(), name
        assert rows.join(before, "doc_id", "left_anti").count() == 0
        before = rows
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count() and last.where("NOT round_trip").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in last.collect())


def test_ten_queries_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names

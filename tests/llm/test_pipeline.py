import importlib
import os
import re

import pytest

import corpus_pipeline
from tessera.llm import ngram_join
from tests.llm.test_text_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_one_document_of_each_group_stays(docs, texts):
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    want = {low for _, low in brute_components(texts).values()}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_their_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "pii", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else before
        if k < 4:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            rows = {r["doc_id"]: r["text"] for r in after.collect()}
            assert set(rows) <= set(before) and len(rows) == after.count()
            if k < 2:
                assert 0.5 * len(before) < len(rows) and all(rows[i] == before[i] for i in rows)
            elif k == 2:
                assert set(rows) == {low for _, low in brute_components(before).values()}
            else:
                assert set(rows) == set(before) and not any(re.search(r"[A-Za-z0-9]@[a-z0-9-]+\.[a-z]", t) for t in rows.values())
            before = rows
        docs = after
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)


def test_the_rest_works_without_this_package():
    entry = importlib.import_module("__spark_entry__")
    assert {"op1_quote_linking", "op10_packing", "pipeline"} <= set(entry.queries())

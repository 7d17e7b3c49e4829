"""The registered queries and the pipeline on the small driver tables."""

import corpus_pipeline
import pytest
from compare import assert_same

from tidemark.llm import near_dedup, secrets
from tidemark.llm.queries import llm_oracle_sql, llm_queries


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_oracle(spark, data, name):
    assert_same(llm_queries()[name](spark, data), llm_oracle_sql()[name], data)


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in llm_queries()] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = corpus_pipeline.written(docs, name)
            rows.append(docs.count())
            if name == "near_dedup":
                assert near_dedup.near_dedup(docs, 80).where("not kept").count() == 0
            if name == "secrets":
                assert secrets.scan_secrets(docs).where("n_assign + n_access + n_hex > 0").count() == 0
    assert rows == sorted(rows, reverse=True)
    assert rows[0] > rows[1] > rows[2] >= rows[3] == rows[4] > 0.5 * rows[0]
    assert docs.select("doc_id").distinct().count() == rows[4]


def test_pipeline_of_odd_rows(spark, odd, empty, data):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        docs.count()

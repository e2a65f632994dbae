import pytest

import __spark_entry__
import corpus_pipeline
from quillmark.llm import near_dedup, queries, secrets, toxicity
from quillmark.llm.common import fresh, settle, table
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns
        n = after.count()
        assert (n < before) if name in ("toxicity", "near_dedup") else (n == before)
        docs, before = after, n
    scores = toxicity.score(docs, toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels")))
    assert scores.where("score >= 0.9").count() == 0
    assert secrets.scan(docs).where("size(spans) > 0").count() == 0
    assert near_dedup.clusters(docs, 5).where("not kept").count() <= 1  # masked texts may have become alike
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_run_equals_the_stages(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = fresh(spark, f"test-{name}")
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
    got = settle(corpus_pipeline.run(spark, "/root/testdata/sf0.001"), "test-run")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.select(*got.columns).collect()))
    assert got.where("n_tokens < 1").count() == 0 and got.groupBy("bin_id").sum("n_tokens").where("`sum(n_tokens)` > 8192").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert isinstance(queries.SQL[name], str)
    compare(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name])


def test_oracle_values_are_text():
    assert all(isinstance(x, str) and "select" in x.lower() for x in __spark_entry__.oracle_sql().values())

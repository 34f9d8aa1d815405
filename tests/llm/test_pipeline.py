"""Every stage of the pipeline by itself, against plain Python, and the whole."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from presslens.llm import langid, sharding  # noqa: E402
from tests.llm.test_operators import DOCS, brute_matches, odd_documents  # noqa: E402
from tests.llm.test_set_similarity import brute_groups  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "decontaminate", "mix_sources", "shard"]

    first = stages["identify_language"](spark, docs, sf).cache()
    c = langid.fit(docs)
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect() if not c.predict(r.text)[2]}
    assert first.columns == docs.columns

    second = stages["drop_near_duplicates"](spark, first, sf).cache()
    root = brute_groups([(r.doc_id, r.text) for r in first.collect()])
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(root.values())) and second.columns == docs.columns

    third = stages["decontaminate"](spark, second, sf).cache()
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect() if not brute_matches(r.text, items)}
    assert third.columns == docs.columns

    fourth = stages["mix_sources"](spark, third, sf).cache()
    assert fourth.columns == docs.columns and fourth.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert {r.doc_id for r in fourth.collect()} <= {r.doc_id for r in third.collect()}

    last = stages["shard"](spark, fourth, sf)
    table = sharding.lookup_table([f"shard-{i:05d}" for i in range(64)], 8191)
    assert last.count() == fourth.count() and all(table[r.slot] == r.shard for r in last.collect())
    whole = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "slot", "shard").collect()))
    assert whole == sorted(map(tuple, last.select("doc_id", "slot", "shard").collect()))


def test_odd_and_empty(spark, sf):
    for docs in (odd_documents(spark), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert set(docs.columns) - {"slot", "shard"} <= set(out.columns) and out.count() <= 3 * docs.count()

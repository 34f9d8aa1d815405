"""Annotating many short texts takes little time: their tokens are given back together."""

import time

from pyspark.sql import functions as F

from presslens.plans import annotate


def test_many_short_texts(spark):
    docs = spark.range(60_000).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.concat(F.lit("Cuts led to crisis"), "id")).alias("text"))
    began = time.time()
    got = annotate.tokens(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("tok_i").alias("last")).agg(F.count("*"), F.min("n"), F.max("n"), F.max("last")).first()
    assert tuple(got) == (40_000, 4, 4, 3)
    assert time.time() - began < 20


def test_one_long_text(spark):
    docs = spark.createDataFrame([(1, "Cuts led to crisis. " * 20_000), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in annotate.tokens(docs).groupBy("doc_id").agg(F.count("*"), F.countDistinct("tok_i")).collect()] == [(1, 100_000, 100_000)]

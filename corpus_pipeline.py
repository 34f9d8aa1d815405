"""From documents to shards of training text: language, near-duplicates, benchmark passages, mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presslens.llm import decontamination, langid, mixing, sharding, simhash
from presslens.llm.common import folder
from presslens.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, fitted on the labelled ones, rejects go.

    Those are texts that are null, empty or without a letter, and those that two languages fit alike. Rows that repeat or tie are judged each by its text; a null id, lang or source doesn't matter; an empty table, or one without a label
    to learn from, gives an empty one. Other columns pass, whatever their names.
    """
    return langid.drop_rejected(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; texts link at a similarity of 0.8 or more of their sets of 5-word shingles.

    Null, empty and blank texts are alike and count as one group. Of rows that repeat an id one stays, rows without an id all stay; an empty table stays empty. Other columns pass.
    """
    return simhash.drop_near_duplicates(docs, similarity=0.8, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go: a window of an item's size that is similar to it at 0.8 or more.

    Null and empty texts hold none and stay; each row is judged by its own text, so rows that repeat go or stay together; an empty table stays empty. Other columns pass.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, at most three times.

    Null texts have no words, a null source is a source; rows without an id, ties and rows that repeat are drawn each; an empty table stays empty. Other columns pass.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its slot and shard, by its doc_id: rows with equal ids share a shard, a null id counts as the empty string. Texts don't matter; an empty table stays empty; columns named slot or shard are replaced."""
    return sharding.shard(docs, shards=64)


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: SQL can't express compression with dictionaries, SimHash or the search for passages: tests/llm holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet and read again by the next."""
    ship(spark)
    at = folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs

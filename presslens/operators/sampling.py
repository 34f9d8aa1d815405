"""Sampling that depends on keys and a seed alone: reruns and other engines agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def cap(df: DataFrame, groups: list[str], key: str, most: int = 50, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each group, drawn at random; smaller groups stay whole."""
    w = Window.partitionBy(*groups).orderBy(draw(seed, key), F.col(key))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, all if there are fewer."""
    return df.orderBy(draw(seed, key), F.col(key)).limit(n)


#: Chances that a document is drawn at most 0, 1, 2, ... times: sums of the Poisson distribution of mean 1, as far as doubles tell them from 1.
AT_MOST = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(16)]


def resamples(docs: DataFrame, replicates: int, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """(b, doc_id, t): for each replicate the documents drawn and how often.

    Each document is drawn on its own, a Poisson number of times with mean 1 that a hash of seed, replicate and key decides: what drawing with replacement comes to for many documents, without numbering them or gathering the draws.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col(key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    drawn = docs.select(key).distinct().withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))) if replicates else F.lit(0).cast("long"))
    times = sum((F.when(F.col("u") >= x, 1).otherwise(0) for x in AT_MOST), F.lit(0))
    return drawn.where(F.lit(replicates > 0)).withColumn("u", h).withColumn("t", times).where("t > 0").select("b", key, "t")

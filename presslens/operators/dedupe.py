"""Keeping one row of several, by a stated total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.text import squeeze


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key; null equals null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def keep_first_or_null(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows whose key is null all stay. They aren't brought together for it."""
    return df.where(key.isNull()).unionByName(keep_first(df.where(key.isNotNull()), [key], order))


def dedupe_articles(df: DataFrame, seq: str = "load_seq", chars: int = 200) -> DataFrame:
    """The first row of each url; rows without one: the first of those that begin with the same characters."""
    named = keep_first(df.where("url IS NOT NULL"), ["url"], [F.col(seq)])
    return named.unionByName(keep_first(df.where("url IS NULL"), [F.substring(F.trim("content"), 1, chars)], [F.col(seq)]))


def best_record(df: DataFrame, key: str, quality: str, content: str, date: str, seq: str) -> DataFrame:
    """Of each key the row of best quality, then longest content, then latest date; unknown values last."""
    order = [F.col(quality).try_cast("double").desc_nulls_last(), F.length(F.coalesce(content, F.lit(""))).desc(), F.col(date).desc_nulls_last(), F.col(seq)]
    return keep_first(df, [key], order)


def exact_snippets(df: DataFrame, person: str, text: str, seq: str) -> DataFrame:
    return keep_first(df, [F.col(person), squeeze(F.col(text))], [F.col(seq)])


def drop_contained(df: DataFrame, person: str, text: str, key: str) -> DataFrame:
    """Snippets that aren't part of a longer one of the same person; white space and case don't count. Rows without a person go.

    All words of a part but its first and last are words of the whole: snippets meet under the rarest of these, among the person's, and only then is the text compared. Parts of one or two words are looked for in the person's different
    words and pairs of words. So a person with very many snippets is dealt by words, not by pairs.
    """
    d = df.where(F.col(person).isNotNull()).withColumn("_t", squeeze(F.col(text), lower=True))
    w = d.select(F.col(person).alias("_p"), F.col("_t").alias("_big")).distinct().withColumn("_w", F.split("_big", " ")).withColumn("_n", F.length("_big"))
    words = w.select("_p", "_big", "_n", F.explode(F.array_distinct("_w")).alias("_word"))
    seen = words.groupBy("_p", "_word").agg(F.count(F.lit(1)).alias("_seen"), F.max("_n").alias("_longest"))
    inner = w.where(F.size("_w") > 2).select("_p", F.col("_big").alias("_small"), F.explode(F.array_distinct(F.slice("_w", F.lit(2), F.size("_w") - 2))).alias("_word"))
    rarest = inner.join(seen, ["_p", "_word"]).groupBy("_p", "_small").agg(F.min(F.struct("_seen", "_word"))["_word"].alias("_word"))
    long = rarest.join(words, ["_p", "_word"]).where((F.col("_n") > F.length("_small")) & F.contains(F.col("_big"), F.col("_small"))).select("_p", "_small")
    pairs = w.select("_p", "_n", F.explode(F.array_distinct(F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("_w", i + 1))))).alias("_word"))
    pairs = pairs.groupBy("_p", "_word").agg(F.max("_n").alias("_longest"))
    short = w.where((F.size("_w") <= 2) & (F.col("_n") > 0)).select("_p", F.col("_big").alias("_small"), F.size("_w").alias("_many"))
    in_words = lambda part, table: part.join(table.select("_p", "_word", "_longest"), "_p").where((F.col("_longest") > F.length("_small")) & F.contains(F.col("_word"), F.col("_small"))).select("_p", "_small")
    inside = long.unionByName(in_words(short.where("_many = 1"), seen)).unionByName(in_words(short.where("_many = 2"), pairs)).distinct()
    return d.join(inside, (F.col(person) == F.col("_p")) & (F.col("_t") == F.col("_small")), "left_anti").drop("_t")


def dedupe_snippets(df: DataFrame, person: str, text: str, key: str) -> DataFrame:
    return drop_contained(exact_snippets(df, person, text, key), person, text, key)


def latest(df: DataFrame, key: str, start: str, seq: str) -> DataFrame:
    return keep_first(df, [key], [F.col(start).desc_nulls_last(), F.col(seq)])


def best_edges(df: DataFrame, seq: str) -> DataFrame:
    """Of edges that differ in case alone the most certain one."""
    keys = [F.col("person"), F.col("article_index"), F.col("snippet_index"), F.col("relation"), F.lower("cause"), F.lower("effect")]
    return keep_first(df, keys, [F.col("confidence").desc(), F.col(seq)])

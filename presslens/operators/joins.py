"""Joins that need more than an equality, each with one beside it, and windows over sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.text import squeeze, token_sort_ratio


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default: object | None = None, order: str | None = None) -> DataFrame:
    """df with the value that the table has for the key; of rows with one key the last by order wins. With a default unknown keys get it, without they go."""
    picked = F.max_by(value, order) if order else F.max(value)
    one = table.groupBy(F.col(table_key).alias("_k")).agg(picked.alias(value))
    out = df.join(one, F.col(key) == F.col("_k"), "inner" if default is None else "left").drop("_k")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def few(df: DataFrame, most: int) -> DataFrame:
    """df for broadcast, after its rows have been counted: more than ``most`` is an error, since every task would hold them and try each."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to try for each row")
    return F.broadcast(df)


def compare(before: DataFrame, after: DataFrame, on: str) -> DataFrame:
    """Both tables side by side, columns suffixed _before and _after."""
    side = lambda df, s: df.select(on, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != on])
    return side(before, "before").join(side(after, "after"), on)


def matching_mentions(mentions: DataFrame, targets: DataFrame, text: str, pattern: str, *keys: str) -> DataFrame:
    """(keys, person) for clusters of which a mention matches a person's pattern. The patterns are few and go to every task; each is tried within the mention's row."""
    hit = F.rlike(F.col(text), F.concat(F.lit("(?i)"), F.col(pattern)))
    return mentions.join(few(targets, 10_000), hit).select(*keys, "person").distinct()


def fuzzy_best(names: DataFrame, name: str, known: DataFrame, known_name: str, threshold: float = 85.0) -> DataFrame:
    """Each name with the most alike known one at or above the threshold; of equals the first by name.

    Names are tried with every known one of a length that allows the threshold, since no more than the shorter name can be common.
    That is exact, at the price of a comparison for each such pair: the known names are meant to be few.
    """
    length = lambda c: F.length(squeeze(F.col(c)))
    a = names.select(name).distinct().withColumn("_n", length(name))
    b = known.select(F.col(known_name).alias("_known")).distinct().withColumn("_m", length("_known"))
    near = F.least("_n", "_m") * 200.0 >= (F.col("_n") + F.col("_m")) * F.lit(float(threshold)) - 1e-6
    pairs = a.join(b, near).select(name, "_known").withColumn("score", token_sort_ratio(F.col(name), F.col("_known"))).where(F.col("score") >= threshold)
    best = pairs.groupBy(name).agg(F.min(F.struct(-F.col("score"), F.col("_known").alias("known"))).alias("b"))
    return best.select(name, F.col("b.known").alias("match"), F.round(-F.col("b.col1"), 6).alias("score"))


def without_overlap(spans: DataFrame, others: DataFrame, touching: bool = True) -> DataFrame:
    """Spans (doc_id, start, end) that meet none of the others of their document. Spans that touch count as meeting, unless told otherwise."""
    o = others.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    low, high = F.greatest("start", "_s"), F.least("end", "_e")
    return spans.join(o, (F.col("doc_id") == F.col("_d")) & ((low <= high) if touching else (low < high)), "left_anti")


def smallest_span(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Each token (doc_id, tok_i) with the columns of the shortest span that holds it; of equals the first by label, then start."""
    s = spans.withColumnRenamed("doc_id", "_d")
    met = tokens.join(s, (F.col("doc_id") == F.col("_d")) & F.col("tok_i").between(F.col("start"), F.col("end") - 1)).drop("_d")
    w = Window.partitionBy("doc_id", "tok_i").orderBy(F.col("end") - F.col("start"), "label", "start")
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sentence_of(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """Tokens with the sentence that holds their first character."""
    s = sentences.select(F.col("doc_id").alias("_d"), "sent_id", F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    return tokens.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("char_start") >= F.col("_s")) & (F.col("char_start") < F.col("_e"))).drop("_d", "_s", "_e")


def unique_candidates(words: DataFrame, candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, word, tag) for words that are a name of exactly one of the people found in the document."""
    met = words.join(candidates, "word").join(found, ["doc_id", "tag"], "left_semi").select("doc_id", "word", "tag").distinct()
    return met.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "word"))).where("_n = 1").drop("_n")


def windows(sentences: DataFrame, hits: DataFrame, width: int, person: str = "person") -> DataFrame:
    """(doc_id, person, lo, hi, snippet) for each different window of sentences around a hit (doc_id, sent_id, person), clipped at the ends."""
    w = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(-width, width)
    s = sentences.select("doc_id", "sent_id", F.array_join(F.collect_list("text").over(w), " ").alias("snippet"), F.min("sent_id").over(w).alias("lo"), F.max("sent_id").over(w).alias("hi"))
    return s.join(hits.select("doc_id", "sent_id", person).distinct(), ["doc_id", "sent_id"]).groupBy("doc_id", person, "lo", "hi").agg(F.first("snippet").alias("snippet"))


def numbered(df: DataFrame, groups: list[str], order: list[Column | str], out: str) -> DataFrame:
    """A number from 1 within each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def count_names(docs: DataFrame, text: Column, names: DataFrame, name: str = "name") -> DataFrame:
    """(name, frequency): occurrences of each name, words of letters and digits, in all texts, overlapping ones too and never across texts.

    Tokens meet names on the name's first word; the words after it are compared in place. Names that no text holds have 0.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    n = names.select(name).distinct().withColumn("_words", F.regexp_extract_all(F.lower(name), F.lit(r"([\p{L}\p{N}]+)"), 1)).where(F.size("_words") > 0)
    n = n.withColumn("_first", F.element_at("_words", 1))
    longest = n.agg(F.max(F.size("_words"))).first()[0] or 1
    # each token carries as many words as the longest name has, not the whole text; equal stretches are counted before they meet names
    t = docs.select(tokens.alias("_tokens")).select(F.explode(F.transform("_tokens", lambda x, i: F.slice("_tokens", i + 1, F.lit(longest)))).alias("_here"))
    t = t.withColumn("_token", F.get("_here", F.lit(0)))
    met = t.join(F.broadcast(n.select("_first", "_words", name)) if n.count() <= 100_000 else n, F.col("_token") == F.col("_first")).where(F.slice("_here", F.lit(1), F.size("_words")) == F.col("_words"))
    found = met.groupBy(name).agg(F.count(F.lit(1)).alias("frequency"))
    return names.select(name).distinct().join(found, name, "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)).cast("long"))

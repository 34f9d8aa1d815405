"""Building, merging and profiling a corpus of articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.functions.text import strip_fragment
from presslens.functions.values import timestamp
from presslens.operators.aggregates import group_count, null_profile
from presslens.operators.dedupe import best_record, dedupe_articles, keep_first
from presslens.operators.filters import POLITICAL_TERMS, NOT_POLITICAL, among, filled, relevance, year_between
from presslens.schema import ARTICLE, sniff_rename


def combine(sources: dict[str, DataFrame], order: dict[str, str]) -> DataFrame:
    """The sources, each with its name in ``source``, in the shape of ``articles``; load_seq orders them by source, then by the source's own order column."""
    parts = []
    for i, (name, df) in enumerate(sources.items()):
        seq = F.struct(F.lit(i).alias("part"), F.col(f"`{order[name]}`").cast("long").alias("row"))
        shaped = sniff_rename(df.withColumn("_seq", seq)).withColumn("source", F.lit(name))
        parts.append(shaped.select(*[F.col(f"`{c}`") if c in shaped.columns else F.lit(None).cast("string").alias(c) for c in ARTICLE], F.col("_seq").alias("load_seq")))
    return reduce(DataFrame.unionByName, parts)


def build(sources: dict[str, DataFrame], order: dict[str, str], sections: list[str], first_year: int = 1990, last_year: int = 2024) -> DataFrame:
    """One corpus: filtered by section, year and content first, then the first copy of each article in load order. Filters go first so that a copy out of range hides none in range.

    The plan is lazy; it shuffles rows once for urls and once for those without, and leaves ordering by date to the writer.
    """
    d = combine(sources, order).where(among(F.col("section"), sections) & year_between(F.col("date"), first_year, last_year) & filled(F.col("content")))
    return dedupe_articles(d).withColumn("published_at", timestamp(F.col("date")))


def merge_best(tables: list[DataFrame], key: str = "url", fragment: bool = True) -> DataFrame:
    """Of each url, with or without its fragment, the best record of all tables."""
    parts = [t.withColumn("_part", F.lit(i)) for i, t in enumerate(tables)]
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    d = d.withColumn(key, strip_fragment(F.col(key)) if fragment else F.trim(key)).withColumn("_seq", F.struct("_part", "seq"))
    return best_record(d, key, "quality", "content", "date", "_seq").drop("_part", "_seq")


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """What to know of a corpus: totals, nulls, articles by year, lengths, sources."""
    year = df.withColumn("year", F.year(timestamp(F.col("date"))))
    return {
        "totals": df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("url").alias("urls"), F.count_if(F.col("url").isNull()).alias("no_url"), F.min("date").alias("first"), F.max("date").alias("last")),
        "nulls": null_profile(df),
        "by_year": group_count(year, ["year"]),
        "lengths": df.agg(F.round(F.avg(F.length("content")), 6).alias("mean"), F.median(F.length("content")).alias("median")),
        "by_source": group_count(df, ["source"]),
        "by_author": group_count(df, ["author"]).orderBy(F.col("n").desc(), "author").limit(10),
    }


def newest(df: DataFrame, n: int, date: str, key: str) -> DataFrame:
    """The n newest rows; those without a date go."""
    return df.withColumn("_t", timestamp(F.col(date))).where("_t IS NOT NULL").orderBy(F.col("_t").desc(), key).limit(n).drop("_t")


def politics(df: DataFrame, text: str, section: str, opinion: list[str], political: list[str], key: str, positive: list[str] = POLITICAL_TERMS, negative: list[str] = NOT_POLITICAL, threshold: int = 5) -> DataFrame:
    """Articles of the political sections, and those of the opinion sections that are relevant enough; each key once."""
    chosen = df.where(F.col(section).isin(opinion) & (relevance(F.col(text), positive, negative) >= threshold)).withColumn("_from", F.lit(1))
    both = df.where(F.col(section).isin(political)).withColumn("_from", F.lit(0)).unionByName(chosen)
    return keep_first(both, [key], [F.col("_from")]).drop("_from")

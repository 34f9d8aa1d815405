"""A gazetteer of people from landed API responses, and the names they go by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.text import first_last, name_from_bio, normal_name, peerage, served_years, tag_of
from presslens.functions.values import list_of
from presslens.operators.dedupe import latest
from presslens.operators.filters import AMBIGUOUS_SURNAMES, overlaps


def members(commons: DataFrame, lords: DataFrame, history: DataFrame, prose: DataFrame | None = None, first: str = "1990-01-01", last: str = "2024-12-31") -> DataFrame:
    """Members (id, display, full_title, gender, party, constituency, start, end as text) who served within the dates.

    Commoners by their latest membership; lords by their earlier one, from history (id, start, end) or, for ids it lacks, from prose (id, text). Lords need a known date.
    """
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    date = lambda c: F.col(c).try_cast("date")
    kept = commons.where((F.col("house") == 1) & overlaps(date("start"), date("end"), lo, hi)).withColumn("titled", F.lit(False))
    past = latest(history, "id", "start", "end").select(F.col("id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    found = lords.drop("start", "end").join(past, F.col("id") == F.col("_id"), "left")
    if prose is not None:
        told = prose.select(F.col("id").alias("_pid"), served_years(F.col("text")).alias("y"))
        found = found.join(told, F.col("id") == F.col("_pid"), "left").withColumn("_s", F.coalesce("_s", "y.start")).withColumn("_e", F.coalesce("_e", "y.end")).drop("_pid", "y")
    found = found.withColumnsRenamed({"_s": "start", "_e": "end"}).drop("_id").where(overlaps(date("start"), date("end"), lo, hi, strict=True)).withColumn("titled", F.lit(True))
    return kept.unionByName(found, allowMissingColumns=True)


def resolve(found: DataFrame, texts: dict[str, DataFrame]) -> DataFrame:
    """Members with name_normalized, name_resolved, name_final and resolution_method. Titled names are looked for in texts (id, text), in the order given; the first that tells a name wins."""
    d = found.withColumn("name_normalized", normal_name(F.col("display"))).withColumn("_titled", F.col("titled") | peerage(F.col("display"), F.coalesce("full_title", F.lit(""))))
    steps = []
    for method, t in texts.items():
        c = f"_{method}"
        d = d.join(t.select(F.col("id").alias(f"{c}_id"), name_from_bio(F.col("text")).alias(c)), F.col("id") == F.col(f"{c}_id"), "left").drop(f"{c}_id")
        steps.append(F.when(F.col("_titled") & F.col(c).isNotNull(), F.struct(F.col(c).alias("name"), F.lit(method).alias("method"))))
    got = F.coalesce(*steps) if steps else F.lit(None).cast("struct<name:string,method:string>")
    d = d.withColumn("_got", got).drop(*[f"_{m}" for m in texts])
    return d.withColumns({"name_resolved": F.coalesce("_got.name", F.lit("")), "resolution_method": F.coalesce("_got.method", F.when(F.col("_titled"), "unresolved").otherwise("normalized")), "name_final": F.coalesce("_got.name", "name_normalized")}).drop("_got", "_titled")


def build(commons: DataFrame, lords: DataFrame, history: DataFrame, texts: dict[str, DataFrame], prose: DataFrame | None = None) -> DataFrame:
    """One row for each member, the latest membership, with the first and last word of the name."""
    d = resolve(members(commons, lords, history, prose), texts)
    one = latest(d, "id", "start", "display").withColumn("name_final", first_last(F.col("name_final")))
    return one.select("id", "name_final", F.col("display").alias("name_api_display"), F.col("full_title").alias("name_api_full_title"), "name_normalized", "name_resolved", "resolution_method", "party", "gender", "constituency", F.col("start").try_cast("date").alias("membership_start"), F.col("end").try_cast("date").alias("membership_end"))


def placed(gazetteer: DataFrame) -> DataFrame:
    """The gazetteer with place, each member's number in the order of names (by code point, then id), as its file is sorted. Ranges of names are sorted apart, so that no task has all of them."""
    ranged = gazetteer.repartitionByRange("name_final", "id").sortWithinPartitions("name_final", "id").withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("name_final", "id")))
    ranged = ranged.persist()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return ranged.join(F.broadcast(starts), "part").withColumn("place", (F.col("before") + F.col("at")).cast("int")).drop("part", "at", "before").orderBy("name_final", "id")


def aliases(gazetteer: DataFrame, name: str = "name_final", extra: str | None = None, tag: str | None = None) -> DataFrame:
    """(name, alias, tag, kind): each person's name, listed aliases, surname unless it is a word too, and first and last name; kind tells them apart."""
    parts = F.split(F.trim(name), r"\s+")
    surname = F.element_at(parts, -1)
    own = [c for c in (extra, tag) if c]
    g = gazetteer.where(F.length(F.trim(name)) > 0).select(F.trim(name).alias("name"), parts.alias("parts"), surname.alias("surname"), *own)
    listed = list_of(F.col(extra)) if extra else F.array().cast("array<string>")
    t = F.coalesce(F.nullif(F.trim(F.col(tag)), F.lit("")), tag_of(F.col("name"))) if tag else tag_of(F.col("name"))
    several = F.size("parts") >= 2
    made = F.array(F.struct(F.lit(0).alias("kind"), F.col("name").alias("alias")))
    made = F.concat(made, F.transform(listed, lambda a: F.struct(F.lit(1).alias("kind"), a.alias("alias"))))
    made = F.concat(made, F.when(several & ~F.lower("surname").isin(AMBIGUOUS_SURNAMES), F.array(F.struct(F.lit(2).alias("kind"), F.col("surname").alias("alias")))).otherwise(F.array()))
    made = F.concat(made, F.when(F.size("parts") > 2, F.array(F.struct(F.lit(3).alias("kind"), F.concat_ws(" ", F.element_at("parts", 1), F.col("surname")).alias("alias")))).otherwise(F.array()))
    return g.select("name", t.alias("tag"), F.explode(made).alias("m")).select("name", F.col("m.alias").alias("alias"), "tag", F.col("m.kind").alias("kind"))


def name_table(alias_rows: DataFrame) -> DataFrame:
    """(alias, tag): one tag for each lower-case name. Full names come before aliases; of full names the last wins, of aliases the first, by the person's name."""
    a = alias_rows.withColumn("alias", F.lower("alias")).withColumn("full", F.col("kind") == 0)
    by = lambda order: Window.partitionBy("alias").orderBy(*order)
    full = a.where("full").withColumn("r", F.row_number().over(by([F.col("name").desc(), F.col("tag")]))).where("r = 1")
    rest = a.where("NOT full").withColumn("r", F.row_number().over(by(["name", "kind", "tag"]))).where("r = 1").join(full.select("alias"), "alias", "left_anti")
    return full.select("alias", "tag").unionByName(rest.select("alias", "tag"))


def gated_words(alias_rows: DataFrame) -> DataFrame:
    """(word, tag): each word of a full name, and one-word aliases."""
    words = alias_rows.where("kind = 0").select(F.explode(F.split(F.lower("name"), r"\s+")).alias("word"), "tag")
    single = alias_rows.where(~F.col("alias").contains(" ")).select(F.lower("alias").alias("word"), "tag")
    return reduce(DataFrame.unionByName, [words, single]).distinct()

"""Smaller compositions: capping people, representation, agreement studies, topics, archived pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.html import main_text, published, title
from presslens.functions.text import sentences, strip_fragment, word_tokens
from presslens.functions.values import any_timestamp, iso, stamp
from presslens.operators.aggregates import agreement, breakdown, cap_sweep, describe, group_count, term_totals
from presslens.operators.dedupe import keep_first
from presslens.operators.density import density_clusters
from presslens.operators.filters import year_or_fallback
from presslens.operators.joins import compare, count_names, few
from presslens.operators.sampling import cap, sample

#: Words that tell a gender.
GENDER_TERMS = {"male": ["man", "men", "male", "boy", "he", "him", "his"], "female": ["woman", "women", "female", "girl", "she", "her", "hers"]}
#: Guesses of a gender that count as one.
GENDER_CLASSES = {"male": ["male", "mostly_male"], "female": ["female", "mostly_female"]}
CAPS = [10, 20, 30, 50, 75, 100, 150, 200]


def normalise(df: DataFrame, topic: str, person: str, gender: str, key: str, most: int = 50, seed: int = 42) -> dict[str, DataFrame]:
    """At most ``most`` sentences of each person in each topic, with reports of what that changes."""
    capped = cap(df, [topic, person], key, most, seed)
    counts = group_count(df, [person, gender])
    return {"capped": capped, "counts": counts, "describe": describe(counts, "n"), "sweep": cap_sweep(counts, "n", CAPS), "compare": compare(breakdown(df, topic, gender, person), breakdown(capped, topic, gender, person), topic)}


def gender_class(c):
    return F.when(c.isin(GENDER_CLASSES["male"]), "male").when(c.isin(GENDER_CLASSES["female"]), "female").otherwise("unknown")


def gender_terms(df: DataFrame, text: str, lists: dict[str, list[str]] = GENDER_TERMS) -> DataFrame:
    return term_totals(df, word_tokens(F.col(text)), lists)


def name_frequency(docs: DataFrame, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    return count_names(docs, F.col(text), names, name)


def named_gender(entities: DataFrame, first_names: DataFrame) -> DataFrame:
    """Percent of each gender among the people named, each name once in a document: a full name or a second word that was seen before doesn't count again."""
    e = entities.where("label = 'PERSON'").select("doc_id", "start", F.split(F.trim("text"), r"\s+").alias("w"), F.trim("text").alias("name"))
    second = F.when(F.size("w") > 1, F.element_at("w", 2))
    ordered = e.withColumn("second", second).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "name", "second"))).alias("all"))

    def step(state, x):
        new = ~F.array_contains(state["seen"], x["name"]) & ~F.coalesce(F.array_contains(state["seen"], x["second"]), F.lit(False))
        seen = F.concat(state["seen"], F.array(x["name"]), F.when(x["second"].isNotNull(), F.array(x["second"])).otherwise(F.array().cast("array<string>")))
        return F.struct(F.when(new, F.concat(state["kept"], F.array(x["name"]))).otherwise(state["kept"]).alias("kept"), F.when(new, seen).otherwise(state["seen"]).alias("seen"))

    none = F.array().cast("array<string>")
    kept = ordered.select("doc_id", F.explode(F.aggregate("all", F.struct(none.alias("kept"), none.alias("seen")), step, lambda s: s["kept"])).alias("name"))
    first = kept.select(F.lower(F.element_at(F.split("name", r"\s+"), 1)).alias("first"))
    found = first.join(first_names.groupBy(F.lower("first").alias("first")).agg(F.max("gender").alias("guess")), "first", "left")
    n = found.groupBy(gender_class(F.col("guess")).alias("gender")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def agreement_study(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """agreement() of each pair of annotators, a row each."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [agreement(df, a, b).withColumn("pair", F.lit(f"{a}/{b}")) for a, b in pairs])


def labelling_sheet(docs: DataFrame, text: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n sentences drawn from all, with index article_1, article_2, ... and an empty label."""
    s = docs.select(F.col(key).alias("_k"), F.posexplode(sentences(F.col(text))).alias("_i", "text")).withColumn("_key", F.concat_ws(":", "_k", "_i"))
    drawn = sample(s, "_key", n, seed)
    return drawn.withColumn("index", F.concat(F.lit("article_"), F.row_number().over(Window.orderBy("_k", "_i")).cast("string"))).select("index", "text", F.lit(0).alias("label"))


def nearest_topic(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, most: float | None = None) -> DataFrame:
    """(key, topic_id, distance): the nearest centroid (topic_id, c), which are few; farther than ``most`` is the outlier -1."""
    apart = lambda c: F.sqrt(F.aggregate(F.zip_with(vector, c, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    held = few(centroids, 10_000).agg(F.collect_list(F.struct("topic_id", "c")).alias("all"))  # one row for all, so that each vector finds its own in place
    near = F.array_min(F.transform("all", lambda x: F.struct(apart(x["c"]).alias("distance"), x["topic_id"].alias("topic_id"))))
    best = vectors.select(key, vector).join(F.broadcast(held), how="cross").select(key, near.alias("b"))
    topic = F.when(F.col("b.distance") > most, -1).otherwise(F.col("b.topic_id")) if most is not None else F.col("b.topic_id")
    return best.select(key, topic.alias("topic_id"), F.col("b.distance").alias("distance"))


def density_topics(vectors: DataFrame, key: str, vector: str, eps: float, least: int = 10, dims: int = 5) -> DataFrame:
    """(key, topic_id): topics as dense regions of the vectors reduced to a few dimensions, numbered from 0 by size, then smallest key; -1 is the outlier."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    reduced = PCA(k=dims, inputCol="_v", outputCol="_r").fit(v).transform(v).select(key, vector_to_array("_r").alias("r"))
    return numbered_topics(density_clusters(reduced, key, "r", dims, eps, least), key)


def numbered_topics(found: DataFrame, key: str) -> DataFrame:
    """(key, topic_id) of clusters: the largest is 0, -1 stands for none."""
    sizes = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    ranked = sizes.withColumn("topic_id", (F.row_number().over(Window.orderBy(F.col("_n").desc(), "cluster")) - 1).cast("int")).drop("_n")
    return found.join(ranked, "cluster", "left").select(key, F.coalesce("topic_id", F.lit(-1)).alias("topic_id"))


def fit_topics(vectors: DataFrame, vector: str, k: int = 10, dims: int = 5, seed: int = 42) -> DataFrame:
    """vectors with topic_id: reduced to a few dimensions and clustered, both distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = vectors.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    reduced = PCA(k=dims, inputCol="_v", outputCol="_r").fit(v).transform(v)
    return KMeans(k=k, seed=seed, featuresCol="_r", predictionCol="topic_id").fit(reduced).transform(reduced).drop("_v", "_r")


def topic_labels(df: DataFrame, topic: str, text: str, k: int = 4) -> DataFrame:
    """(topic, label): number and top words of each topic by class-based tf-idf, joined with _."""
    t = df.where(F.col(topic).isNotNull()).select(topic, F.explode(word_tokens(F.col(text))).alias("word")).groupBy(topic, "word").agg(F.count(F.lit(1)).alias("tf"))
    df_ = t.groupBy("word").agg(F.sum("tf").alias("all"))
    mean = t.agg((F.sum("tf") / F.countDistinct(topic)).alias("mean"))
    s = t.join(df_, "word").crossJoin(F.broadcast(mean)).withColumn("score", F.col("tf") * F.log(1 + F.col("mean") / F.col("all")))
    best = keep_first(s, [topic], [F.col("score").desc(), F.col("word")], k)
    words = best.groupBy(topic).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "word"))), lambda x: x["word"]), "_").alias("words"))
    return words.select(topic, F.concat_ws("_", F.col(topic).cast("string"), "words").alias("label"))


def ingest(pages: DataFrame, done: DataFrame | None = None, prefix: str = "", first_year: int = 1990, last_year: int = 2024, url: str = "url", html: str = "html", captured: str | None = None) -> DataFrame:
    """crawl records of landed pages: each address once (the earliest capture), addresses done before left out, with date, text, title and a status that tells why a page isn't a success."""
    p = pages.where(F.col(url).startswith(prefix)).withColumn("original_url", strip_fragment(F.col(url)))
    when = F.col(captured) if captured else F.lit(None).cast("string")
    p = keep_first(p.withColumn("wayback_timestamp", when), ["original_url"], [F.col("wayback_timestamp").asc_nulls_last(), F.col(url)])
    if done is not None:
        p = p.join(done.select(F.col(url).alias("original_url")).distinct(), "original_url", "left_anti")
    p = p.withColumn("_d", published(F.col(html))).withColumn("_t", any_timestamp(F.col("_d.raw")))
    year = year_or_fallback(F.col("_t"), F.col("wayback_timestamp"))
    text = main_text(F.col(html))
    status = F.when(F.coalesce(~year.between(first_year, last_year), F.lit(False)), "out_of_range").when(text.isNull(), "no_text").otherwise("success")
    return p.select("original_url", "wayback_timestamp", iso(stamp(F.col("wayback_timestamp"))).alias("wayback_datetime_utc"), F.col("_d.raw").alias("published_raw"), iso(F.col("_t")).alias("published_datetime"), F.col("_d.source").alias("published_source"), F.struct(text.alias("text"), title(F.col(html)).alias("title")).alias("extraction"), status.alias("status"))


def limited(records: DataFrame, group: str, order: str, per_group: int, total: int) -> DataFrame:
    """The first records of each group, then the first of all."""
    return keep_first(records, [group], [F.col(order)], per_group).orderBy(group, order).limit(total)


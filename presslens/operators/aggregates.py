"""Counts, profiles and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.values import share


def group_count(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Rows of each key; rows with a null in a key don't count."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def top_groups(df: DataFrame, keys: list[str], k: int, out: str = "n") -> DataFrame:
    return group_count(df, keys, out).orderBy(F.col(out).desc(), *keys).limit(k)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, percent) for every column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls"), F.col("_n").alias("n")) for i, c in enumerate(df.columns)]))
    return one.select(rows.alias("r")).select("r.column", "r.nulls", F.round(share(F.col("r.nulls") * 100, F.col("r.n")), 6).alias("percent"))


def describe(df: DataFrame, c: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles (linear between values)."""
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    r = lambda x, n: F.round(x.cast("double"), 6).alias(n)
    return df.agg(F.count(c).alias("count"), r(F.avg(c), "mean"), r(F.stddev_samp(c), "std"), r(F.min(c), "min"), q.alias("q"), r(F.max(c), "max")).select("count", "mean", "std", "min", r(F.col("q")[0], "q25"), r(F.col("q")[1], "q50"), r(F.col("q")[2], "q75"), "max")


def top_share(counts: DataFrame, n: str, k: int, order: list[str]) -> DataFrame:
    """(top, total, share) of the k largest counts. The largest are found by a top-k, not by sorting all rows in one task."""
    top = counts.orderBy(F.col(n).desc(), *order).limit(k).agg(F.sum(n).alias("top"))
    return top.crossJoin(counts.agg(F.sum(n).alias("total"))).select("top", "total", F.round(share(F.col("top"), F.col("total")), 6).alias("share"))


def cap_sweep(counts: DataFrame, n: str, caps: list[int], k: int = 10) -> DataFrame:
    """For each cap: rows kept, percent kept, percent of the k largest groups, groups that are capped. Counts are first gathered by value, which leaves few rows however many groups there are."""
    sizes = counts.groupBy(F.col(n).alias("size")).agg(F.count(F.lit(1)).alias("groups"))
    w = Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("groups").over(w), F.lit(0))).withColumn("in_top", F.greatest(F.lit(0), F.least(F.col("groups"), F.lit(k) - F.col("before"))))
    by_cap = sizes.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).withColumn("cut", F.least("size", "cap"))
    a = by_cap.groupBy("cap").agg(F.sum(F.col("cut") * F.col("groups")).alias("kept"), F.sum(F.col("size") * F.col("groups")).alias("total"), F.sum(F.col("cut") * F.col("in_top")).alias("top"), F.sum(F.when(F.col("size") > F.col("cap"), F.col("groups")).otherwise(0)).alias("capped"))
    return a.select(F.col("cap").cast("long").alias("cap"), "kept", F.bround(share(F.col("kept") * 100, F.col("total")), 1).alias("kept_pct"), F.bround(share(F.col("top") * 100, F.col("kept")), 1).alias("top_pct"), "capped")


def breakdown(df: DataFrame, topic: str, gender: str, person: str, total: bool = False) -> DataFrame:
    """Rows, rows of each gender, percent F and different people, for each topic; with total also for all topics, under a null topic."""
    g = df.rollup(topic) if total else df.groupBy(topic)
    a = g.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(gender) == "M").alias("m"), F.count_if(F.col(gender) == "F").alias("f"), F.countDistinct(person).alias("people"))
    return a.withColumn("pct_f", F.round(share(F.col("f") * 100, F.col("total")), 6))


def by_gender(df: DataFrame, topic: str, gender: str, values: dict[str, Column]) -> DataFrame:
    """male_ and female_ columns of the aggregates, 0 where a topic has no such rows."""
    cols = []
    for word, g in (("male", "M"), ("female", "F")):
        for name, x in values.items():
            cols.append(F.coalesce(F.max(F.when(F.col(gender) == g, x)), F.lit(0)).alias(f"{word}_{name}"))
    return df.groupBy(topic).agg(*cols)


def term_totals(df: DataFrame, tokens: Column, lists: dict[str, list[str]]) -> DataFrame:
    """How often the words of each list occur in all."""
    among = lambda words: F.size(F.filter(tokens, lambda t: t.isin(words)))
    return df.agg(*[F.coalesce(F.sum(among(words)), F.lit(0)).cast("long").alias(name) for name, words in lists.items()])


def agreement(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of both classes, macro and weighted means, Cohen's kappa and the 2 x 2 table of two 0/1 columns. A ratio over nothing is 0."""
    d = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    cell = lambda t, g, n: F.count_if((F.col(truth) == t) & (F.col(guess) == g)).alias(n)
    a = d.agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    f1 = lambda tp, x, y: share(2 * F.col(tp), 2 * F.col(tp) + F.col(x) + F.col(y))
    out = a.withColumns({"n": n, "accuracy": share(F.col("tp") + F.col("tn"), n), "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "f1": f1("tp", "fp", "fn"), "f1_zero": f1("tn", "fn", "fp")})
    chance = share((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp")), F.col("n") * F.col("n"))
    out = out.withColumn("kappa", F.when(chance == 1, F.lit(0.0)).otherwise(share(F.col("accuracy") - chance, 1 - chance)))
    out = out.withColumns({"macro_f1": (F.col("f1") + F.col("f1_zero")) / 2, "weighted_f1": share(F.col("f1") * (F.col("tp") + F.col("fn")) + F.col("f1_zero") * (F.col("tn") + F.col("fp")), F.col("n"))})
    return out.select("n", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "f1_zero", "macro_f1", "weighted_f1", "kappa")])

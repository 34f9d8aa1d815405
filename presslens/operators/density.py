"""Clusters of points that lie densely, with outliers, for vectors of a few dimensions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.operators.components import connected_components
from presslens.session import checkpointed


def density_clusters(points: DataFrame, key: str, vector: str, dims: int, eps: float, least: int) -> DataFrame:
    """(key, cluster) for every row of points: the smallest key of the cluster's core points, null for an outlier.

    A point with at least ``least`` points within eps, itself included, is a core point; core points within eps of each other share a cluster, and other points within eps of a core point join
    the cluster of the smallest key. Points meet in a grid of cells of width eps, each point visiting its 3^dims neighbours: dims is meant to be 5 at most. Pairs within eps are written out, so eps has to be small
    beside the spread of the points. Null vectors, and those of another length or with a null or a NaN, are outliers.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    own = points.where(sound & F.col(key).isNotNull()).select(F.col(key).alias("a"), v.alias("v"))
    own = checkpointed(own.withColumn("cell", F.transform("v", lambda x: F.floor(x / F.lit(float(eps))).cast("long"))))
    steps = F.array(*[F.array(*[F.lit(x).cast("long") for x in step]) for step in product((-1, 0, 1), repeat=dims)])
    visits = own.withColumn("step", F.explode(steps)).select("a", "v", F.zip_with("cell", "step", lambda c, s: c + s).alias("cell"))
    met = visits.join(own.select(F.col("a").alias("b"), F.col("v").alias("w"), "cell"), "cell")
    apart = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = checkpointed(met.where(apart <= eps).select("a", "b"))
    core = checkpointed(near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a"))
    beside = near.join(core.select(F.col("a").alias("b")), "b")
    links = beside.where("a < b").join(core, "a", "left_semi").select("a", "b")
    roots = connected_components(links).select(F.col("node").alias("b"), "root")
    rooted = checkpointed(core.select(F.col("a").alias("b")).join(roots, "b", "left").withColumn("root", F.coalesce("root", "b")))
    cores = rooted.select(F.col("b").alias("a"), F.col("root").alias("cluster"))
    border = beside.join(core, "a", "left_anti").join(rooted, "b").groupBy("a").agg(F.min("root").alias("cluster"))
    found = cores.unionByName(border)
    return points.select(key).join(found, F.col(key) == F.col("a"), "left").select(key, "cluster")

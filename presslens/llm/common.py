"""What the training-data operators share: cutting lineage, word shingles, splitting hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.session import shared_dir

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: The folders that stored() and folder() made, by application, for clean().
_made: dict[str, list[str]] = {}


def set_aside(docs: DataFrame, *new: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed c0, c1, ... so that every other name is free, and {name: cN} of the columns to give back: all but those named as in new, whatever the case."""
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    replaced = {n.lower() for n in new}
    return out, {c: f"c{i}" for i, c in enumerate(docs.columns) if c.lower() not in replaced}


def renamed(docs: DataFrame, name: str) -> str:
    """What set_aside() calls the column of docs with this name."""
    if name in docs.columns:
        return f"c{docs.columns.index(name)}"
    return f"c{[c.lower() for c in docs.columns].index(name.lower())}"


def given_back(own: dict[str, str]) -> list[Column]:
    return [F.col(c).alias(name) for name, c in own.items()]


def text_beside(docs: DataFrame, rows: DataFrame, own: dict[str, str], text_col: str) -> tuple[DataFrame, int]:
    """The own columns of rows, and the place of the text as a string: among them, or after them if it isn't one of them or no string."""
    cols, c = list(own.values()), renamed(docs, text_col)
    if c in cols and dict(rows.dtypes)[c] == "string":
        return rows.select(*cols), cols.index(c)
    return rows.select(*cols, F.col(c).cast("string").alias("text")), len(cols)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what a worker makes of one at a time stays small."""
    for b in batches:
        for start in range(0, max(b.num_rows, 1), rows):
            yield b.slice(start, rows)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clean() removes."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(at)
    return at


def clean(spark: SparkSession) -> None:
    """Remove the tables and folders made by stored() and folder() in this application. Call it when the results have been read: they are read from there."""
    jvm = spark.sparkContext._jvm
    for at in _made.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder as a compressed table: later reads survive the loss of any executor, and take only the columns they need."""
    at = folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def few(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """keys, to be broadcast if its rows, of a few numbers each, are counted and at most so many; joined by a shuffle if not."""
    return F.broadcast(keys) if keys.count() <= most else keys


def split_hot(df: DataFrame, keys: list[str], row: Column, most: int) -> DataFrame:
    """Deal the rows of each key to tasks of at most about 2 * most rows such that any two rows of a key meet in exactly one task.

    A key of n rows gets g = ceil(n / most) parts; a task is an unordered pair of parts. Adds task_i <= task_j and
    part (the row's own part, task_i or task_j). Pairs of rows of equal part belong to the task (part, part) only, which the reader has to heed.
    Keys of up to ``most`` rows, nearly all, get the one task (0, 0) and no copies.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_n") / F.lit(float(most))).cast("int").alias("_g"))
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
        same = c if same is None else same & c
    out = df.join(hot, same, "left").drop(*[f"_hot_{k}" for k in keys])
    out = out.withColumn("_g", F.coalesce("_g", F.lit(1))).withColumn("part", F.pmod(F.xxhash64(row, F.lit(7)), F.col("_g")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return out.withColumn("task_i", F.least("part", "_o")).withColumn("task_j", F.greatest("part", "_o")).drop("_o", "_g")

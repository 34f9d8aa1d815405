"""The same operators over streams: the DataFrame functions work unchanged; what state needs is added here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from presslens.session import scratch


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def append(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Whatever is there and new is written once, and the query ends; a restart goes on where it stopped."""
    return df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def first_seen(df: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once, the first that arrives. Keys are forgotten when the watermark has passed, so that the state stays bounded."""
    return df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay).dropDuplicatesWithinWatermark([key]).drop("_time")


def running_counts(df: DataFrame, key: str) -> DataFrame:
    """For update mode: rows of each key so far."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(df: DataFrame, time: str, width: str, delay: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Rows of each window and key; late rows count until the watermark passes the window's end."""
    t = df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    w = F.window("_time", width, slide) if slide else F.window("_time", width)
    return t.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, delay: str, *keys: str) -> DataFrame:
    t = df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    w = F.session_window("_time", gap)
    return t.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def score_stream(df: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any stateless operator of the library on a stream."""
    return operator(df)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """The result over everything that is available, read back from a table in the shared folder; nothing is gathered by the driver. In complete mode the last batch is the result; in update mode the rows of all batches are given, with their number in batch."""
    at = scratch(df.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    w = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint")
    (w.format("parquet").start(f"{at}/rows") if mode == "append" else w.foreachBatch(write).start()).awaitTermination()
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())]) if mode != "append" else df.schema).parquet(f"{at}/rows")
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("batch").alias("last")), F.col("batch") == F.col("last")).drop("last")
    return rows if mode == "update" else rows.drop("batch")

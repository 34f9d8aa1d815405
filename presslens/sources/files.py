"""Reading article tables, lexicons and texts from files, and writing results."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.functions.text import file_safe, slug


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; fields may hold line ends and doubled quotes. Without a schema all columns are strings: nothing is scanned to guess types."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep)
    return (r.schema(schema) if schema else r).csv(path)


def read_tsv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, "\t")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An array of records."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines and lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_parts(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """The union of those CSV parts that are there."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"none of {paths}")
    return read_csv(spark, there, schema)


def read_topics(spark: SparkSession, directory: str, schema: str | None = None, skip: list[str] | None = None) -> DataFrame:
    """A folder of one CSV for each topic; topic is the file's stem. Topics to skip aren't read into rows; empty ones have none."""
    if not _exists(spark, f"{directory}/*.csv"):
        raise FileNotFoundError(f"no CSV in {directory}")
    found = read_csv(spark, f"{directory}/*.csv", schema).withColumn("topic", F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1), F.lit("+"), F.lit("%2B"))))
    return found.where(~F.col("topic").isin(skip)) if skip else found


def read_zip_member(spark: SparkSession, path: str, member: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header in ZIP files, its fields as in read_csv(). Each archive is opened where its bytes are. Without a schema all columns are strings, named by the first archive's header."""

    def rows(content: bytes) -> Iterator[list[str | None]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from csv.reader(io.TextIOWrapper(z.open(member), "utf-8-sig", newline=""))

    archives = spark.read.format("binaryFile").load(path).select("content")
    if schema is None:
        names = next(rows(bytes(archives.first().content)))
        schema = ", ".join(f"`{n}` string" for n in names)
    kinds = spark.createDataFrame([], schema).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                parsed = rows(content.as_py())
                at = {n: i for i, n in enumerate(next(parsed, []))}
                while held := list(itertools.islice(parsed, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([(r[at[n]] or None) if n in at and at[n] < len(r) else None for r in held], pa.string()) for n in kinds.names], names=kinds.names)

    found = archives.mapInArrow(parse, ", ".join(f"`{n}` string" for n in kinds.names))
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds])


def read_lines(spark: SparkSession, path: str, name: str = "word") -> DataFrame:
    """The non-empty lines of a text."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Texts parted by blank lines, line ends inside as spaces."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.trim(F.regexp_replace("value", r"\s*\n+\s*", " ")).alias("text")).where("text <> ''")


#: How CSV is written: doubled quotes, and white space at a field's ends as it is, which Spark's writer would strip.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, one_file: bool = False, quote_all: bool = False, mode: str = "overwrite") -> None:
    (df.coalesce(1) if one_file else df).write.mode(mode).options(**CSV).option("quoteAll", quote_all).csv(path)


def write_by_suffix(df: DataFrame, path: str) -> None:
    """JSON records if the path says so, else CSV."""
    df.write.mode("overwrite").json(path) if path.endswith(".json") else write_csv(df, path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_topics(df: DataFrame, path: str, topic: str = "topic") -> None:
    """A folder for each topic, its name fit for a file system."""
    df.withColumn("_folder", file_safe(F.col(topic))).repartition("_folder").write.mode("overwrite").partitionBy("_folder").parquet(path)


def write_topic_files(df: DataFrame, path: str, topic: str = "topic") -> None:
    """One CSV file for each topic, named by it, as read_topics() reads them. A topic is one task's work: its file is one. Files are renamed when all are written, which takes their names alone."""
    spark, folder = df.sparkSession, file_safe(F.col(topic))
    df.withColumn("_folder", folder).repartition("_folder").drop(topic).write.mode("overwrite").partitionBy("_folder").options(**CSV).csv(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(at):
        name = folder.getPath().getName()
        if name.startswith("_folder="):
            for part in fs.listStatus(folder.getPath()):
                fs.rename(part.getPath(), at.suffix(f"/{unquote(name[8:])}.csv"))
            fs.delete(folder.getPath(), True)


def write_people(df: DataFrame, path: str, person: str = "person") -> None:
    df.withColumn("person_slug", slug(F.col(person))).repartition("person_slug").write.mode("overwrite").partitionBy("person_slug").parquet(path)


def save_relations(relations: dict[str, DataFrame], path: str) -> None:
    """Each relation of a run as a table of its own."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_relations(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def page_keys(pages: DataFrame, url: str = "url", stamp: str = "stamp") -> DataFrame:
    """pages with key, the SHA-1 of url|stamp, under which a page's bytes are kept."""
    return pages.withColumn("key", F.sha1(F.concat_ws("|", url, stamp).cast("binary")))


def write_pages(pages: DataFrame, path: str, body: str = "html", url: str = "url", stamp: str = "stamp") -> None:
    """Each page's bytes once under its key; a page without a body has none."""
    page_keys(pages, url, stamp).where(F.col(body).isNotNull()).select("key", F.col(body).cast("binary").alias("body")).dropDuplicates(["key"]).write.mode("append").parquet(path)


def stem(path: str) -> str:
    return Path(path).stem

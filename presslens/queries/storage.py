"""Queries over sources and sinks: a table is written through a sink, read back through a source, and compared with itself."""

import io
import zipfile

from pyspark.sql import functions as F

from presslens.session import scratch
from presslens.sources import files
from presslens.queries import query, table

DOCS_SQL = "SELECT doc_id, source, md5(coalesce(text, '')) AS digest FROM documents"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "text")


def _digests(df):
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


@query("src01_csv", DOCS_SQL)
def csv_round_trip(spark, d):
    """SRC01, SNK01: line ends, quotes and commas inside fields come back."""
    at = scratch(spark, "csv")
    files.write_csv(_docs(spark, d), at)
    return _digests(files.read_csv(spark, at, "doc_id long, source string, text string"))


@query("src02_tsv", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def tsv_round_trip(spark, d):
    at = scratch(spark, "tsv")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", True).option("sep", "\t").csv(at)
    return files.read_tsv(spark, at, "c_custkey long, c_mktsegment string, c_acctbal double")


@query("src03_json", "SELECT c_custkey, c_name FROM customer")
def json_arrays(spark, d):
    """A file for each nation, an array of its customers."""
    at = scratch(spark, "json")
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name"))).alias("value"))
    c.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return files.read_json(spark, at, "c_custkey long, c_name string")


@query("src04_json_lines", f"{DOCS_SQL} UNION ALL {DOCS_SQL} WHERE doc_id % 2 = 0")
def json_lines(spark, d):
    """SRC04, SNK03: what is appended is read too; blank lines and lines that are no record are skipped."""
    at = scratch(spark, "lines")
    files.append_json(_docs(spark, d), at)
    files.append_json(_docs(spark, d).where("doc_id % 2 = 0"), at)
    _docs(spark, d).select(F.when(F.col("doc_id") % 2 == 0, "").otherwise("{no record").alias("value")).write.mode("append").text(at)
    return _digests(files.read_json_lines(spark, at, "doc_id long, source string, text string"))


@query("src05_parts", f"{DOCS_SQL} WHERE doc_id % 3 < 2")
def parts(spark, d):
    """Of three parts the last isn't there."""
    at = scratch(spark, "parts")
    for k in (0, 1):
        files.write_csv(_docs(spark, d).where(F.col("doc_id") % 3 == k), f"{at}/part{k}.csv")
    return _digests(files.read_parts(spark, [f"{at}/part{k}.csv" for k in range(3)], "doc_id long, source string, text string"))


@query("src06_topics", "SELECT c_custkey, c_name, 'segment_' || lower(c_mktsegment) || '_' AS topic FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def topics(spark, d):
    """SRC06, SNK04, FLT19: a file for each topic, its name fit for a file system; listed topics are skipped."""
    at = scratch(spark, "topics")
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lit("segment "), F.lower("c_mktsegment"), F.lit("?")).alias("topic"))
    files.write_topic_files(c, at)
    return files.read_topics(spark, at, "c_custkey long, c_name string", skip=["segment_building_", "segment_machinery_"])


@query("src07_zip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || chr(10) || '\"' || n_regionkey || '\",' AS note FROM nation")
def zip_member(spark, d):
    """Fields with line ends and quotes; the 25 nations are zipped by the driver."""
    import csv

    text = io.StringIO()
    rows = csv.writer(text)
    rows.writerow(["note", "n_nationkey"])
    rows.writerows((f'{r.n_name}\n"{r.n_regionkey}",', r.n_nationkey) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data/nations.csv", text.getvalue())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "zip"))
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    return files.read_zip_member(spark, path.toString(), "data/nations.csv", "n_nationkey long, note string")


@query("src08_lines", "SELECT trim(p_name) AS word, count(*) AS n FROM part WHERE trim(p_name) <> '' GROUP BY 1")
def lines(spark, d):
    at = scratch(spark, "words")
    table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit(""), F.lit("   ")))).write.text(at)
    return files.read_lines(spark, at).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("src09_paragraphs", "SELECT p_name || ' of ' || p_brand AS text, count(*) AS n FROM part GROUP BY 1")
def paragraphs(spark, d):
    """Texts of two lines, parted by blank lines."""
    at = scratch(spark, "novel")
    table(spark, d, "part").select(F.concat("p_name", F.lit(" of\n"), "p_brand")).write.option("lineSep", "\n\n").text(at)
    return files.read_paragraphs(spark, at).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("snk02_by_suffix", "SELECT doc_id, source, md5(coalesce(text, '')) AS digest, suffix FROM documents, (VALUES ('csv'), ('json')) AS t(suffix)")
def by_suffix(spark, d):
    at = scratch(spark, "suffix")
    for suffix in ("csv", "json"):
        files.write_by_suffix(_docs(spark, d), f"{at}/out.{suffix}")
    kinds = "doc_id long, source string, text string"
    read = {"csv": files.read_csv(spark, f"{at}/out.csv", kinds), "json": files.read_json_lines(spark, f"{at}/out.json", kinds)}
    both = [_digests(df).withColumn("suffix", F.lit(s)) for s, df in read.items()]
    return both[0].unionByName(both[1])


@query("snk05_people", "SELECT lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')) AS person, c_custkey FROM customer WHERE c_custkey <= 40")
def people(spark, d):
    """Forty people, a folder each."""
    at = scratch(spark, "people")
    files.write_people(table(spark, d, "customer").where("c_custkey <= 40").select(F.col("c_name").alias("person"), "c_custkey"), at)
    return spark.read.parquet(at).select(F.col("person_slug").alias("person"), "c_custkey")


@query("snk06_quoted_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, '\"' || n_nationkey || '\",\"' || n_name || '\"' AS line FROM nation")
def quoted_csv(spark, d):
    """Every field is quoted, numbers too: the lines of the file as they are."""
    at = scratch(spark, "quoted")
    files.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), at, one_file=True, quote_all=True)
    read = spark.read.text(at).where(~F.col("value").startswith('"n_nationkey')).select(F.col("value").alias("line"))
    return read.select(F.regexp_extract("line", '^"([0-9]+)"', 1).alias("n_nationkey"), "line")


@query("snk07_relations", "SELECT 'regions' AS relation, count(*) AS n FROM region UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'customers', count(*) FROM customer")
def relations(spark, d):
    at = scratch(spark, "run")
    files.save_relations({n: table(spark, d, t) for n, t in (("regions", "region"), ("nations", "nation"), ("customers", "customer"))}, at)
    found = files.load_relations(spark, at, ["regions", "nations", "customers"])
    counts = [df.agg(F.lit(n).alias("relation"), F.count(F.lit(1)).alias("n")) for n, df in found.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("snk08_pages", "SELECT sha1(url || '|' || (2000 + page_id % 30)) AS key, md5(max(html)) AS digest FROM pages WHERE html IS NOT NULL AND url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT html) = 1")
def page_bytes(spark, d):
    """Pages are kept once under their key; keys that stand for different pages are left out here, since any of them may be kept."""
    at = scratch(spark, "pages")
    p = table(spark, d, "pages").where("url IS NOT NULL AND html IS NOT NULL").withColumn("stamp", (F.lit(2000) + F.col("page_id") % 30).cast("string"))
    files.write_pages(p, at)
    one = files.page_keys(p).groupBy("key").agg(F.countDistinct("html").alias("n")).where("n = 1")
    return spark.read.parquet(at).join(one, "key", "left_semi").select("key", F.md5("body").alias("digest"))


@query("str01_append_resume", "SELECT event_id, event_type FROM events")
def append_resume(spark, d):
    """Run twice: the second finds nothing new and writes nothing again."""
    from presslens.queries.annotated import EVENT_SCHEMA
    from presslens.streaming import streams

    at = scratch(spark, "append")
    for _ in range(2):
        events = streams.read_stream(spark, f"{d}/events*.parquet", EVENT_SCHEMA).select("event_id", "event_type")
        streams.append(events, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/rows")

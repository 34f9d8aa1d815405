"""Landed web and API responses as relations. Fetching is left to whatever lands them: a plan that sleeps between requests can't be re-run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.functions.values import text_or_object

MEMBER = "items array<struct<value:struct<id:bigint,nameDisplayAs:string,nameListAs:string,nameFullTitle:string,gender:string,latestParty:struct<name:string>,latestHouseMembership:struct<house:int,membershipFrom:string,membershipStartDate:string,membershipEndDate:string>>>>, totalResults bigint"


def complete_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """The pages, once it is known that together they hold as many items as the largest total that one of them names: a walk that stopped early is an error."""
    v = pages.select(F.from_json(body, MEMBER).alias("v")).agg(F.sum(F.size("v.items")).alias("held"), F.max("v.totalResults").alias("total")).first()
    if v.total is not None and (v.held or 0) < v.total:
        raise ValueError(f"{v.held} of {v.total} items: pages are missing")
    return pages


def api_members(pages: DataFrame, body: str = "body") -> DataFrame:
    """A row for each member of paged API responses."""
    v = pages.select(F.explode(F.from_json(body, MEMBER)["items"]).alias("i")).select("i.value.*")
    return v.select("id", F.col("nameDisplayAs").alias("display"), F.col("nameFullTitle").alias("full_title"), "gender", F.col("latestParty.name").alias("party"), F.col("latestHouseMembership.house").alias("house"), F.col("latestHouseMembership.membershipFrom").alias("constituency"), F.substring("latestHouseMembership.membershipStartDate", 1, 10).alias("start"), F.substring("latestHouseMembership.membershipEndDate", 1, 10).alias("end"))


def bulk_memberships(responses: DataFrame, body: str = "body") -> DataFrame:
    """(id, start, end) of each member's latest time in the lower house by bulk responses: a byte order mark before the JSON, one member or a list of them, one house or a list, dates as text or objects.

    A response that is XML is read as such. Members that tell no houses have their own dates.
    """
    bare = F.regexp_replace(body, "^\ufeff", "")
    xml, json = responses.where(F.ltrim(bare).startswith("<")), responses.where(~F.ltrim(bare).startswith("<"))
    several = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    m = json.select(F.explode(several(F.get_json_object(bare, "$.Members.Member"))).alias("m"))
    houses = F.get_json_object("m", "$.HouseMemberships.HouseMembership")
    h = m.select("m", houses.isNull().alias("own"), F.explode(several(F.coalesce(houses, F.col("m")))).alias("h"))
    h = h.where(F.col("own") | F.lower(F.coalesce(text_or_object(F.get_json_object("h", "$.House")), F.lit(""))).contains("commons"))
    date = lambda name: F.substring(text_or_object(F.get_json_object("h", f"$.{name}")), 1, 10)
    found = h.select(F.coalesce(F.get_json_object("m", "$.@Member_Id"), F.get_json_object("m", "$.MemberId")).try_cast("long").alias("id"), date("StartDate").alias("start"), date("EndDate").alias("end"))
    every = found.unionByName(_xml_memberships(xml, bare)).where("id IS NOT NULL")
    return every.groupBy("id").agg(F.max(F.struct("start", "end")).alias("s")).select("id", "s.start", "s.end")


def _xml_memberships(responses: DataFrame, bare: Column) -> DataFrame:
    """The same of XML responses: Member elements with an attribute Member_Id, and in them HouseMembership elements. An element that is missing or empty is null."""
    plain = F.regexp_replace(F.regexp_replace(bare, r"^\s*<\?xml[^>]*\?>", ""), r'\sxmlns(:\w+)?="[^"]*"|\s\w+:\w+="[^"]*"', "")
    m = responses.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<Member[\s>].*?</Member>"), 0)).alias("m"))
    houses = F.regexp_extract_all("m", F.lit(r"(?s)<HouseMembership[\s>].*?</HouseMembership>"), 0)
    h = m.select("m", (F.size(houses) == 0).alias("own"), F.explode(F.when(F.size(houses) > 0, houses).otherwise(F.array("m"))).alias("h"))
    h = h.where(F.col("own") | F.lower(F.regexp_extract("h", r"<House[\s>][^<]*|<House>([^<]*)", 0)).contains("commons"))
    date = lambda name: F.nullif(F.substring(F.regexp_extract("h", rf"<{name}>\s*([^<]*?)\s*</{name}>", 1), 1, 10), F.lit(""))
    return h.select(F.regexp_extract("m", r'Member_Id="(\d+)"', 1).try_cast("long").alias("id"), date("StartDate").alias("start"), date("EndDate").alias("end"))


def sitemap_locations(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """The <loc> texts of sitemaps or sitemap indexes, whatever their namespace."""
    bare = F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', "")
    return documents.select("*", F.posexplode(F.xpath(bare, F.lit("//loc/text()"))).alias("position", "location"))


def crawl_order(index: DataFrame, sitemaps: DataFrame, depth: int = 3) -> DataFrame:
    """Page addresses reached from an index through nested sitemaps (columns url, xml), depth levels at most."""
    found, at = None, sitemap_locations(index).select("location")
    for _ in range(depth):
        inner = at.join(sitemaps, at.location == sitemaps.url)
        leaves = at.join(sitemaps.select("url"), at.location == F.col("url"), "left_anti")
        found = leaves if found is None else found.unionByName(leaves)
        at = sitemap_locations(inner.select("xml")).select("location")
    return found.distinct()


def captures(listings: DataFrame, body: str = "body") -> DataFrame:
    """A web archive's capture listing, an array of rows under a header row, as relation: pages with status 200, of neighbours with one digest the first."""
    rows = F.from_json(body, "array<array<string>>")
    r = listings.select(rows.alias("r")).select(F.col("r")[0].alias("head"), F.posexplode(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0)))).alias("at", "row"))
    m = r.select("at", F.map_from_arrays("head", "row").alias("m"))
    names = ["timestamp", "original", "statuscode", "mimetype", "digest", "length"]
    out = m.select("at", *[F.try_element_at("m", F.lit(n)).alias(n) for n in names]).where("statuscode = '200'")
    from pyspark.sql import Window

    before = F.lag("digest").over(Window.partitionBy("original").orderBy("timestamp", "at"))
    return out.withColumn("_before", before).where("_before IS NULL OR _before <> digest").drop("_before", "at")


def listed_urls(df: DataFrame, prefix: str, year_from: int, year_to: int, limit: int, url: str = "original", stamp: str = "timestamp") -> DataFrame:
    """The first captures of addresses under a prefix in a range of years, one for each, by address."""
    year = F.substring(stamp, 1, 4).cast("int")
    return df.where(F.col(url).startswith(prefix) & year.between(year_from, year_to)).groupBy(url).agg(F.min(stamp).alias(stamp)).orderBy(url).limit(limit)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("body"))

"""The queries of the training-data operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import decontamination, langid, line_dedup, metric_join, mixing, packing, sharding, simhash, tokens, warc
from presslens.llm.common import folder
from presslens.session import ship


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each packed row of 2048 ids: its documents and segments, and digests of its ids and positions."""
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, pad_id=50256)
    return packed.select("bin_id", "n_tokens", "n_segments", "doc_ids", "chunk_nos", "cu_seqlens", F.sha1("input_ids").alias("ids_sha1"), F.sha1("position_ids").alias("positions_sha1"))


def op2_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), limit=512)


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=64).select("doc_id", "slot", "shard")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    at = folder(spark, "warc")
    warc.write_bundles(pages, at)
    read = warc.read_records(spark, at)
    kind = dict(pages.dtypes)["page_id"]
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "similarities", "positions")


def op7_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), equal=1)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op10_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack_tokens, op2_count_tokens, op3_shard, op4_mix, op5_warc, op6_decontaminate, op7_near_embeddings, op8_language, op9_dedup_lines, op10_near_documents)}


WARC_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, payload, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS response FROM p),
    b AS (SELECT *, [CAST(('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5)) AS BIGINT) FOR i IN range(8)] AS fives FROM d)
    SELECT page_id, payload_bytes,
           array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((fives[CAST(j // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (j % 4) AS INTEGER)) % 32 + 1 AS INTEGER), 1) FOR j IN range(32)], '') AS payload_digest,
           CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
    FROM b"""

NEAR_EMBEDDINGS_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_shard": sharding.table_sql(64), "op4_mix": mixing.draw_sql(), "op5_warc": WARC_SQL, "op7_near_embeddings": NEAR_EMBEDDINGS_SQL}

"""WARC records in seekable Zstandard bundles (operator 5)."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.llm.common import few, stored

#: Fixed: magic numbers of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: The last byte of a bundle.
LAST = SEEKABLE >> 24
NAMESPACE = uuid.UUID("7b0f0bb8-5a54-4c4e-9b0e-1f8f3c1d9a55")
#: Fixed: the profile of revisit records for payloads with an equal digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What stands before the payload in a response's block.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Where a record lies: an archive, one of its frames (number, place and bytes in the file), and the record's place and bytes in the frame's content.
PLACE = "archive string, frame int, frame_at long, frame_bytes long, offset long, length long"
FIELDS = "record_id string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, digest: str, repeat: object = 0) -> str:
    """The id of a page's record. Rows that repeat a page and its payload, and rows without a page_id, are told apart by ``repeat``; revisits refer to repeat 0."""
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}|{repeat}')}"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None, repeat: object = 0) -> bytes:
    """The bytes of a response record, or of a revisit record (no block) if refers_to names a page. A page without a url is named by its id."""
    clean = lambda s: "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in s)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, digest, repeat)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    head.append(f"WARC-Target-URI: {clean(url) if url else f'urn:page:{quote(str(page_id))}'}")
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(str(page_id))}")
    if url is None:
        head.append("X-No-URL: 1")
    elif clean(url) != url or not url:
        head.append(f"X-URL: {base64.b64encode(url.encode()).decode()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {quote(str(refers_to))}"]
    block = HTTP + payload if refers_to is None else b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record that starts there, and where it ends."""
    head_end = data.index(b"\r\n\r\n", start)
    lines = data[start:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    end = head_end + 4 + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {start} doesn't end as it says")
    return fields, data[head_end + 4 : end], end + 4


def parsed(data: bytes, start: int) -> tuple[tuple, bytes, int]:
    """FIELDS of the record that starts there, its payload, and where it ends. Of a response the size and digest are those of the block, and must agree with the headers."""
    h, block, end = parse(data, start)
    named = lambda x: x if x is None else unquote(x)
    n, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.removeprefix(HTTP)
    if h["WARC-Type"] == "response" and (n, digest) != (len(payload), payload_digest(payload)):
        raise ValueError(f"{h['WARC-Record-ID']} has another payload than it says")
    url = None if "X-No-URL" in h else base64.b64decode(h["X-URL"]).decode() if "X-URL" in h else h["WARC-Target-URI"]
    return (h["WARC-Record-ID"][1:-1], named(h.get("X-Page-ID")), url, h["WARC-Type"], n, digest, named(h.get("X-Refers-To-Page"))), payload, end


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at the end: (compressed, decompressed) size of each frame, then their number."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame of a bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    start = len(data) - 9 - n * width
    if struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE, n * width + 9):
        raise ValueError("broken seek table")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, start + i * width)
        out.append((at, c, d))
        at += c
    return out


def revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload, response (the page_id of the response that has the same payload) and repeat.

    Only what payloads share is gathered: their digests, and the pages that repeat. They are broadcast if they are few; the html is shuffled only if they are not. repeat numbers the rows that repeat a page and its payload; rows
    without a page_id, which nothing refers to, have -1. A payload that a third of the rows hold is one digest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    n = stored(p.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n")))
    both = n.groupBy("sha").agg(F.max("page_id").alias("response"), F.sum("n").alias("rows")).where("rows > 1")
    shared = few(stored(both.select(F.col("sha").alias("s"), "response")))
    twice = stored(n.where("n > 1 AND page_id IS NOT NULL").select(F.col("sha").alias("rs"), F.col("page_id").alias("rp")))
    p, one = p.join(shared, F.col("sha") == F.col("s"), "left"), F.when(F.col("page_id").isNull(), -1).otherwise(0)
    if twice.isEmpty():
        return p.select("page_id", "url", "payload", "response", one.alias("repeat"))
    p = p.join(few(twice), (F.col("sha") == F.col("rs")) & (F.col("page_id") == F.col("rp")), "left")
    again = p.where("rp IS NOT NULL").withColumn("repeat", F.row_number().over(Window.partitionBy("sha", "page_id").orderBy("url")) - 1)
    once = p.where("rp IS NULL").withColumn("repeat", one)
    return once.unionByName(again).select("page_id", "url", "payload", "response", "repeat")


def write_bundles(pages: DataFrame, path: str, least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 24, level: int = 3) -> None:
    """A WARC record for each row of pages (page_id, url, html), in bundles at any path that Spark can write.

    Records are grouped into frames of about frame_bytes, each compressed on its own; a bundle of about bundle_bytes is its frames and a seek table, and a file of its own. Files come from Spark's text writer, one row each, which writes a row's
    bytes as they are and ends it with a separator: the separator is the last byte of the seek table. So any store will do, and a task that is lost or runs twice leaves no trace. Names end in .txt; name_bundles() gives them their own.
    The payload is the html, null as empty. Of records with equal payloads of at least least_bytes bytes the one with the largest page_id is the response (every row of that id, if it repeats, and all of them if no row has an id); the others are revisits
    without a block. Every record has an id of its own. Other columns are ignored; an empty table gives no bundles. Memory: one bundle, one frame and the largest record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=level)
        task, made = TaskContext.get().partitionId(), 0
        frames: list[tuple[bytes, int]] = []
        frame, size, inside = [], 0, 0

        def close_frame() -> None:
            nonlocal frame, size, inside
            if frame:
                raw = b"".join(frame)
                frames.append((c.compress(raw), len(raw)))
                size += len(frames[-1][0])
                frame, inside = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal frames, size
            close_frame()
            data = b"".join(x for x, _ in frames) + seek_table([(len(x), n) for x, n in frames])
            frames, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["data"])

        for b in batches:
            ids, responses, repeats = (b.column(k).to_pylist() for k in (0, 3, 4))
            for i in range(b.num_rows):
                payload = b.column(2)[i].as_py()
                to = responses[i] if responses[i] is not None and responses[i] != ids[i] and len(payload) >= least_bytes else None
                made += 1
                raw = record(ids[i], b.column(1)[i].as_py(), payload, payload_digest(payload), to, repeats[i] if repeats[i] >= 0 else f"{task}-{made}")
                if frame and inside + len(raw) > frame_bytes:
                    close_frame()
                frame.append(raw)
                inside += len(raw)
                if size + inside // 4 >= bundle_bytes:
                    yield close_bundle()
        if frame or frames:
            yield close_bundle()

    data = revisits(pages).mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    data.write.mode("errorifexists").option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", chr(LAST)).text(path)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each bundle that was written there. Tasks without rows leave empty files, which are none."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the bundles at path: FIELDS, PLACE and, if asked for, the payload. Frames are found through the seek tables and decompressed one at a time."""
    schema = f"{FIELDS}, {PLACE}" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                archive, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for frame, (at, c, n) in enumerate(read_seek_table(data)):
                    raw, start, out = d.decompress(data[at : at + c], max_output_size=n), 0, []
                    while start < n:
                        fields, payload, end = parsed(raw, start)
                        out.append((*fields, archive, frame, at, c, start, end - start, payload)[: len(names)])
                        start = end
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names=names)

    return bundles(spark, path).mapInArrow(run, schema)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """The index of the bundles at path, a table at another path: record_id, page_id and PLACE, sorted within files by record_id so that a search reads few of them."""
    read_records(spark, path).select("record_id", "page_id", *[x.split()[0] for x in PLACE.split(", ")]).repartitionByRange("record_id").sortWithinPartitions("record_id").write.mode("errorifexists").parquet(index)


def fetch(spark: SparkSession, index: str, record_id: str) -> tuple[tuple, bytes] | None:
    """FIELDS and payload of one record, None if the index doesn't have it. Of the archive only the record's frame is read."""
    r = spark.read.parquet(index).where(F.col("record_id") == record_id).first()
    if r is None:
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(r.archive)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(r.frame_at)
        data = bytes(stream.readNBytes(r.frame_bytes))
    finally:
        stream.close()
    fields, payload, _ = parsed(zstandard.ZstdDecompressor().decompressobj().decompress(data), r.offset)
    return fields, payload


def name_bundles(spark: SparkSession, path: str) -> int:
    """Rename the files of write_bundles() to end in .warc.zst, before an index is made; empty files go. The driver sees names alone. Gives the number of bundles."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, n = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for x in fs.listStatus(at):
        p = x.getPath()
        if p.getName().endswith(".txt"):
            if x.getLen():
                fs.rename(p, p.getParent().suffix(f"/{p.getName()[:-4]}.warc.zst"))
                n += 1
            else:
                fs.delete(p, False)
    return n

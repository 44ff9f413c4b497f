"""WARC archives with revisit records.

Headers only (page id, digest, length) are shuffled by payload digest to find the response of each group of
equal payloads; revisits are joined to it and records with fresh headers are written, payload once per group.

A record is text, so the archive is written by the text writer with the record's end as line separator.
It is read back by Content-Length, never by searching for separators, as a payload may hold any of them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, scratch, table, text_of, written

MIN_BYTES = 0
RECORDS_PER_FILE = 20_000
CAPTURE_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def sha1_base32(payload):
    """Bare base-32 SHA-1 of a string column: five hexadecimal digits are four digits of base 32."""
    digits = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payloads(pages: DataFrame) -> DataFrame:
    payload = text_of("html")
    return pages.select(
        "page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"),
        sha1_base32(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the revisit records among ``headers`` (page_id, digest, bytes).

    The largest page_id of a digest is its response. Rows that repeat that page_id are the same capture
    and no revisits; a null page_id is never a revisit. The responses of groups are written first, so that
    the join below reads two plain tables and Spark can split a digest that a third of the rows share.
    """
    headers = headers.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
    groups = headers.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    groups = written(groups.filter("least < refers_to").select("digest", "refers_to"), "warc-responses")
    found = headers.select("page_id", "digest").join(groups, "digest")
    return found.filter("page_id < refers_to").select("page_id", "digest", "refers_to")


def record_uri(page_id, digest):
    hashed = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    parts = [F.substring(hashed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """A WARC/1.1 record per row of ``pages`` (page_id, url, html; a null html is empty) below ``path``.

    Control characters and blanks of a URL are percent-encoded, so no URL can forge a header.
    """
    source = payloads(pages)
    revisits = written(resolve_revisits(source.select("page_id", "digest", "bytes"), min_bytes), "warc-revisits").distinct()
    rows = source.join(revisits, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_uri(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(CAPTURE_DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", record_uri(F.col("refers_to"), F.col("digest"))),
                line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
        http,
        F.when(again, F.lit("")).otherwise(F.col("payload")),
    )
    writer = rows.select(head.alias("record")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records(data) -> object:
    """(headers, payload) of each record of one gzip archive; holds the piece that is being read only."""
    unzip, held, at = zlib.decompressobj(wbits=31), b"", 0
    chunks = (data[k : k + (1 << 20)] for k in range(0, len(data), 1 << 20))

    def more() -> bool:
        nonlocal held, at
        piece = next(chunks, None)
        if piece is None:
            return False
        held, at = held[at:] + unzip.decompress(piece), 0
        return True

    while True:
        while (stop := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("archive ends within a record")
                return
        lines = held[at:stop].split(b"\r\n")
        if lines[0] != b"WARC/1.1":
            raise ValueError("no record where one should begin")
        headers = dict(x.split(b": ", 1) for x in lines[1:])
        size, at = int(headers[b"Content-Length"]), stop + 4
        while len(held) - at < size + 4:
            if not more():
                raise ValueError("archive ends within a record")
        block, at = held[at : at + size], at + size + 4
        yield headers, block[block.index(b"\r\n\r\n") + 4 :]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; the digest of every stored payload is checked.

    A file is one Spark row, so its size is bounded where it is written.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def number(headers, name):
        return int(headers[name]) if name in headers else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for headers, payload in records(memoryview(content.as_buffer())):
                    kind = headers[b"WARC-Type"].decode()
                    digest = headers[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of record {headers[b'WARC-Record-ID']} does not fit its digest")
                    out.append((
                        number(headers, b"X-Page-Id"), headers[b"WARC-Target-URI"].decode("utf-8", "replace"),
                        number(headers, b"X-Payload-Length"), digest, kind, number(headers, b"X-Refers-To-Page-Id"),
                        payload if kind == "response" else None,
                    ))
                    if len(out) == 256:
                        yield as_batch(out)
                        out = []
                yield as_batch(out)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def as_batch(rows):
        columns = zip(*rows) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return files.mapInArrow(run, schema)


DIGEST_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), h AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p
), d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER)) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), 'string_agg', '') AS payload_digest
  FROM h
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < response THEN response END AS refers_to
FROM w
"""


@query("op8_warc_revisit", DIGEST_SQL)
def op8_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

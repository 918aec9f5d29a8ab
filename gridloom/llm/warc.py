"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, in a table bucketed by digest; the exact header bytes of every
record are stored apart. Original records come back by joining the two. Of equal payloads the record with the largest
key is the response; the others are revisits of it. DataFrame functions only.

Each row has a record of its own, named by its key and its place in the table, so that null and repeated keys lose nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, discard, new_path, small, staged, text_or_empty, with_rows

#: Payload bytes that a bucket of the store is meant to hold, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 256 << 20, 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of five hex digits, four characters each."""
    def group(i: int) -> Column:
        v = F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[group(i) for i in range(8)])


def record_name(page: Column, row: Column) -> Column:
    """urn:page:<=key, percent-encoded; nothing for null>:<place of the row>, one for each record."""
    key = F.coalesce(F.concat(F.lit("="), F.url_encode(page.cast("string"))), F.lit(""))
    return F.concat(F.lit("urn:page:"), key, F.lit(":"), F.lower(F.hex(row["file"])), F.lit("-"), row["at"].cast("string"))


def page_of(name: Column) -> Column:
    """The key (as text) that a record name holds."""
    return F.when(name.startswith("urn:page:="), F.url_decode(F.regexp_extract(name, r"^urn:page:=([^:]*):", 1)))


@dataclass
class Archive:
    """headers: row, role, head (exact bytes), digest, at a path. payloads: digest, size, payload, a bucketed table."""

    spark: SparkSession
    headers_path: str
    payloads: str

    def headers(self) -> DataFrame:
        return self.spark.read.parquet(self.headers_path)

    def records(self) -> DataFrame:
        """Every record as it was: record (all bytes), payload_bytes (of the full payload).

        A response's bytes are its header, its payload and the closing line ends, by a join on the digest, one to one. A
        revisit holds no payload of its own; the length comes from the store, by a join that moves no payloads.
        """
        store, heads = self.spark.table(self.payloads), self.headers()
        end = F.lit(BREAK).cast("binary")
        full = heads.where("role = 'response'").join(store.hint("merge"), "digest")
        full = full.select(F.concat("head", "payload", end).alias("record"), F.col("size").alias("payload_bytes"))
        again = heads.where("role = 'revisit'").join(staged(store.select("digest", "size"), "lengths"), "digest")
        return full.unionByName(again.select(F.concat("head", end).alias("record"), F.col("size").alias("payload_bytes")))

    def write_files(self, path: str) -> None:
        """The archive as plain .warc text files, by Spark's text writer: a record ends with two line ends, as its lines do."""
        raw = self.records().select(F.col("record").cast("string").alias("value"))
        raw.select(F.expr(f"substr(value, 1, length(value) - {len(BREAK)})")).write.option("lineSep", BREAK).text(path)


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", name: str | None = None, buckets: int | None = None) -> Archive:
    """Write a record for each row of pages.

    Null payloads count as empty; empty payloads equal each other. Null URLs are written as empty, and white space in a
    URL is percent-encoded. Of equal payloads the row of the largest key is the response (null is the least key; among
    equal keys the last row). Other columns are ignored. The hash is verified: equal digests of different length stop the
    write. Without `buckets`, the store has as many as its payloads fill at BUCKET_BYTES each.
    """
    spark = pages.sparkSession
    name = name or "payloads_" + new_path(spark, "x").rsplit("-", 1)[1]
    body = text_or_empty("payload").cast("binary")
    digest = F.unhex(F.sha2(body, 256))
    rows = with_rows(pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(payload).alias("payload")))
    keys = staged(rows.select(ROW, "page", text_or_empty("url").alias("url"), digest.alias("digest"), F.octet_length(body).cast("bigint").alias("n"), base32_sha1(body).alias("sha1")), "keys")
    kept = staged(keys.groupBy("digest").agg(F.max(F.struct("page", ROW)).alias("last"), F.min("n").alias("n_min"), F.max("n").alias("n_max")), "last")
    if buckets is None:
        buckets = max(BUCKETS, -(-(kept.agg(F.sum("n_max")).first()[0] or 0) // BUCKET_BYTES))
    kept = kept.select("digest", "last", F.when(F.col("n_min") == F.col("n_max"), F.col("n_max")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("size"))
    marked = keys.join(kept, "digest")
    response = F.col(ROW) == F.col(f"last.{ROW}")
    address = F.regexp_replace("url", r"\s", "%20")
    revisit = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <"), record_name(F.col("last.page"), F.col(f"last.{ROW}")), F.lit(">\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: <"), record_name(F.col("page"), F.col(ROW)), F.lit(">\r\nWARC-Target-URI: "), address,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\n"), F.when(response, F.lit("")).otherwise(revisit),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.when(response, F.col("n")).otherwise(F.lit(0)) + len(HTTP)).cast("string"), F.lit(BREAK + HTTP),
    )
    headers = new_path(spark, "headers")
    marked.select(ROW, F.when(response, F.lit("response")).otherwise(F.lit("revisit")).alias("role"), head.cast("binary").alias("head"), "digest").write.parquet(headers)
    # Copies are the smaller part of pages: where they are proven few, leaving them out moves no payloads.
    copies = staged(marked.where(~response).select(ROW), "copies")
    unique = rows.join(small(copies), ROW, "left_anti").select(digest.alias("digest"), F.octet_length(body).cast("bigint").alias("size"), body.alias("payload"))
    unique.repartition(buckets, "digest").write.format("parquet").option("path", new_path(spark, "payloads")).bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
    discard(keys, copies)
    return Archive(spark, headers, name)


def parse(records: DataFrame) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type, refers_to of records, read from their bytes.

    The record's header ends with its first empty line, and the HTTP header in its block with the next one, however long
    they are and whatever lines they have. page and refers_to are the keys (as text) in the names of the record and of
    that which a revisit refers to. A response whose payload doesn't have the digest that its header states stops the read.
    """
    raw = F.col("record")
    text = F.decode(raw, "ISO-8859-1")  # one character is one byte
    top = F.concat(F.substring_index(text, BREAK, 1), F.lit("\r\n"))

    def field(name: str) -> Column:
        return F.regexp_extract(top, rf"(?i)\r\n{name}:\s*<?([^\r>]*)>?\s*\r\n", 1)

    at = F.length(top) + 3  # the block's first byte, from 1
    size = field("Content-Length").cast("bigint")
    http = F.when(field("Content-Type").startswith("application/http"), F.position(F.lit(BREAK), text, at) + len(BREAK) - at).otherwise(F.lit(0))
    own = F.substring(raw, (at + http).cast("int"), (size - http).cast("int"))
    stated, kind = F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:([A-Z2-7]{32})$", 1), field("WARC-Type")
    good = (kind == "revisit") | ((base32_sha1(own) == stated) & (F.octet_length(own) == F.col("payload_bytes")))
    checked = F.when(good, stated).otherwise(F.raise_error(F.lit("a payload doesn't match its digest")))
    return records.select(page_of(field("WARC-Record-ID")).alias("page"), "payload_bytes", checked.alias("payload_digest"), kind.alias("record_type"), F.when(kind == "revisit", page_of(field("WARC-Refers-To"))).alias("refers_to"))

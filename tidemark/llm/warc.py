"""WARC archives in which records of equal payload revisit one response."""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settle

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = (
    "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes bigint, page_id bigint, refers_to_page bigint, payload binary"
)


def base32_sha1(text: Column) -> Column:
    """The SHA-1 of the UTF-8 bytes as 32 upper-case base32 letters, from eight groups of five hex digits."""
    digits = F.sha1(F.encode(text, "UTF-8"))
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), (F.shiftright(value, shift).bitwiseAND(31) + 1), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(page: Column, digest: Column) -> Column:
    """A record id that follows from the page and its payload, so that a task run again writes the same."""
    h = F.md5(F.encode(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), digest), "UTF-8"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolve_revisits(pages: DataFrame, page_id: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``page, uri, body, size, digest, original``: each page with the page its record revisits, or null.

    Among payloads of equal digest and length, at least ``min_bytes`` long, the rows of the largest page id are
    responses and all others revisit them; shorter ones are responses. A null payload is empty, a null page id the
    smallest (in a group with no other id all are responses); repeated rows of the largest id are all responses.

    Only headers are shuffled by digest: a maximum counted map-side keeps hot payloads small, and what it finds for
    repeated payloads is written once, so that the joins back are plain ones that Spark can split.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    base = pages.select(F.col(page_id).cast("bigint").alias("page"), F.col(url).cast("string").alias("uri"), body.alias("body"))
    base = base.select("*", F.octet_length("body").cast("bigint").alias("size"), base32_sha1(F.col("body")).alias("digest"))
    headers = base.where(F.col("size") >= min_bytes).select("page", "digest", "size")
    originals = (
        headers.groupBy("digest", "size")
        .agg(F.max("page").alias("original"), F.min("page").alias("least"), F.count(F.lit(1)).alias("n"), F.count("page").alias("known"))
        .where("known > 0 and (least < original or known < n)")
        .select("digest", "size", "original")
    )
    originals = settle(originals, "originals")
    found = base.join(originals, ["digest", "size"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page").eqNullSafe(F.col("original"))
    return found.select("page", "uri", "body", "size", "digest", F.when(revisit, F.col("original")).alias("original"))


def write_archives(resolved: DataFrame, path: str, date: datetime | None = None, records_per_file: int = 2000) -> None:
    """Write gzip WARC files below ``path``: responses with their payload, revisits as headers only.

    Each row is one record up to its last line feed, which Spark's text writer adds; so files are plain runs of
    records, wherever the shared folder is. Line breaks in a URI are percent-encoded. Files hold at most
    ``records_per_file`` records, since readers take a file whole.
    """
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("original").isNotNull()
    uri = F.replace(F.replace(F.coalesce("uri", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat(
        F.lit(VERSION + "\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _urn(F.col("page"), F.col("digest"))),
        field("WARC-Date", F.lit(stamp)),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Page-ID", F.coalesce(F.col("page").cast("string"), F.lit(""))),
        F.when(
            revisit,
            F.concat(
                field("WARC-Profile", F.lit(PROFILE)),
                field("WARC-Refers-To", _urn(F.col("original"), F.col("digest"))),
                field("WARC-Refers-To-Page-ID", F.col("original").cast("string")),
                field("WARC-Payload-Length", F.col("size").cast("string")),
                field("Content-Length", F.lit("0")),
            ),
        ).otherwise(F.concat(field("Content-Type", F.lit("text/html;charset=utf-8")), field("Content-Length", F.col("size").cast("string")))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("body")), F.lit("\r\n\r"))
    resolved.select(record.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _records(data: bytes):
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != VERSION:
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        payload = data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4
        if len(payload) < size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``, one row each; see RECORDS.

    Digest and length of a response are taken from the payload read, which must agree with its header; those of a
    revisit, whose payload is elsewhere, from its header. No files or empty files give no rows.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.binary()]

    def parse(fields: dict, payload: bytes) -> tuple:
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = len(payload)
        if fields["WARC-Type"] == "response":
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        else:
            size, payload = int(fields["WARC-Payload-Length"]), None
        number = lambda k: int(fields[k]) if fields.get(k) else None
        return (
            fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Target-URI"],
            digest, size, number("WARC-Page-ID"), number("WARC-Refers-To-Page-ID"), payload,
        )

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = zlib.decompress(content.as_py(), wbits=31) if len(content.as_py()) else b""
                rows = [parse(*x) for x in _records(data)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORDS)

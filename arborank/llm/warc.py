"""WARC archives in which a repeated payload is stored once and revisited by the other records.

Only headers (id, payload digest, size) are dealt out by digest to find repeated payloads; the pages then meet the revisits where they are read, see SENT_REVISITS. Records are laid out by SQL
expressions and written by Spark's text sink, one gzip file a task, so that any file system Spark knows will do; files are bounded in
records such that they stay near FILE_BYTES, and below MOST_BYTES even if all of their pages are as large as the largest.
Reading takes whole files as bytes, walks the records by their Content-Length, checks each payload against its digest, and
joins revisits to their originals by digest.

Defined cases: a null html is an empty payload; a null url is written as an empty target; of rows that repeat the largest id of a payload each
is a response; null ids are smaller than all others. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, shared_dir, spread_join, written

END = "\r\n"
#: Fixed value: the profile of a revisit record with an identical payload, from the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of all records, as the pages have none.
DATE = "2000-01-01T00:00:00Z"
FILE_BYTES, MOST_BYTES = 64 << 20, 1 << 30
#: Up to so many revisits, of some 100 bytes each, go to the tasks that read the pages, so that no payload is moved; beyond that pages and revisits are dealt by id.
SENT_REVISITS = 500_000


def record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page (id, nulls as the smallest), url, payload, digest, original (the id of the response that a revisit refers to)."""
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    headers = headers_of(rows, min_bytes)
    last = headers.groupBy("digest").agg(F.max("page").alias("original"), F.min("page").alias("least")).filter("least < original").select("digest", "original")
    revisits = written(spread_join(headers, last, ["digest"], F.xxhash64("page")).filter("page < original").select("page", "digest", "original").distinct(), "warc-revisits")
    few = revisits.count() <= SENT_REVISITS
    return rows.join(F.broadcast(revisits) if few else revisits, ["page", "digest"], "left")


def headers_of(rows: DataFrame, min_bytes: int) -> DataFrame:
    """page, digest of the payloads that can be revisited."""
    return written(rows.filter(F.octet_length("payload") >= min_bytes).select("page", "digest"), "warc-headers")


def records(rows: DataFrame) -> DataFrame:
    """value: one record each, without the two line ends that close it."""
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page"), F.col("digest"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), record_id(F.col("original"), F.col("digest")))),
        F.concat(F.lit("X-Page-ID: "), F.col("page").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    return rows.withColumn("block", block).select(F.concat(F.concat_ws(END, *lines), F.lit(END * 2), F.col("block")).alias("value"))


def records_for(pages: DataFrame) -> int:
    """How many records a file may have."""
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    mean, most = pages.agg(F.avg(size), F.max(size)).first()
    return int(max(1, min(2000, FILE_BYTES // (mean or 1) or 1, MOST_BYTES // (most or 1))))


def write_archives(rows: DataFrame, path: str, records_per_file: int = 2000) -> None:
    records(rows).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parsed(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a gzip file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(size := int(fields["content-length"]))
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield fields, block


HEADERS = "page long, record_type string, digest string, size long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page, record_type, digest, size (of the payload; null for revisits) of each record; payloads are checked."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parsed(content.as_py()):
                    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    rows.append((int(fields["x-page-id"]), kind, digest, size))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page", "record_type", "digest", "size"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(each, HEADERS)


def resolved(headers: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; revisits take theirs from the response with their digest."""
    originals = headers.filter(f"record_type = 'response' and size >= {min_bytes}").groupBy("digest").agg(F.max("page").alias("original"), F.max("size").alias("full"))
    revisits = spread_join(headers.filter("record_type = 'revisit'"), originals, ["digest"], F.xxhash64("page"), "left")
    shown = F.when(F.col("page") != NULL_ID, F.col("page"))
    first = headers.filter("record_type = 'response'").select(shown.alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(revisits.select(shown.alias("page_id"), F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("original").alias("refers_to")))


def round_trip(pages: DataFrame, min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Writes deduplicated archives of pages (page_id, url, html) to `path` and reads them back."""
    path = path or shared_dir(pages.sparkSession, "warc")
    write_archives(with_revisits(pages, min_bytes), path, records_for(pages))
    return resolved(written(read_archives(pages.sparkSession, path), "warc-read"), min_bytes)

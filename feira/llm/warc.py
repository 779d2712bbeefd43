"""Web archives: writing, reading and resolving revisits.

Records are built as text and written with Spark's own text writer, so archives go
wherever Spark can write and a lost task is simply run again. A record ends in an
empty line; the line separator CRLF after each value completes it. Archives are
read back whole as binary files, and cut by the ``Content-Length`` of each record, so a
payload may hold anything. A task that writes begins a new file after as many records as hold
``ARCHIVE_BYTES`` on average, so files keep that size however large the corpus is.

Revisits: only headers (digest and id) are shuffled. Per payload digest the largest
id is the response, and every other record of that digest becomes a revisit record with
fresh headers that name the response; its payload is left out. Grouping by digest is
pre-aggregated, so a payload that a third of all pages share is no hot task.

Defined cases: a null payload counts as empty; a null or control-character URL is written
percent-encoded or left out; rows with a null id have no record id and are left out;
of repeated ids one record is written per row; an empty table gives empty archives;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload per archive file, about.
ARCHIVE_BYTES = 16_000_000

# The digits of base 32 in Spark's conv() and in RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"

RECORD_SCHEMA = "page_id long, record_type string, uri string, payload_digest string, content_length long, block_digest string, refers_to long"


def base32_sha1(value: Column) -> Column:
    """The SHA-1 of a string's UTF-8 bytes in upper-case base 32."""
    digest = F.sha1(value)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV_DIGITS, RFC_DIGITS)


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``record_type`` and ``refers_to`` added to ``page_id``, ``payload_digest``, ``payload_bytes``.

    Payloads under ``least_bytes`` are responses all.
    """
    originals = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("original"))
    met = headers.join(originals, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") < F.col("original"))
    return met.select(
        *headers.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def record_text(page_id: Column, uri: Column, payload: Column, digest: Column, record_type: Column, refers_to: Column) -> Column:
    """One archive record without its last CRLF. Revisit records have an empty block."""
    is_revisit = record_type == "revisit"
    block = F.when(is_revisit, F.lit("")).otherwise(payload)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(page_id)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(uri, r"[\x00-\x20\x7F]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(refers_to))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def write_archives(records: DataFrame, path: str, records_per_file: int = 0) -> None:
    """Writes ``page_id``, ``url``, ``html``, ``payload_digest``, ``record_type``, ``refers_to`` as gzipped archives.

    ``records_per_file`` is the most that a file has; 0 sets no bound.
    """
    text = record_text(F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")), F.col("payload_digest"), F.col("record_type"), F.col("refers_to"))
    records.select(text.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        at = start + int(headers["Content-Length"])
        yield headers, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record doesn't end at byte {at}")
        at += 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    number = lambda name: int(name.rpartition(":")[2].rstrip(">")) if name else None
    for batch in batches:
        for packed in batch.column(0):
            rows = []
            for h, block in parse_archive(gzip.decompress(packed.as_py())):
                digest = b32encode(hashlib.sha1(block).digest()).decode()
                rows.append((number(h["WARC-Record-ID"]), h["WARC-Type"], h.get("WARC-Target-URI"), h["WARC-Payload-Digest"].removeprefix("sha1:"), len(block), digest, number(h.get("WARC-Refers-To"))))
            names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RECORD_SCHEMA.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``; blocks are hashed, not returned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parsed, RECORD_SCHEMA)


def resolved_records(records: DataFrame) -> DataFrame:
    """What each record stands for: revisit records joined to the responses they name.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, taken from the
    response's block of that digest; a revisit without one gets nulls.
    """
    answers = records.filter("record_type = 'response'")
    plain = answers.select("page_id", F.col("content_length").alias("payload_bytes"), F.col("block_digest").alias("payload_digest"), "record_type", "refers_to")
    # An id may have several responses; the one meant has the revisit's digest.
    named = answers.select(F.col("page_id").alias("refers_to"), F.col("block_digest").alias("payload_digest"), F.col("content_length").alias("payload_bytes")).dropDuplicates(["refers_to", "payload_digest"])
    revisits = records.filter("record_type = 'revisit'").join(named, ["refers_to", "payload_digest"], "left")
    named = revisits.select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
    return plain.unionByName(named)


def deduplicate_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes deduplicated archives of ``page_id``, ``url``, ``html`` to ``path`` and returns what reading them gives."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).filter("page_id IS NOT NULL")
    headers = rows.select("page_id", base32_sha1(F.col("html")).alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    resolved = resolve_revisits(headers, least_bytes).select("page_id", "payload_digest", "record_type", "refers_to").dropDuplicates(["page_id", "payload_digest"])
    # Payloads meet their headers by page id; a page id occurs once or a few times, so no key is hot.
    full = rows.withColumn("payload_digest", base32_sha1(F.col("html"))).join(resolved, ["page_id", "payload_digest"])
    mean = headers.agg(F.avg("payload_bytes")).first()[0]
    write_archives(full, path, max(1, int(ARCHIVE_BYTES / max(mean or 0.0, 1.0))))
    return resolved_records(read_archives(spark, path))

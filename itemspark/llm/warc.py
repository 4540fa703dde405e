"""WARC: write captures as request, response and metadata records; assemble them again.

The writer lets Spark's text source write the archives: a page's records are one text
row, and the row separator is the blank line that ends a record.  The reader takes
whole files of bounded size, cuts them into records by their Content-Length, and joins
the records of a capture through WARC-Concurrent-To.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.llm.registry import query, table
from itemspark.session import cut_lineage, staging_path

LEAST_BYTES = 100            # smaller payloads are always stored in full
FILE_BYTES = 128 << 20       # payload bytes of a file, unless one page has more
PAGE_CLASSES = (64 << 10, 1 << 20)      # pages up to these sizes share files; larger ones have their own
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
CHUNK = 8 << 20              # bytes of blocks that the reader hands on at once
FED = 32 << 10               # packed bytes fed to the unpacker at once


def _record_id(kind: str, page, digest):
    """A record's name, from what it stands for; the same again after a retry."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("none")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind, record_id, uri, extra, mime: str, block):
    """Header lines and block; the row separator adds the end of the record."""
    return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id,
                    F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), uri, extra,
                    F.lit(f"{CRLF}Content-Type: {mime}{CRLF}Content-Length: "),
                    F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def with_first(pages: DataFrame) -> DataFrame:
    """Add n_bytes, digest and ``first``: the smallest page_id of the pages with this
    payload if it is repeated and has at least LEAST_BYTES, else null."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).alias("n_bytes"),
                       F.sha2(payload.cast("binary"), 256).alias("digest"))
    repeated = (own.where(F.col("n_bytes") >= LEAST_BYTES).groupBy("digest")
                .agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    return own.join(cut_lineage(repeated, "repeated"), "digest", "left")


def write_pages(pages: DataFrame, path: str) -> None:
    """Write pages(page_id, url, html) as gzip-compressed WARC files below ``path``.

    Of equal payloads of at least 100 bytes the smallest page_id is written in full,
    the others as revisit records.  Null html: empty payload.  Null url: empty.  A null
    page_id is never the smallest.  Rows that repeat a page_id are each written; those
    with the smallest one are all responses.  Other columns are left out; an empty
    table writes no records.  A file holds at most FILE_BYTES of payloads or one page.
    """
    own = with_first(pages)
    page, digest = F.col("page_id"), F.col("digest")
    revisit = F.col("first").isNotNull() & ~page.eqNullSafe(F.col("first"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "")
    capture = _record_id("capture", page, digest)
    linked = F.concat(F.lit(f"{CRLF}WARC-Concurrent-To: "), capture)
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
                      F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    digest_line = F.concat(F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), digest)
    refers = F.concat(digest_line, F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "),
                      _record_id("capture", F.col("first"), digest))
    fields = F.concat(F.lit("page_id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(f"{CRLF}url: "),
                      F.coalesce(F.url_encode("url"), F.lit("")), F.lit(CRLF))
    request = _record(F.lit("request"), _record_id("request", page, digest), uri, linked,
                      "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    answer = _record(F.when(revisit, "revisit").otherwise("response"), capture, uri,
                     F.when(revisit, refers).otherwise(digest_line), "application/http; msgtype=response",
                     F.when(revisit, status).otherwise(F.concat(status, F.col("html"))))
    metadata = _record(F.lit("metadata"), _record_id("metadata", page, digest), uri, linked,
                       "application/warc-fields", fields)
    records = F.concat_ws(CRLF + CRLF, request, answer, metadata).alias("value")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    least = -1
    for most in (*PAGE_CLASSES, None):
        of_class = F.col("n_bytes") > least if most is None else F.col("n_bytes").between(least + 1, most)
        if largest > least:
            (own.where(of_class).select(records).write.mode("append").option("lineSep", CRLF + CRLF)
             .option("compression", "gzip").option("maxRecordsPerFile", FILE_BYTES // most if most else 1).text(path))
        least = most


def plain(data: bytes) -> bytes:
    """The bytes of a WARC file, unpacked when it consists of gzip members."""
    if data[:2] != b"\x1f\x8b":
        return data
    view, parts, at = memoryview(data), [], 0
    while view[at:at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            fed = view[at:at + FED]
            parts.append(member.decompress(fed))
            at += len(fed) - len(member.unused_data)       # what a member leaves is the next one's
        parts.append(member.flush())
    return b"".join(parts)


def parse(data: bytes):
    """(headers, block start, block end) of each record of an unpacked file.

    Header names are lower-cased.  Stops at the first place that isn't a record.
    """
    at = 0
    while data.startswith(b"WARC/", at):
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        headers = {}
        for line in data[at:head_end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = head_end + 4
        end = start + int(headers.get("content-length", 0))
        yield headers, start, end
        at = end
        while data.startswith(b"\r\n", at):
            at += 2


RECORDS = ("record_type string, record_id string, concurrent_to string, refers_to string, uri string, "
           "digest string, http binary, block binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``.

    ``block`` is the payload: without the HTTP head, which is ``http``, for HTTP records.
    """
    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                data, rows, held = plain(content), [], 0
                for h, start, end in parse(data):
                    http = h.get("content-type", "").startswith("application/http")
                    cut = data.find(b"\r\n\r\n", start, end) if http else -1
                    body = start if cut < 0 else cut + 4
                    rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-concurrent-to"),
                                 h.get("warc-refers-to"), h.get("warc-target-uri"),
                                 h.get("warc-payload-digest", "").rpartition(":")[2] or None,
                                 data[start:body] if http else None, data[body:end]))
                    held += end - start
                    if held > CHUNK:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [part.split()[0] for part in RECORDS.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, RECORDS)


def _field(block, name: str):
    found = F.regexp_extract(F.decode(block, "UTF-8"), f"(?m)^{name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: its own fields, ``request`` and
    ``metadata`` (null if none points at it).  Of several requests or metadata records
    the one with the smallest record id is taken."""
    def linked(kind: str) -> DataFrame:
        return (records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
                .groupBy(F.col("concurrent_to").alias("record_id"))
                .agg(F.min(F.struct("record_id", "uri", "http", "block")).alias(kind)))

    own = records.where(F.col("record_type").isin("response", "revisit")).drop("concurrent_to")
    return own.join(linked("request"), "record_id", "left").join(linked("metadata"), "record_id", "left")


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures with page_id and url from their metadata, and for revisits the page
    and payload length of the response that they refer to."""
    rows = cut_lineage(read_records(spark, path)                # four readers, one parse
                       .withColumn("payload_bytes", F.octet_length("block").cast("long"))
                       .withColumn("payload_digest", F.when(F.col("record_type") == "response", F.sha2("block", 256))
                                   .otherwise(F.col("digest"))), "records")
    fields = F.col("metadata.block")
    own = (captures(rows).withColumn("page_id", _field(fields, "page_id").cast("long"))
           .withColumn("url", F.url_decode(_field(fields, "url"))))
    answers = (own.where("record_type = 'response'").groupBy(F.col("record_id").alias("_answer"))
               .agg(F.min("page_id").alias("response_page"), F.max("payload_bytes").alias("response_bytes")))
    # responses look up themselves: a null key would send them all to one task
    return own.withColumn("_answer", F.coalesce("refers_to", "record_id")).join(answers, "_answer", "left").drop("_answer")


@query("op8_warc", """
    WITH own AS (
        SELECT page_id, COALESCE(html, '') AS html, octet_length(encode(COALESCE(html, ''))) AS payload_bytes,
               sha256(COALESCE(html, '')) AS payload_digest FROM pages),
    firsts AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS smallest FROM own)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > smallest THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > smallest THEN smallest END AS refers_to
    FROM firsts""")
def op8_warc(spark, folder) -> DataFrame:
    """All pages written as WARC files, read back and assembled."""
    path = staging_path(spark, "warc")
    write_pages(table(spark, folder, "pages"), path)
    revisit = F.col("record_type") == "revisit"
    return page_captures(spark, path).select(
        "page_id", F.when(revisit, F.col("response_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", F.when(revisit, F.col("response_page")).alias("refers_to"))

"""WARC archives: three records per capture written, read back, and joined into one row per capture.

A capture is a request, a response (or a revisit that refers to the response with the same payload) and a
metadata record; request and metadata name the response in WARC-Concurrent-To. ``write_archives`` makes the records
with built-in functions and lets Spark's text writer put the two line breaks behind each of them;
``read_archives`` reads whole files of bounded size and walks them by Content-Length, so a payload may hold
anything, line breaks and record headers too.

Nulls: a null payload is empty, a null URL becomes an empty target and a null page id stays null. Repeated rows and rows with
equal ids are captures of their own, as a record id comes from id, URL, payload and the number among equal rows. Of equal payloads the response is the
one with the largest (page id, URL). An empty table gives one empty archive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_REVISIT = 1000
FILE_BYTES = 32 * 1024 * 1024
SALTS = 16
CRLF = "\r\n"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, page_id long, "
    "content_type string, http_status string, payload_bytes long, payload_digest string, declared_digest string, payload binary"
)


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: str, headers: dict[str, Column], content: Column, content_type: str) -> Column:
    """Headers whose value is null are left out."""
    length = F.octet_length(content).cast("string")
    fields = {"WARC-Type": F.lit(kind)} | headers | {"Content-Type": F.lit(content_type), "Content-Length": length}
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields.items()]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(CRLF), content)


def capture_rows(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row per page: payload, digest, record ids, and the page it repeats, if any.

    Nothing depends on the order or the partitions of ``pages``: rows that are equal in id, URL and payload are counted and told
    apart by their number. Payloads are shuffled once; one that many pages share is dealt over ``SALTS`` groups by id and URL.
    """
    row = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        # One line, as a header value has to be.
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]+", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    row = row.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    shared = row.where(F.col("bytes") >= LEAST_REVISIT).select("digest", "bytes", "page_id", "url")
    first = shared.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count(F.lit(1)).alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    first = first.where("n > 1").select("digest", "bytes", "kept", salts)
    salted = row.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    place = ["digest", "bytes", "salt"]
    equal = salted.repartition(*place).groupBy(*place, "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"))
    joined = equal.join(first, place, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    is_first = F.col("kept.page_id").eqNullSafe(F.col("page_id")) & (F.col("kept.url") == F.col("url")) & (F.col("copy") == 1)
    is_revisit = F.col("kept").isNotNull() & ~is_first
    own = F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy")
    referred = _uuid(F.lit("response"), F.col("kept.page_id"), F.col("kept.url"), F.col("digest"), F.lit(1))
    return joined.select(
        "page_id", "url", F.lit(date).alias("date"), F.when(~is_revisit, F.col("payload")).alias("payload"), "digest", "bytes",
        is_revisit.alias("revisit"),
        *[_uuid(F.lit(kind), *own).alias(f"{kind}_id") for kind in ("response", "request", "metadata")],
        F.when(is_revisit, referred).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``; files of ``file_bytes`` before compression for payloads of mean size."""
    captures = capture_rows(pages)
    total, rows = pages.agg(F.sum(F.octet_length(F.coalesce("html", F.lit(""))).cast("long") + 2000), F.count(F.lit(1))).first()
    per_file = max(1, file_bytes * rows // total) if rows else 1
    url = F.col("url")
    common = {"WARC-Date": F.col("date"), "WARC-Target-URI": url}
    page = {"WARC-Page-ID": F.col("page_id").cast("string")}
    http = F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""]))
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest"))}
    response = _record(
        "response", {"WARC-Record-ID": F.col("response_id")} | common | page | digest,
        F.concat(http, F.col("payload")), "application/http;msgtype=response",
    )
    profile = {"WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")}
    revisit = _record(
        "revisit", {"WARC-Record-ID": F.col("response_id"), "WARC-Refers-To": F.col("refers_to")} | common | page | digest | profile,
        http, "application/http;msgtype=response",
    )
    concurrent = {"WARC-Concurrent-To": F.col("response_id")}
    get = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record("request", {"WARC-Record-ID": F.col("request_id")} | concurrent | common, get, "application/http;msgtype=request")
    fields = F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    metadata = _record("metadata", {"WARC-Record-ID": F.col("metadata_id")} | concurrent | common | page, fields, "application/warc-fields")
    answer = F.when(F.col("revisit"), revisit).otherwise(response)
    # One line per capture; the writer ends it with the blank lines that end a record.
    lines = captures.select(F.concat_ws(CRLF * 2, request, answer, metadata).alias("value"))
    lines.write.option("maxRecordsPerFile", per_file).option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def _header(block: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in block.split(b"\r\n")[1:])
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def records(data: bytes) -> Iterator[tuple]:
    """Records of one archive; the Content-Length says where the next one begins."""
    at, start = 0, re.compile(rb"WARC/1\.[01]\r\n")
    while found := start.search(data, at):
        end = data.find(b"\r\n\r\n", found.end() - 2)
        if end < 0:
            break
        head = _header(data[found.start() : end])
        size = int(head.get("content-length") or 0)
        content = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        kind, status, payload = head.get("warc-type"), None, content
        if (head.get("content-type") or "").startswith("application/http") and kind != "request":
            top, _, payload = content.partition(b"\r\n\r\n")
            status = top.partition(b"\r\n")[0].decode("utf-8", "replace")
        page = head.get("warc-page-id")
        declared = head.get("warc-payload-digest")
        yield (
            head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"),
            head.get("warc-target-uri"), head.get("warc-date"), int(page) if page else None, head.get("content-type"), status,
            len(payload), hashlib.sha1(payload).hexdigest(), declared and declared.rpartition(":")[2], payload,
        )


def read_archives(spark: SparkSession, path: str, payloads: bool = True, file_name: str = "*.gz") -> DataFrame:
    """All records under ``path``, gzipped or not; without ``payloads`` their lengths and digests only."""
    import gzip

    kinds = {"long": pa.int64(), "binary": pa.large_binary(), "string": pa.string()}
    fields = [tuple(f.split()) for f in RECORD.split(", ")]

    def batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows))
        if not payloads:
            columns[-1] = [None] * len(rows)
        kind = kinds | {"binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kind[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for value in files.column(0):
                data = value.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for record in records(data):
                    rows.append(record)
                    size += len(record[-1])
                    if size > 4_000_000 or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", file_name).load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: the answer with its request and metadata, joined through WARC-Concurrent-To.

    A capture without request or metadata keeps nulls there; of several the smallest record id counts. A revisit gets length and digest of the payload
    it refers to; if that record is missing, its declared digest and a null length.
    """
    answers = found.where(F.col("type").isin("response", "revisit"))

    def part(kind: str) -> DataFrame:
        rows = found.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        row = F.struct("record_id", "target_uri", "date", "payload")
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(row).alias(kind))

    first = F.struct("record_id", "type", "target_uri", "date", "http_status", "content_type", "payload")
    own = F.col("type") == "response"
    captures = answers.select(
        "record_id", "page_id", "type", "refers_to", first.alias("answer"),
        F.when(own, F.col("payload_bytes")).alias("own_bytes"),
        F.when(own, F.col("payload_digest")).otherwise(F.col("declared_digest")).alias("own_digest"),
    )
    referred = answers.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page"),
        F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"),
    )
    joined = captures.join(part("request"), "record_id", "left").join(part("metadata"), "record_id", "left")
    joined = joined.join(referred, "refers_to", "left")
    return joined.select(
        "page_id", "type", "refers_page", "answer", "request", "metadata",
        F.coalesce("own_bytes", "full_bytes").alias("payload_bytes"),
        F.coalesce("full_digest", "own_digest").alias("payload_digest"),
    )

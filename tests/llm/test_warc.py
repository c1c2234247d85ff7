import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patronlens.llm import warc
from patronlens.staging import new_path

PAGES = "page_id long, url string, html string, digest string, type string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def captures(spark, pages, **options):
    path = new_path(spark, "warc")
    warc.write_archives(pages, path, **options)
    return warc.assemble(warc.read_archives(spark, path))


def brute(rows):
    largest = {}
    for at, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        if len(data) >= 1000:
            rank = (page is not None, page or 0)
            largest[data] = max(largest.get(data, (rank, at)), (rank, at), key=lambda x: x[0])
    out = []
    for at, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        kept = largest.get(data)
        revisit = kept is not None and kept[1] != at
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", rows[kept[1]][0] if revisit else None))
    return Counter(out)


def result(found):
    rows = found.select("page_id", "payload_bytes", "payload_digest", "type", "refers_page").collect()
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def rows():
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40
    same, big = "é" * 700, "z\n" * 300_000
    return [
        (1, "http://a/", same), (9, "http://b/", same), (4, None, same), (2, "http://c/", "x" * 999), (3, "http://d/", "x" * 999),
        (5, "http://e/ f\r\ng", tricky), (6, "http://f/", tricky), (7, "", None), (8, "http://g/", ""), (10, "http://h/", big), (None, "http://i/", same),
        (11, "http://j/", "\r\n\r\n\x00\x01"), (12, "http://日本/", "日本語" * 500),
    ]


@pytest.mark.parametrize("size", [warc.FILE_BYTES, 100_000])
def test_round_trip(spark, rows, size):
    found = captures(spark, pages_of(spark, rows), file_bytes=size)
    assert result(found) == brute(rows)
    answers = {r["page_id"]: r for r in found.collect()}
    assert bytes(answers[5]["answer"]["payload"]).decode() == "" or bytes(answers[6]["answer"]["payload"]).decode() == rows[6][2]
    assert all(r["request"] is not None and r["metadata"] is not None for r in found.collect())
    assert answers[5]["request"]["target_uri"] == "http://e/%20f%20g"


def test_repeated_rows(spark):
    rows = [(1, "http://a/", "q" * 2000)] * 3 + [(2, "http://a/", "short")] * 2
    found = result(captures(spark, pages_of(spark, rows)))
    digest = hashlib.sha1(b"q" * 2000).hexdigest()
    assert found[1, 2000, digest, "response", None] == 1 and found[1, 2000, digest, "revisit", 1] == 2
    assert sum(found.values()) == 5


def test_no_rows(spark):
    assert captures(spark, pages_of(spark, [])).count() == 0


def test_missing_parts(spark, rows):
    """Records that others do not name, or that name what is missing, do not lose a capture."""
    path = new_path(spark, "warc")
    warc.write_archives(pages_of(spark, rows), path)
    records = warc.read_archives(spark, path)
    answers = records.where("type in ('response', 'revisit')")
    lone = warc.assemble(answers.where("type = 'revisit'"))
    assert lone.where("request is not null or metadata is not null or payload_bytes is not null").count() == 0
    assert lone.count() == answers.where("type = 'revisit'").count() > 0
    assert lone.where("length(payload_digest) = 40").count() == lone.count()
    doubled = records.unionByName(records.where("type = 'request'").withColumn("record_id", F.lit("<other>")))
    assert warc.assemble(doubled).count() == len(rows)


def test_records_by_length():
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
    content = b"HTTP/1.1 200 OK\r\n\r\n" + b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    data = (head % len(content)) + content + b"\r\n\r\n" + (head % 0) + b"\r\n\r\n"
    found = list(warc.records(data))
    assert [r[0] for r in found] == ["<a>", "<a>"] and found[0][-1].endswith(b"abc") and found[1][-1] == b""
    assert list(warc.records(b"")) == [] and list(warc.records(b"no archive")) == []


def test_any_order_of_rows(spark, tmp_path):
    """Partitions, their order and a round-robin shuffle between decide nothing; equal rows are captures of their own."""
    rows = [(i, f"http://h/{i}", f"{i % 50} " * 600) for i in range(400)] + [(7, "http://h/7", "7 " * 600)] * 3 + [(8, "u", "x" * 1500)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    forms = [pages, pages.repartition(5), pages.repartition(5, "page_id"), pages.union(pages.limit(0)), pages.orderBy("url"), pages.repartition(9).coalesce(2)]
    found = []
    for i, form in enumerate(forms):
        path = str(tmp_path / f"w{i}")
        warc.write_archives(form, path)
        got = warc.assemble(warc.read_archives(spark, path))
        found.append(sorted((r["page_id"], r["type"], r["refers_page"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got.collect()))
    assert len(found[0]) == 405 and all(f == found[0] for f in found)
    assert [r[1] for r in found[0]].count("response") == 51
    assert all(r[2] == max(p for p, _, t in rows if t == f"{r[0] % 50} " * 600) for r in found[0] if r[1] == "revisit" and r[3] != 1500)

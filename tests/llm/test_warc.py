import gzip
import random
import time

from itemspark.llm import warc
from itemspark.session import staging_path


def test_records_and_transactions(spark):
    """Repeats, small and null payloads, record marks inside pages, repeated rows."""
    same, nasty = "x" * 100, "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 3
    rows = [(5, "http://a/5", same, 1), (3, "http://a/3 q\r\nX: y", same, 1), (9, None, same, 1), (None, "http://n", same, 1),
            (1, "http://a/1", "tiny", 1), (2, "http://a/2", "tiny", 1), (4, "u4", None, 1), (6, "u6", "", 1),
            (7, "u7", nasty, 1), (8, "u8", nasty + "é", 1), (3, "http://a/3 q\r\nX: y", same, 1), (10, "long", "é" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    path = staging_path(spark, "warc-test")
    warc.write_pages(pages, path)
    got = warc.page_captures(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in by[3]] == ["response", "response"]
    for page in (5, 9, None):
        assert [(r["record_type"], r["response_page"], r["response_bytes"]) for r in by[page]] == [("revisit", 3, 100)]
        assert by[page][0]["payload_digest"] == by[3][0]["payload_digest"]
    for page, url, html, _ in rows:
        if page not in (5, 9, None):
            r = by[page][0]
            assert bytes(r["block"]).decode() == (html or "") and r["payload_bytes"] == len((html or "").encode())
            assert bytes(r["request"]["http"]).startswith(b"GET ") and r["url"] == url
    assert all(r["metadata"] is not None for r in got)
    kinds = [r["record_type"] for r in warc.read_records(spark, path).collect()]
    assert kinds.count("request") == kinds.count("metadata") == len(rows)


def test_parser_takes_gzip_members_and_stops_at_damage():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = warc.plain(gzip.compress(record) + gzip.compress(record))
    assert [(h["warc-type"], data[a:b]) for h, a, b in warc.parse(data)] == [("resource", b"abc")] * 2
    assert len(list(warc.parse(record + b"junk" + record))) == 1


def test_captures_without_partners(spark):
    rows = [("response", "r1", None, None, "u", "d", None, None), ("request", "q2", "r1", None, "u", None, None, None),
            ("request", "q1", "r1", None, "u", None, None, None), ("metadata", "m1", "gone", None, "u", None, None, None),
            ("revisit", "r2", None, "r9", None, None, None, None), ("warcinfo", "w", None, None, None, None, None, None)]
    found = {r["record_id"]: r for r in warc.captures(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert set(found) == {"r1", "r2"}
    assert found["r1"]["request"]["record_id"] == "q1" and found["r1"]["metadata"] is None
    assert found["r2"]["request"] is None


def test_empty_table(spark):
    path = staging_path(spark, "warc-empty")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_captures(spark, path).count() == 0


def test_many_gzip_members_cost_in_proportion():
    """Unpacking doesn't copy the rest of the file for every member."""
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3000\r\n\r\n" + random.Random(3).randbytes(3000) + b"\r\n\r\n"
    member = gzip.compress(record)

    def seconds(n):
        begin = time.process_time()
        assert len(warc.plain(member * n)) == n * len(record)
        return time.process_time() - begin

    seconds(100)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.01)


def test_large_members_and_cut_off_files():
    data = random.Random(4).randbytes(300_000)
    packed = gzip.compress(data)
    assert warc.plain(packed + packed) == data + data
    assert data.startswith(warc.plain(packed[:100_000]))
    assert warc.plain(b"") == b""


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "PAGE_CLASSES", (100, 1000))
    rows = [(i, "u", f"{i:04d}" * n) for i, n in enumerate([20] * 90 + [200] * 12 + [2000] * 3)]
    path = staging_path(spark, "warc-bytes")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    held = [sum(h["warc-type"] == "response" for h, _, _ in warc.parse(warc.plain(bytes(f["content"])))) for f in files]
    assert sorted(held) == sorted([40, 40, 10] + [4] * 3 + [1] * 3)
    assert warc.page_captures(spark, path).count() == len(rows)

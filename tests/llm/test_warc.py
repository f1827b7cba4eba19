import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from levelgrid.llm import warc
from levelgrid.session import workspace

PAGES = "page_id long, url string, html string, digest string, first long"
ROWS = [
    {"page_id": 1, "html": None},
    {"page_id": 2, "url": "http://a b/\r\nX-Page-Id: 9", "html": ""},
    {"page_id": 3, "html": "x" * 99, "digest": "clash", "first": 1},
    {"page_id": 4, "html": "x" * 99},
    {"page_id": 6, "html": "é" * 50},
    {"page_id": 5, "html": "é" * 50},
    {"page_id": 5, "html": "é" * 50},
    {"page_id": 7, "html": "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 900 + "\r\n\r\n0\r\n\r\n"},
    {"page_id": None, "html": "no id " * 30},
    {"page_id": 8, "html": "😀ß\n" * 40_000},
]


def expected(rows):
    firsts = {}
    for r in rows:
        h = (r.get("html") or "").encode()
        if len(h) >= 100 and r["page_id"] is not None:
            firsts[h] = min(firsts.get(h, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        h = (r.get("html") or "").encode()
        first = firsts.get(h, r["page_id"])
        other = first != r["page_id"]
        out.append((r["page_id"], len(h), hashlib.sha256(h).hexdigest(), "revisit" if other else "response", first if other else None))
    return sorted(out, key=str)


def test_round_trip(frame):
    pages = frame(PAGES, ROWS)
    found = warc.round_trip(pages.repartition(3)).collect()
    assert all(r.complete for r in found)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected(ROWS)
    assert warc.round_trip(frame(PAGES)).collect() == []


def test_payloads_come_back_whole(spark, frame):
    pages = frame(PAGES, ROWS)
    path = f"{workspace(spark)}/warc-test/{random.random()}"
    warc.write_archives(pages, path, segment=1000)
    records = warc.read_archives(spark, path)
    assert records.filter("record_type = 'continuation'").count() > 100
    found = warc.payloads(warc.reassemble(records.repartition(7))).filter("record_type = 'response'").collect()
    want = sorted(r.get("html") or "" for r in ROWS if r["page_id"] != 6)
    assert sorted(bytes(r.payload).decode() for r in found) == want


def test_missing_and_repeated_segments(spark, frame):
    pages = frame(PAGES, [{"page_id": 1, "html": "abc" * 2000}])
    path = f"{workspace(spark)}/warc-test/{random.random()}"
    warc.write_archives(pages, path, segment=1000)
    records = warc.read_archives(spark, path)
    for broken in (records.filter("segment is null or segment <> 3"), records.filter("total_length is null"), records.unionByName(records.filter("segment = 2"))):
        row = warc.payloads(warc.reassemble(broken)).first()
        assert row.page_id == 1 and not row.complete and row.payload is None


@pytest.mark.parametrize("body", [b"", b"a", b"x" * 10_000, b"\r\n0\r\n\r\n" * 999])
def test_chunks(body):
    assert warc.dechunked(warc.chunked(body, 777)) == body
    assert warc.dechunked(warc.chunked(body)[:-5] if body else b"") is None


def test_chunk_extensions_and_faults():
    assert warc.dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert warc.dechunked(b"zz\r\nabc\r\n0\r\n\r\n") is None
    assert warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n") is None


def test_files_are_plain_records(spark, frame):
    path = f"{workspace(spark)}/warc-test/{random.random()}"
    warc.write_archives(frame(PAGES, ROWS[:4]).coalesce(1), path)
    lines = spark.read.text(path).filter(F.col("value").startswith("WARC/1.1")).count()
    assert lines == 4


def foreign(n, body=b"hello", version=b"WARC/1.0", length=None, kind=b"resource"):
    size = b"%d" % len(body) if length is None else length
    return version + b"\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: " % n + size + b"\r\n\r\n" + body + b"\r\n\r\n"


def store(spark, name, data):
    """A file written the way a crawler would, not by Spark."""
    folder = f"{workspace(spark)}/warc-test/{random.random()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/deep/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    return folder


@pytest.mark.parametrize("name", ["crawl-0001.warc.gz", "part-1.warc"])
def test_members_versions_and_names(spark, name):
    records = [foreign(1), foreign(2, b"", b"WARC/1.1"), foreign(3, b"WARC/1.0\r\nnot one\r\n\r\n" * 3)]
    data = b"".join(gzip.compress(r) for r in records) if name.endswith("gz") else b"".join(records)
    found = warc.reassemble(warc.read_archives(spark, store(spark, name, data))).collect()
    assert sorted((r.record_id, r.record_type, len(r.block), r.complete) for r in found) == [
        ("<urn:x:1>", "resource", 5, True), ("<urn:x:2>", "resource", 0, True), ("<urn:x:3>", "resource", 63, True)
    ]


def test_bad_lengths_are_incomplete_records(spark):
    data = foreign(1, length=b"many") + foreign(2) + foreign(3, length=b"") + foreign(4) + foreign(5, length=b"999")
    found = warc.payloads(warc.reassemble(warc.read_archives(spark, store(spark, "a.warc", data)))).collect()
    assert sorted(r.complete for r in found) == [False, False, False, True, True]


def test_archives_read_together(spark, frame):
    base = f"{workspace(spark)}/warc-test/{random.random()}"
    for i in (1, 2):
        warc.write_archives(frame(PAGES, [{"page_id": i, "html": f"{i}" * 40_000}]), f"{base}/{i}")
    found = warc.payloads(warc.reassemble(warc.read_archives(spark, base))).collect()
    assert sorted((r.page_id, bytes(r.payload) == b"%d" % r.page_id * 40_000, r.complete) for r in found) == [(1, True, True), (2, True, True)]

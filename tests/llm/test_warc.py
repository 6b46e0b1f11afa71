"""WARC archives: the records read back against plain Python, the chunk table against the payloads."""

import base64
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from kiln.llm import warc
from kiln.llm.common import shared_path

PAGES = "page_id long, url string, html string, record int, data string, last boolean, sha1 int"
ODD = [
    (5, "http://a.example/x y\r\nX-Evil: 1", "same"), (3, "http://a.example/2", "same"), (9, None, "same"),
    (4, "u", None), (2, "u", ""), (None, "u", ""), (7, "u%20é", "é漢😀" * 50), (8, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"),
    (11, "u", "12345678"), (12, "u", "1234567812345678"), (13, "u", "x" * 5000), (13, "u", "x" * 5000), (1, "u", "é漢😀" * 50),
    (None, None, "alone"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", True, 2) for r in rows], PAGES)


def brute(rows):
    """Sorted ``(page_id, bytes, digest, type, refers_to)``."""
    out, groups = [], {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is None, page or 0, i))
    for data, members in groups.items():
        members.sort()
        first = None if members[0][0] else members[0][1]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for k, (none, page, _) in enumerate(members):
            out.append((None if none else page, len(data), digest, "revisit" if k else "response", first if k else None))
    return sorted(out, key=str)


def read_back(spark, rows, **options):
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_warc(table(spark, rows), folder, **options)
    back = warc.resolve_revisits(warc.read_records(spark, folder, manifest))
    got = back.select(F.col("id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_id").cast("long"))
    return sorted(map(tuple, got.collect()), key=str), folder, manifest


@pytest.mark.parametrize("chunk_bytes", [8, 1 << 20])
def test_records_equal_plain_python(spark, chunk_bytes):
    got, folder, manifest = read_back(spark, ODD, chunk_bytes=chunk_bytes)
    assert got == brute(ODD)
    # each record is a gzip member of its own, at the place the manifest names
    root = folder.removeprefix("file:")
    for r in manifest.collect():
        with open(os.path.join(root, r["file"]), "rb") as f:
            f.seek(r["offset"])
            text = gzip.GzipFile(fileobj=io.BytesIO(f.read(r["length"]))).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n") and b"\r\nX-Evil" not in text


def test_smaller_payloads_than_the_minimum_are_responses(spark):
    got, _, _ = read_back(spark, ODD, min_bytes=100)
    assert {r[3] for r in got if r[1] < 100} == {"response"}
    assert [r[3] for r in got if r[1] == 5000].count("revisit") == 1


def test_empty_table(spark):
    assert read_back(spark, [])[0] == []


def test_chunk_rows_carry_running_digests(spark):
    payload = "é漢😀 long " * 3000
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_warc(table(spark, [(1, "http://x/ 1", payload), (2, "b", "")]), folder, chunk_bytes=1000)
    rows = sorted(warc.read_chunks(spark, folder, manifest).collect(), key=lambda r: (r["id"], r["chunk_no"]))
    # the reader's chunks follow its own bound; together they are the payload
    long = [r for r in rows if r["id"] == "1"]
    assert b"".join(r["data"] for r in long) == payload.encode() and long[0]["url"] == "http://x/ 1"
    seen = b""
    for r in long:
        seen += r["data"]
        assert r["n_bytes"] == len(seen) and r["sha1"] == hashlib.sha1(seen).digest() and r["last"] == (len(seen) == len(payload.encode()))
    assert [(r["chunk_no"], r["last"], r["n_bytes"]) for r in rows if r["id"] == "2"] == [(0, True, 0)]


def test_long_payloads_are_cut_and_small_steps_unzip(spark):
    data = os.urandom(300_000).hex().encode()
    out = io.BytesIO()
    w = warc.RecordWriter(out, "1970-01-01T00:00:00Z")
    w.start(1, "1", "u", len(data), hashlib.sha1(data).digest(), None)
    for i in range(0, len(data), 777):
        w.chunk(data[i : i + 777])
    w.finish()
    got = list(warc.iter_chunks(io.BytesIO(out.getvalue()), chunk_bytes=4096))
    assert max(len(x[5]) for x in got) == 4096 and b"".join(x[5] for x in got) == data and got[-1][2]
    with pytest.raises(ValueError):
        list(warc.iter_chunks(io.BytesIO(out.getvalue()[:-300])))
    w.start(2, "2", "u", 4, hashlib.sha1(b"abcd").digest(), None)
    w.chunk(b"abce")
    with pytest.raises(ValueError):
        w.finish()


def test_a_third_of_all_pages_alike(spark):
    rows = [(i, f"u{i}", "copy" if i % 3 else f"own {i}") for i in range(900)]
    assert read_back(spark, rows)[0] == brute(rows)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op11(spark, sf).collect()), key=str) == brute(pages)

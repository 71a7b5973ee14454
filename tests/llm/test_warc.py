import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from endpointlens.llm import warc
from endpointlens.llm.common import new_folder


def want(rows, at_least=0):
    """Expected rows by the definition."""
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(i, best.get(html or "", i))
    out = set()
    for i, _, html in rows:
        data = (html or "").encode()
        full = len(data) < at_least or i == best.get(html or "")
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.add((i, len(data), digest, "response" if full else "revisit", None if full else best[html or ""], True))
    return out


@pytest.mark.parametrize("at_least", [0, 20])
def test_round_trip(spark, at_least):
    long = "ä€WARC/1.0\r\n\r\n0\r\n\r\n" * 9000
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\r\nX: y", long), (4, "u", long + "z"), (5, "u", None),
            (6, "u", ""), (7, "u", "x"), (8, "u", long), (8, "u", long), (8, "u", "other payload of the same id"), (None, "u", "x"),
            (-4, "u", "negative id")]
    path = new_folder(spark)
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int")
    warc.write_pages(pages, path, at_least, segment=700, chunk=64, records_per_file=9)
    got = [tuple(r) for r in warc.read_pages(spark, path).collect()]
    assert set(got) == want(rows, at_least) and len(got) == len(set(got))
    texts = {r.payload.decode() for r in warc.read_records(spark, path).where("payload IS NOT NULL").collect()}
    assert texts == {h or "" for _, _, h in rows}


def test_archives_are_gzip_files_of_whole_records(spark):
    path = new_folder(spark)
    warc.write_pages(spark.createDataFrame([(1, "u", "abc" * 500)], "page_id long, url string, html string"), path, segment=600)
    archives = [r.content for r in spark.read.format("binaryFile").load(path).collect()]
    records = [record for a in archives for _, record in warc.members_of(a)]
    assert len(records) == 3 and all(r.startswith(b"WARC/1.0\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    assert records[-1].count(b"WARC-Segment-Total-Length") + records[0].count(b"WARC-Segment-Total-Length") == 1


def test_damage_is_reported():
    packed = warc.response(1, "u", "D", b"x" * 2000, 500, 64)
    parts = list(enumerate(packed, 1))
    digest = base64.b32encode(hashlib.sha1(b"x" * 2000).digest()).decode()
    packed = warc.response(1, "u", digest, b"x" * 2000, 500, 64)
    origin = warc.record_id(1, digest)
    parts = list(enumerate(packed, 1))
    assert warc.reassemble(origin, parts[::-1])[5:] == (b"x" * 2000, True)
    for broken in (parts[1:], parts[:-1], parts[:1] + parts[2:]):
        assert warc.reassemble(origin, broken)[5:] == (None, False)
    assert warc.unchunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert warc.unchunked(b"5\r\nhell") is None and warc.unchunked(b"") is None and warc.unchunked(b"-1\r\n") is None
    assert zlib.decompress(packed[0], 31).startswith(b"WARC/1.0")


def test_empty_table(spark):
    path = new_folder(spark)
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).select(F.col("page_id")).count() == 0

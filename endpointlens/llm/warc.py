"""WARC archives: writing pages, and reading them back with their segments put together.

Writing. A payload becomes an HTTP response in chunked transfer framing; a block longer than the
segment size is cut into a first record and continuation records. Of equal payloads only the page
with the largest id is written in full, the others as revisit records that refer to it. Every
record is a gzip member of its own, so a file is a usual `.warc.gz`; files hold a bounded number
of records, and each record is bounded by the segment size.

Reading. A scan of the archives yields one row per record with its origin and segment number;
members stay compressed. Records are grouped by origin, ordered by segment number, checked
against the total length that the last segment states, and freed of their chunk framing. Revisits
take length and digest from the record they refer to. A group holds the segments of one record
and nothing else, however popular its payload is.

Defined cases: a null payload counts as empty; a null url is written as an empty one; pages of one id and
payload are one page and read back as one row; one id with several payloads is several pages; a page
without an id is written and read, and revisits the others of its payload. A record with a missing segment, a wrong total or broken
framing is returned with `complete` false and no payload. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, store

SEGMENT, CHUNK, RECORDS_PER_FILE, LEVEL = 16384, 4096, 2000, 5
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """Payload of chunked framing; None if the framing is broken. Extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(b"[0-9A-Fa-f]+", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        if body[end + 2 + n:end + 4 + n] != b"\r\n":
            return None
        parts.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def member(headers: dict[str, object], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    record = b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def record_id(page: object, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def response(page: int | None, url: str | None, digest: str, payload: bytes, segment: int, chunk: int) -> list[bytes]:
    """Members of a page written in full: a response record and its continuations."""
    block = HTTP_HEAD + chunked(payload, chunk)
    name = record_id(page, digest)
    head = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Target-URI": re.sub(r"[\r\n]", "", url or ""),
            "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if len(block) <= segment:
        return [member(head, block)]
    cuts = [block[i:i + segment] for i in range(0, len(block), segment)]
    out = [member(head | {"WARC-Segment-Number": 1}, cuts[0])]
    for n, cut in enumerate(cuts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:{n}>", "WARC-Segment-Origin-ID": name,
                "WARC-Segment-Number": n}
        out.append(member(more | ({"WARC-Segment-Total-Length": len(block)} if n == len(cuts) else {}), cut))
    return out


def write_pages(pages: DataFrame, path: str, at_least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK,
                records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes (page_id, url, html) as archives; payloads of fewer than `at_least` bytes are never revisits."""
    ready(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("sha1", F.sha1("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [response(page, url, digest_of(sha1), payload, segment, chunk)
                       for page, url, payload, sha1 in zip(*(c.to_pylist() for c in batch.columns))]
            sizes = [len(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()),
                 pa.array(members, pa.list_(pa.binary()))], ["page_id", "url", "sha1", "bytes", "members"])

    # Compressed members are shuffled, not payloads; adaptive execution splits a hot payload's copies.
    packed = rows.mapInArrow(pack, "page_id long, url string, sha1 string, bytes long, members array<binary>")
    latest = rows.groupBy("sha1").agg(F.max("page_id").alias("latest"))
    full = (F.col("bytes") < at_least) | F.col("page_id").eqNullSafe(F.col("latest"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, sha1, latest, full, members in zip(*(c.to_pylist() for c in batch.columns)):
                if full:
                    out += members
                    continue
                digest = digest_of(sha1)
                head = {"WARC-Type": "revisit", "WARC-Record-ID": record_id(page, digest),
                        "WARC-Target-URI": re.sub(r"[\r\n]", "", url or ""), "WARC-Payload-Digest": f"sha1:{digest}",
                        "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                        "WARC-Refers-To": record_id(latest, digest)}
                out.append(member(head, b""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    decided = packed.join(latest, "sha1").select(
        "page_id", "url", "sha1", "latest", full.alias("full"),
        F.when(full, F.col("members")).alias("members"))
    # Zero bytes between members are padding to every gzip reader.
    (decided.mapInArrow(emit, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path))


def digest_of(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def split_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return headers, rest[:int(headers.get("Content-Length", 0))]


def members_of(archive: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(compressed member, record) one by one; zero padding is passed over."""
    rest = archive.lstrip(b"\0")
    while rest:
        opened = zlib.decompressobj(31)
        record = opened.decompress(rest) + opened.flush()
        after = opened.unused_data
        yield rest[:len(rest) - len(after)], record
        rest = after.lstrip(b"\0")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, uri, refers_to, payload_digest, payload, complete) of every record, with
    continuation records put back into their origin."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                origin, number, packed = [], [], []
                for compressed, record in members_of(archive.as_py()):
                    headers, _ = split_record(record)
                    origin.append(headers.get("WARC-Segment-Origin-ID") or headers["WARC-Record-ID"])
                    number.append(int(headers.get("WARC-Segment-Number", 1)))
                    packed.append(compressed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(origin, pa.string()), pa.array(number, pa.int32()), pa.array(packed, pa.binary())],
                    ["origin", "number", "member"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "type", "uri", "refers_to", "payload_digest", "payload", "complete"]
        types = [pa.string()] * 5 + [pa.binary(), pa.bool_()]
        for batch in batches:
            rows = [reassemble(origin, [(s["number"], s["member"]) for s in segments])
                    for origin, segments in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    ready(spark)
    scanned = (spark.read.format("binaryFile").load(path).select("content")
               .mapInArrow(scan, "origin string, number int, member binary"))
    grouped = scanned.groupBy("origin").agg(F.collect_set(F.struct("number", "member")).alias("segments"))
    return grouped.mapInArrow(rebuild, "record_id string, type string, uri string, refers_to string, "
                                       "payload_digest string, payload binary, complete boolean")


def reassemble(origin: str, segments: list[tuple[int, bytes]]) -> tuple:
    """One logical record of its segments, checked for gaps, total length, framing and digest."""
    one_each = dict(sorted(segments, reverse=True))
    parts = [(number, *split_record(zlib.decompress(one_each[number], 31))) for number in sorted(one_each)]
    first, last = parts[0][1], parts[-1][1]
    block = b"".join(p[2] for p in parts)
    whole = [p[0] for p in parts] == list(range(1, len(parts) + 1)) and first.get("WARC-Record-ID") == origin
    if "WARC-Segment-Number" in first or len(parts) > 1:
        whole &= last.get("WARC-Segment-Total-Length") == str(len(block))
    kind = first.get("WARC-Type") if first.get("WARC-Record-ID") == origin else None
    payload, digest = None, first.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    if whole and kind != "revisit":
        head, mark, body = block.partition(b"\r\n\r\n")
        framed = mark and re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head)
        payload = unchunked(body) if framed else body if mark else block
        if payload is not None and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            payload = None
        whole = payload is not None
    return origin, kind, first.get("WARC-Target-URI"), first.get("WARC-Refers-To"), digest, payload, whole


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, complete) of archives that
    `write_pages` wrote; a revisit takes its length from the record it refers to."""
    number = F.nullif(F.regexp_extract("record_id", "^<urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")
    referred = F.nullif(F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")
    records = read_records(spark, path).select(
        "record_id", "type", "refers_to", "payload_digest", "complete",
        F.octet_length("payload").cast("long").alias("own_bytes"))
    # The refers-to header of a record in full names the record itself, so that one join serves both kinds.
    records = store(records.withColumn("source", F.coalesce("refers_to", "record_id")))
    full = records.where("type = 'response'").select(F.col("record_id").alias("source"), F.col("own_bytes").alias("payload_bytes"),
                                                     F.col("complete").alias("source_complete"))
    return records.where("type IS NOT NULL").join(full, "source", "left").select(
        number.alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", referred).alias("refers_to"),
        (F.col("complete") & F.coalesce("source_complete", F.lit(False))).alias("complete"))


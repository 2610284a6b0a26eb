"""WARC archives: writing records, reading them back, putting captures together.

Archives are written by Spark's text writer, whose commit protocol survives lost
executors and whose paths may lie in any store.  Each record is a gzip member of
its own.  The writer ends a row with a separator; a member ends with the high
byte of its length, which is zero below 16 MB, so the separator is that zero byte
and the row is the member without it.  Longer records take several members.  A
file is therefore exactly a sequence of gzip members.

Of equal payloads one is stored whole (``response``) and the others are
``revisit`` records that refer to it.  Rows are matched with their roles by a key
of id, URL and digest, so equal payloads, however many, never meet in one task.

Reading: archives come back as whole files, which hold ``ARCHIVE`` bytes of
payload and headers on average, however large the corpus; records are cut by
their lengths, never by looking for separators.  A
capture is the group of records that name the same record as concurrent, and the
group is reduced by aggregates without collecting it.

Defined cases: a null payload is empty; a null id sorts before all others; rows
with equal ids and payloads are told apart by a running number, the last one is
the response; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import least_by, scratch_path, spread

#: A gzip member holds less than this, so that the last byte of its length is zero.
MEMBER = (1 << 24) - (1 << 16)
LEVEL = 2
#: Bytes of an archive before compression, about, and of the records of a capture beside the payload.
ARCHIVE = 64 << 20
HEADS = 1500
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with ``copy``, ``record_type`` and ``refers_to``/``refers_copy``.

    Of rows whose payloads are equal and have ``least`` bytes or more, the one
    with the largest id is the response; smaller payloads are all responses.
    """
    p = pages.withColumn("_sha", F.sha1("payload")).withColumn("_url", F.xxhash64("url"))
    key = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("_url").cast("string"), F.col("_sha"))
    size = p.agg(F.sum(F.octet_length("payload") + HEADS)).first()[0] or 0
    p = p.withColumn("_key", key)
    rows = p.filter(F.octet_length("payload") >= least).groupBy("_key", "_sha", "page_id", "_url").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_me", F.struct("page_id", "_url", "_n"))
    facts = least_by(rows, "_sha", "_me", "_best", salt="_key", pick=F.max).select("_key", "_best", (F.col("_best.page_id").eqNullSafe(F.col("page_id")) & (F.col("_best._url") == F.col("_url"))).alias("_is"))
    # One shuffle of the payloads, into as many archives as keep each small.
    p = p.repartition(max(spread(pages.sparkSession), -(-size // ARCHIVE)), "_key")
    p = p.join(facts, "_key", "left").withColumn("copy", F.row_number().over(Window.partitionBy("_key").orderBy("_url")))
    whole = F.col("_best").isNull() | (F.col("_is") & (F.col("copy") == F.col("_best._n")))
    return p.select(
        "page_id", "url", "payload", "copy", F.when(whole, "response").otherwise("revisit").alias("record_type"),
        F.when(~whole, F.col("_best.page_id")).alias("refers_to"), F.when(~whole, F.col("_best._n").cast("int")).alias("refers_copy"),
        F.when(~whole, F.col("_best._url")).alias("refers_url"), F.col("_url").alias("url_key"),
    )


def record_id(page_id: int | None, url_key: int, copy: int, kind: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{url_key}:{copy}:{kind}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes, level: int = LEVEL) -> bytes:
    """data as gzip members; the last byte, a zero, is left to the writer's separator."""
    out = []
    for at in range(0, max(1, len(data)), MEMBER):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(packer.compress(data[at : at + MEMBER]) + packer.flush())
    return b"".join(out)[:-1]


def capture_records(page_id: int | None, url: str | None, payload: bytes, copy: int, role: str, refers: str | None, url_key: int) -> list[bytes]:
    """The response or revisit record of a page, and its request and metadata records."""
    own = record_id(page_id, url_key, copy, "response")
    uri = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    about = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is None:
        main = record("response", about, http + payload)
    else:
        main = record("revisit", [*about, ("WARC-Refers-To", refers), ("WARC-Profile", PROFILE)], http)
    try:
        host, path = urlsplit(uri).netloc, urlsplit(uri).path
    except ValueError:
        host, path = "", uri
    ask = f"GET {path or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    asked = record("request", [("WARC-Record-ID", record_id(page_id, url_key, copy, "request")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], ask)
    told = record("metadata", [("WARC-Record-ID", record_id(page_id, url_key, copy, "metadata")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], b"fetchTimeMs: 0\r\n")
    return [asked, main, told]


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """A request, a response or revisit, and a metadata record for each row of pages (page_id, url, payload)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out: list[bytes] = []
                for r in batch.slice(at, 128).to_pylist():
                    refers = record_id(r["refers_to"], r["refers_url"], r["refers_copy"], "response") if r["record_type"] == "revisit" else None
                    out += map(members, capture_records(r["page_id"], r["url"], r["payload"], r["copy"], r["record_type"], refers, r["url_key"]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = roles(pages, least).mapInArrow(work, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def unpack(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of the gzip members in data, one after another."""
    at = 0
    while at < len(data):
        opener, out = zlib.decompressobj(31), []
        while not opener.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = data[at : at + step]
            out.append(opener.decompress(piece))
            at += len(piece)
        at -= len(opener.unused_data)
        yield b"".join(out)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def records(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; a record may span members and is cut by its Content-Length."""
    rest = b""
    for part in unpack(data):
        rest = rest + part if rest else part
        while m := _HEAD.match(rest):
            head = {k.lower(): v for k, v in (line.split(": ", 1) for line in m[1].decode().split("\r\n"))}
            end = m.end() + int(head["content-length"])
            if len(rest) < end + 4:
                break
            yield head, rest[m.end() : end]
            rest = rest[end + 4 :]
    if rest:
        raise ValueError("an archive ends inside a record")


_FIELDS = "record_type string, record_id string, concurrent_to string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives under path; ``payload`` only if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split(" ")[0], pa.int64() if f.endswith("long") else pa.string()) for f in _FIELDS.split(", ")])
        if payloads:
            schema = schema.append(pa.field("payload", pa.binary()))
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                held = 0
                for head, block in records(memoryview(content.as_buffer())):
                    kind, size, digest, payload = head["warc-type"], None, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, digest = len(payload), base32_sha1(payload)
                        else:
                            size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    row = {"record_type": kind, "record_id": head["warc-record-id"], "concurrent_to": head.get("warc-concurrent-to"), "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest}
                    rows.append(row | ({"payload": block if payload is None else payload} if payloads else {}))
                    held += len(block) if payloads else 200
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, _FIELDS + (", payload binary" if payloads else ""))


def assemble(found: DataFrame) -> DataFrame:
    """One row for each capture: capture_id and the structs main, request and metadata, each null if missing.

    A capture is known by the record that others are concurrent to.  Of several
    records of a kind the first by record id is taken, and ``n_records`` counts all.
    """
    whole = F.struct(*[c for c in found.columns if c != "concurrent_to"])
    by = found.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).withColumn("_r", whole)
    pick = lambda *kinds: F.min_by(F.when(F.col("record_type").isin(*kinds), F.col("_r")), F.when(F.col("record_type").isin(*kinds), F.col("record_id")))
    return by.groupBy("capture_id").agg(pick("response", "revisit", "resource").alias("main"), pick("request").alias("request"), pick("metadata").alias("metadata"), F.count(F.lit(1)).alias("n_records"))


def page_of(record: str) -> Column:
    """The page id in a record id of ``record_id``."""
    got = F.regexp_extract(F.col(record), "^<urn:page:(-?[0-9]+):", 1)
    return F.when(got != "", got.cast("long"))


def round_trip(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) written as archives and read back as captures."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages.select("page_id", "url", F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload")), path, least)
    return assemble(read(spark, path))

"""WARC archives: records with chunked HTTP blocks, cut into segments when long, written and put together again."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import new_path, written

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_RECORDS = 4096
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. ValueError if it is malformed or cut off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size is cut off")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[end + 2 : at])
        at += 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(_END)
    if not found or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record_id(page_id: int | None, turn: int, segment: int = 1) -> str:
    return uuid.UUID(bytes=hashlib.md5(f"{page_id}/{turn}/{segment}".encode()).digest(), version=5).urn


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id: int | None, url: str | None, payload: bytes, turn: int, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of a page, each without the blank lines that end it."""
    uri = "".join(c for c in (url or f"urn:page:{page_id}") if c > " ")
    common = [("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", uri)]
    own = [("X-Page-Id", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id(page_id, turn)}>"), *common, *own, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")], head)
        return
    block = head + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", f"<{record_id(page_id, turn, k)}>"), *common, *(own if k == 1 else [])]
        if len(parts) > 1:
            fields += [("WARC-Segment-Number", k)]
            fields += [("WARC-Segment-Origin-ID", f"<{record_id(page_id, turn)}>")] if k > 1 else []
            fields += [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield _record(fields, part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.find(_END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        if at > len(data):
            raise ValueError("a record is cut off")
        yield fields, data[start:at]
        at += 4


def _expand(data: bytes) -> bytes:
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        data = one.unused_data
    return b"".join(out) if out else data


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html; null html: empty) to gzipped archives under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id (null last)
    is a response and the others revisit it; of repeated rows one is the response. A response whose block
    exceeds ``segment_bytes`` goes on in continuation records. Extra columns aren't read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sha = F.sha2("payload", 256)
    key = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), sha)  # never null, so that join and window share one shuffle
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", key)
    ids, _ = written(rows.select("key", "page_id", sha.alias("sha"), (F.octet_length("payload") >= least_bytes).alias("large")).distinct(), "warc-ids")
    first = ids.where("large").groupBy(F.col("sha").alias("_sha")).agg(F.min("page_id").alias("_first"))
    decided = ids.join(first, (F.col("sha") == F.col("_sha")) & F.col("large"), "left").select("key", "large", "_first")
    turned = rows.join(decided.hint("merge"), "key").withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("url")))
    revisit = F.col("large") & (~F.col("page_id").eqNullSafe(F.col("_first")) | (F.col("turn") > 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for page_id, url, payload, turn, again, first in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    out += page_records(page_id, url, payload, turn, record_id(first, 1) if again else None, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = turned.select("page_id", "url", "payload", "turn", revisit.alias("revisit"), "_first").mapInArrow(run, "value binary")
    lines = records.select(F.col("value").cast("string").alias("value"))  # the same bytes; text files end each with lineSep
    lines.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELDS = ["record_id", "type", "page_id", "refers_to", "digest", "uri", "origin", "segment", "total", "block"]
_SCHEMA = "record_id string, type string, page_id long, refers_to string, digest string, uri string, origin string, segment int, total long, block binary"
_KINDS = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int64(), pa.binary()]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives (plain or gzipped) under ``path``, as it stands."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _FIELDS)

        for batch in batches:
            for content in batch.column(0):
                rows: list = []
                for f, block in parse(_expand(content.as_py())):
                    bare = lambda k, f=f: f[k].strip("<>") if k in f else None
                    number = lambda k, f=f: int(f[k]) if f.get(k) else None
                    rows.append((bare("warc-record-id"), f["warc-type"], number("x-page-id"), bare("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:"), bare("warc-target-uri"), bare("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block))
                    if len(rows) >= 256:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    return files.mapInArrow(run, _SCHEMA)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records: record_id, type, page_id, refers_to, digest, uri, payload, payload_bytes, payload_digest, error.

    Records in segments are grouped by origin, put in order of segment number, and their length is held
    against the total that the last one states; a record isn't longer than its own page. Then the HTTP block's chunks
    are decoded. Where that fails, error says what is wrong and payload is null: a missing or doubled segment, a
    wrong length, a malformed block, or a digest other than the one stated.
    """
    single = segments.where("segment is null").select(*_FIELDS[:6], F.array("block").alias("blocks"), F.lit(None).cast("string").alias("error"))
    origin = F.coalesce("origin", "record_id")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = segments.where("segment is not null").groupBy(origin.alias("record_id")).agg(*(first(c) for c in _FIELDS[1:6]), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    numbers = F.col("parts.segment")
    length = F.aggregate("parts.block", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    error = F.when(~numbers.eqNullSafe(F.sequence(F.lit(1), F.size("parts"))), "segments missing or doubled").when(~F.col("total").eqNullSafe(length), "length differs from the total stated")
    together = grouped.select(*_FIELDS[:6], F.col("parts.block").alias("blocks"), error.alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                payloads, sizes, digests, errors = [], [], [], []
                for kind, stated, blocks, error in zip(*(batch.column(i).to_pylist() for i in (1, 4, 6, 7)), strict=True):
                    payload = None
                    if error is None and kind != "revisit":
                        try:
                            payload = http_payload(b"".join(blocks))
                        except ValueError as e:
                            error = str(e)
                    digest = None if payload is None else base32_sha1(payload)
                    if digest and stated and digest != stated:
                        payload, digest, error = None, None, "digest differs from the one stated"
                    payloads.append(payload), sizes.append(None if payload is None else len(payload)), digests.append(digest), errors.append(error)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(errors, pa.string())], [*_FIELDS[:6], "payload", "payload_bytes", "payload_digest", "error"])

    schema = "record_id string, type string, page_id long, refers_to string, digest string, uri string, payload binary, payload_bytes long, payload_digest string, error string"
    return single.unionByName(together).mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id), error; a revisit has its response's payload."""
    heads, _ = written(records.drop("payload"), "warc-heads")
    responses = heads.where("type = 'response'")
    target = responses.select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.col("error").alias("_error"))
    own = responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "error")
    found = heads.where("type = 'revisit'").join(target, F.col("refers_to") == F.col("_id"), "left")
    lost = F.when(F.col("_id").isNull(), "the record referred to is missing").otherwise(F.col("_error"))
    again = found.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("_page").alias("refers_to"), lost.alias("error"))
    return own.unionByName(again)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(reassemble(read_segments(spark, path)))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     k AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
     b AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1) AS d FROM k)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((d[(5 * i) // 4 + 1] * 16 + coalesce(d[(5 * i) // 4 + 2], 0)) // CAST(pow(2, 3 - (5 * i) % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM b
"""

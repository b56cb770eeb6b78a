"""WARC archives: a writer of one gzip member per record, and a salvage reader.

The writer turns payload rows into records and writes them with Spark's text sink, one member a row. A gzip member
under 16 MiB ends with a zero byte (the top byte of its length), so the sink's row separator, set to that byte, stands
for the last byte of each member; a longer record is followed by an empty member, which ends the same way.
Archives are kept small by maxRecordsPerFile, so that the reader can take a whole archive per row.

The salvage reader takes archives as (path, content) rows. A member or a plain record that fails a check (gzip stream,
version line, header block, Content-Length, block digest, payload digest) is left, and the reader looks for the next
gzip magic or version line from which a record passes all checks; the bytes between are logged as a gap with their
offsets and the reason of the first failure. Within one member that unpacks, the same search runs over its content.

Defined cases: null html is an empty payload; a null or empty url is recorded as urn:page:<id>; control and non-ASCII
characters of urls are percent-encoded; rows without an id are left out (a record needs a name); repeated ids give a
record each; an empty table writes no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsieve.session import scratch_path

RECORDS_PER_FILE = 2000
REVISIT_BYTES = 1000
PIECE = 1 << 15
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

RECORD_FIELDS = (
    "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)
GAP_FIELDS = "gap_start long, gap_end long, reason string"


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, n_bytes, digest, response_id): response_id is the record to refer to, or null.

    Only digests that occur more than once reach the join, and both sides are salted on the id, so one payload that
    fills a third of the table is spread over SALTS tasks."""
    salts = 32
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.where("page_id IS NOT NULL").select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.length(payload).alias("n_bytes"), F.sha1(payload).alias("digest")
    )
    large = rows.where(F.col("n_bytes") >= least)
    shared = large.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("response_id"), F.min("page_id").alias("least_id"))
    shared = shared.where("least_id < response_id").drop("least_id", "n_bytes")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")
    marked = rows.withColumn("salt", salt).join(shared, ["digest", "salt"], "left")
    later = (F.col("n_bytes") >= least) & (F.col("page_id") < F.col("response_id"))
    return marked.select("page_id", "url", "html", "n_bytes", "digest", F.when(later, F.col("response_id")).alias("response_id"))


def _sha1_label(hex_digest: str) -> bytes:
    return b"sha1:" + base64.b32encode(bytes.fromhex(hex_digest))


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, response_id: int | None) -> bytes:
    """One WARC record. A revisit names the response and keeps the length of the payload that it leaves out."""
    uri = quote(url, safe=";/?:@&=+$,#-_.!~*'()%[]") if url else f"urn:page:{page_id}"
    http = HTTP % len(payload)
    block = http if response_id is not None else http + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if response_id is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%d>" % page_id,
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + uri.encode("ascii"),
        b"WARC-Payload-Digest: " + _sha1_label(digest),
        b"WARC-Block-Digest: " + _sha1_label(hashlib.sha1(block).hexdigest()),
        b"Content-Type: application/http;msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if response_id is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % response_id, b"WARC-Profile: " + PROFILE.encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str) -> None:
    """Write every row as a member of a .warc.gz-style archive under `path`."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(start, 256).to_pylist():
                    payload = row["html"].encode() if row["html"] else b""
                    raw = record_bytes(row["page_id"], row["url"], payload, row["digest"], row["response_id"])
                    member = gzip.compress(raw, 3, mtime=0)
                    if member[-1]:
                        member += gzip.compress(b"", 3, mtime=0)
                    out.append(member[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = mark_revisits(pages).mapInArrow(job, "member binary")
    text = members.select(F.col("member").cast("string").alias("value"))
    text.write.option("lineSep", "\x00").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Damaged(Exception):
    pass


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    return out


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at `at`, checked in full, and where it ends."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", version.end())
    if end < 0:
        raise Damaged("header block without an end")
    head = _fields(data[version.end() : end])
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no Content-Length")
    body = end + 4
    stop = body + int(length)
    if stop + 4 > len(data):
        raise Damaged("record is cut short")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where Content-Length says")
    block = data[body:stop]
    label = head.get("warc-block-digest", "")
    if label.startswith("sha1:") and _sha1_label(hashlib.sha1(block).hexdigest()).decode() != label:
        raise Damaged("block digest differs")
    kind, payload = head.get("warc-type", ""), block
    inner = {}
    if head.get("content-type", "").startswith("application/http"):
        cut_at = block.find(b"\r\n\r\n")
        if cut_at < 0:
            raise Damaged("HTTP header without an end")
        payload = block[cut_at + 4 :]
        inner = _fields(block[: cut_at].partition(b"\r\n")[2])
    digest = hashlib.sha1(payload).hexdigest()
    stated = head.get("warc-payload-digest", "")
    if kind == "revisit":
        try:
            digest = base64.b32decode(stated.removeprefix("sha1:")).hex()
        except ValueError as bad:
            raise Damaged("payload digest can't be read") from bad
        full = inner.get("content-length", "")
        n_bytes, payload = (int(full) if full.isdigit() else None), None
    else:
        n_bytes = len(payload)
        if stated.startswith("sha1:") and _sha1_label(digest).decode() != stated:
            raise Damaged("payload digest differs")
    named = head.get("warc-refers-to", "").strip("<>")
    return {
        "record_type": kind,
        "record_id": head.get("warc-record-id", "").strip("<>"),
        "target_uri": head.get("warc-target-uri"),
        "refers_to": named or None,
        "payload_bytes": n_bytes,
        "payload_digest": digest,
        "payload": payload,
    }, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    unpack, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and end < len(data):
            parts.append(unpack.decompress(data[end : end + PIECE]))
            end = min(len(data), end + PIECE)
    except zlib.error as bad:
        raise Damaged("gzip stream is broken") from bad
    if not unpack.eof:
        raise Damaged("gzip stream is cut short")
    return b"".join(parts), end - len(unpack.unused_data)


def salvage(data: bytes, inside: bool = False) -> Iterator[tuple[int, dict | None, tuple[int, int, str] | None]]:
    """Yields (offset, record, None), or (offset, None, gap) for bytes that belong to no sound record."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        found: list = []
        try:
            if not inside and data.startswith(MAGIC, at):
                content, end = _member(data, at)
                found = list(salvage(content, inside=True))
                if content and not any(r for _, r, _ in found):
                    raise Damaged(found[0][2][2])
            else:
                record, end = parse_record(data, at)
                found = [(at, record, None)]
        except Damaged as bad:
            if gap is None:
                gap, reason = at, str(bad)
            following = (VERSION if inside else START).search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, None, (gap, at, reason)
            gap = None
        for _, record, lost in found:
            # What is lost inside a member is logged by the member's own place.
            yield (at, record, None) if record else (at, None, (at, end, lost[2]))
        at = end
    if gap is not None:
        yield gap, None, (gap, len(data), reason)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of (path, content) rows: a row is a record where record_type is set, else a gap."""

    fields = [f.split() for f in f"{RECORD_FIELDS}, {GAP_FIELDS}".split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                path, content = batch.column(0)[n].as_py(), batch.column(1)[n].as_py() or b""
                rows = []
                for offset, record, gap in salvage(content):
                    row = {"path": path, "offset": offset} | (record or {})
                    if gap:
                        row |= dict(zip(("gap_start", "gap_end", "reason"), gap))
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path", "content").mapInArrow(job, f"{RECORD_FIELDS}, {GAP_FIELDS}")


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back with the salvage reader."""
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path))

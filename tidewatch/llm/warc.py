"""WARC archives: written by tasks, read back in byte ranges.

Every record is a gzip member of its own. A reading task gets a byte range of
an archive, looks for the gzip magic, takes the first place whose member
decodes to a WARC header, and from there follows one member after the other.
It owns the records that start in its range and reads past the end of the
range to finish the last one; so every record is read once, whatever the cuts.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import materialise, scratch

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
SPLIT = 64 << 20
MOST_TASKS = 100_000  # that read; beyond it a task reads several ranges
_ID = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, uri: str | None, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    headers = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        headers.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        headers += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return gzip.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _name(key) -> str:
    return _ID + ("" if key is None else quote(str(key), safe=""))


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row below ``folder`` and return the manifest ``(path, size, records)``.

    Of the records with equal payloads of at least ``min_bytes`` bytes the one
    with the smallest key is a response, the others revisit it; smaller ones
    are all responses. A missing payload is an empty one, a missing url has no
    header. Rows that repeat the smallest key are all responses; a missing key
    never is the smallest, unless no row of the payload has one.

    Each task writes one archive under a name of its own; only what the
    manifest lists counts, so files of lost or repeated tasks do no harm. The
    folder may be on any file system that Arrow opens by its URI.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    # Combined in every task first; a very common payload is split by the adaptive join.
    firsts = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("key").alias("first"))
    placed = rows.join(firsts, ["digest", "n"], "left").select("key", "url", "payload", "first")
    placed = placed.withColumn("revisit", F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n = None, None, 0, 0
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder.rstrip('/')}/{name}"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                to = _name(row["first"]) if row["revisit"] else None
                data = record("revisit" if to else "response", _name(row["key"]), row["url"], date, row["payload"], to)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "records"])

    return materialise(placed.mapInArrow(run, "path string, size bigint, records bigint"))


def _member(read, at: int, start: bytes = b"") -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends; None if there is no whole one that begins with ``start``."""
    inflate, parts, size, to = zlib.decompressobj(31), [], 0, at
    while not inflate.eof:
        data = read(to, CHUNK)
        if not data:
            return None
        try:
            parts.append(inflate.decompress(data))
        except zlib.error:
            return None
        if size < len(start) <= size + len(parts[-1]) and not b"".join(parts).startswith(start):
            return None
        size += len(parts[-1])
        to += len(data)
    return b"".join(parts), to - len(inflate.unused_data)


def parse(data: bytes) -> dict | None:
    """Fields of one record; None if it doesn't begin with a WARC header."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    headers = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    if "warc-type" not in headers or not headers.get("content-length", "").isdigit():
        return None
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    kind, http = headers["warc-type"], block.find(b"\r\n\r\n")
    payload = None
    size = None
    if headers.get("content-type", "").startswith("application/http") and http >= 0:
        said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block[:http])
        if kind == "revisit":  # only the headers are here; they tell the size
            size = int(said[1]) if said else None
        else:
            payload = block[http + 4 :]
            size = len(payload)
    elif kind != "revisit":
        payload, size = block, len(block)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return {
        "record_type": kind,
        "record_id": headers.get("warc-record-id", "").strip("<>") or None,
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": digest if payload is None else base32_sha1(payload),
        "payload_bytes": size,
        "payload": payload,
    }


def records_in(read, begin: int, end: int) -> Iterator[tuple[int, dict]]:
    """Records of an archive that start in ``[begin, end)``; ``read(at, n)`` gives its bytes."""
    at = begin
    while at < end:
        # The first member, or the next one after a damaged one: anything that looks like one is tried.
        found = None
        while at < end and found is None:
            data = read(at, min(CHUNK, end - at) + len(MAGIC) - 1)
            place = data.find(MAGIC)
            while 0 <= place < end - at and found is None:
                member = _member(read, at + place, b"WARC/1.")
                if member and parse(member[0]):
                    found = (at + place, *member)
                else:
                    place = data.find(MAGIC, place + 1)
            if len(data) < len(MAGIC):
                return
            at += max(1, len(data) - len(MAGIC) + 1)
        while found is not None:
            start, data, at = found
            fields = parse(data)
            if fields:
                yield start, fields
            member = _member(read, at) if at < end else None
            found = (at, *member) if member else None


def read_archives(spark: SparkSession, archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """All records of the archives listed as ``(path, size)``: place, headers and payload.

    ``record_id`` and ``refers_to`` come without brackets. For a response size
    and digest are taken from the payload read, for a revisit (payload null)
    from its headers. Members that are no WARC records, or are damaged, are
    skipped; reading goes on after them. An empty
    listing gives an empty result; other columns of it are not used.
    """
    ranges = archives.where("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("size") - 1) / split).cast("bigint"))).alias("i")
    )
    # About a task for every range: their number is given, so that adaptive execution doesn't merge these few rows.
    dealt = ranges.repartition(min(max(1, ranges.count()), MOST_TASKS), F.col("path"), F.col("i"))
    names = [f.split(" ")[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                files, path = pyarrow.fs.FileSystem.from_uri(row["path"])
                rows, held = [], 0
                with files.open_input_file(path) as file:
                    read = lambda at, n, f=file, size=row["size"]: f.read_at(max(0, min(n, size - at)), at) if at < size else b""
                    for offset, fields in records_in(read, row["i"] * split, min(row["size"], (row["i"] + 1) * split)):
                        rows.append({"path": row["path"], "offset": offset, **fields})
                        held += fields["payload_bytes"] or 0
                        if held > 8 * CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return dealt.mapInArrow(run, RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder on the file system that all executors share, as a URI."""
    path = scratch(spark, "warc")
    return path if ":" in path else f"file://{path}"


def key_of(record_id: str):
    """The key in a record's name, as text; null for a missing key."""
    text = F.substring(F.col(record_id), len(_ID) + 1, 1 << 20)
    return F.when(F.col(record_id).isNotNull() & (text != ""), F.url_decode(text))


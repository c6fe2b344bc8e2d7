"""WARC archives: written as one gzip member per record, read back sequentially.

The writer runs in Spark tasks, each rolling archives of bounded size into the
shared folder; the names of an attempt that succeeded come back as a manifest,
so that files of lost attempts are never read.  The reader streams an archive
through incremental zlib, frames records by content length and verifies every
digest; it holds one record at a time.

Defined cases: a null payload is empty; a null or multi-line URL is left out or
percent-encoded; rows that repeat a page_id and payload get the same record
type; a null page_id is always a response; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

RECORD_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18
#: Bytes that a step of decompression gives at most, and a record has at most: a binary value's limit.
STEP, MOST = 4 << 20, (1 << 31) - 1


class WarcError(ValueError):
    """An archive that breaks framing or a digest."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed.  A revisit keeps the HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    ident = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        uri = quote(url, safe="!#$&()*+,/:;=?@[]~%'")
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url and url.isprintable():
            head.append(f"X-Original-URL: {quote(url, safe='')}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed step by step."""
    left = b""
    while True:
        left = left or stream.read(CHUNK)
        if not left:
            return
        unzip, parts, size = zlib.decompressobj(wbits=31), [], 0
        while not unzip.eof:
            if not left:
                left = stream.read(CHUNK)
                if not left:
                    raise WarcError("the archive ends inside a record")
            parts.append(unzip.decompress(left, STEP))
            size += len(parts[-1])
            if size > MOST:
                raise WarcError("a record that no row can hold")
            left = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """A record's fields; raises WarcError where framing or a digest is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError("the content length doesn't frame the record")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError("payload digest")
    length = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    if kind == "response" and length != len(payload):
        raise WarcError("the HTTP length differs from the payload")
    ident = lambda text: int(text[10:-1]) if text and text[10:-1] else None
    return {
        "page_id": ident(fields["WARC-Record-ID"]),
        "url": unquote(fields["X-Original-URL"]) if "X-Original-URL" in fields else fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": ident(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def classify(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages with digest, record_type and refers_to.

    Digests are grouped without the payloads; only the revisits' ids are then
    joined to the pages, on the id, so one very common payload makes no hot key.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    keys = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keys.join(groups, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_archives(classified: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the records below ``path``; returns the stored manifest (path, n_records, n_bytes)."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, done = None, []

        def close() -> None:
            out[0].close()
            done.append({"path": out[1], "n_records": out[2], "n_bytes": out[3]})

        for batch in batches:
            for page_id, url, html, digest, refers_to, kind in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "record_type")), strict=True):
                if out is None:
                    name = f"{root}/pages-{task.partitionId():06d}-{len(done):05d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = [store.open_output_stream(name), name, 0, 0]
                zipper = zlib.compressobj(6, wbits=31)
                member = zipper.compress(record_bytes(page_id, url, html, digest, kind, refers_to, date)) + zipper.flush()
                out[0].write(member)
                out[2] += 1
                out[3] += len(member)
                if out[3] >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    rows = classified.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to", "record_type")
    return shared.stored(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, store_uri: str, payload: bool = True) -> DataFrame:
    """The records of the manifest's archives, one task for each few archives."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        store, _ = fs.FileSystem.from_uri(store_uri)
        for batch in batches:
            for name, n_records in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                seen, rows, size = 0, [], 0
                with store.open_input_stream(name) as stream:
                    for raw in members(stream):
                        row = parse_record(raw)
                        if not payload:
                            row["payload"] = None
                        seen += 1
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        if len(rows) >= 5000 or size >= shared.TEXT_BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if seen != n_records:
                    raise WarcError(f"{name} holds {seen} records, {n_records} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, manifest.count())
    return manifest.select("path", "n_records").repartition(n).mapInArrow(read, RECORD_FIELDS)


def round_trip(pages: DataFrame, least: int = 100, payload: bool = True) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = shared.new_path(pages.sparkSession, "warc")
    manifest = write_archives(classify(pages, least), path)
    return read_archives(manifest, path, payload)

"""WARC archives as a chunked record table.

Payloads travel as (record, chunk number) rows of bounded size, to the writer
and from the reader, and digests are carried from chunk to chunk. No task holds
a whole record. Records of equal payloads are written once; the others are
revisit records that name it.
"""
from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint, scratch_dir
from .common import lookup, whole

CHUNK_BYTES = 1 << 18
LEAST_REVISIT_BYTES = 1000
# a task begins a new archive after so many payload bytes
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URI, NULL_URI = "urn:x-page:", "urn:x-row:"
CHUNKS = "archive string, record string, target string, record_type string, refers_to string, declared_bytes long, declared_digest string, chunk long, last boolean, data binary, running_bytes long, running_digest string"


def described(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """`key`, `url`, `payload` and what their records say: bytes, digest, record_type, refers_to.

    Of equal payloads of at least `least` bytes the largest key is the
    response. Null payloads are empty; a null key is smaller than any other;
    rows that repeat the largest key with its payload are responses too.
    """
    body = whole(F.col(payload)).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("bytes", F.octet_length("body").cast("long"))
    # shared payloads only, found from keys and digests
    shared = checkpoint(rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("key").alias("holder"), F.count("*").alias("n")).where("n > 1"))
    joined = lookup(rows, shared, ["digest"], "n")
    again = F.col("holder").isNotNull() & ~F.col("key").eqNullSafe(F.col("holder"))
    return joined.select("key", "url", "body", "digest", "bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("holder")).alias("refers_to"))


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of a response's payload, in order; one without data for an empty payload or a revisit."""
    last = F.when(F.col("record_type") == "response", F.greatest(F.ceil(F.col("bytes") / chunk_bytes) - 1, F.lit(0))).otherwise(0)
    rows = records.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    data = F.when(F.col("record_type") == "response", F.substring("body", (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)))
    return rows.select("key", "url", "digest", "bytes", "record_type", "refers_to", "chunk", (F.col("chunk") == last).alias("last"), data.alias("data"))


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _line(text: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", text or "")


def _head(key: int | None, url: str, digest: str, size: int, kind: str, refers_to: int | None) -> tuple[bytes, bytes]:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{NULL_URI + str(uuid.uuid4()) if key is None else RECORD_URI + str(key)}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_URI}{refers_to}>"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `pages` as gzip WARC archives under `folder`, a URI that executors share; returns the stored manifest.

    Each attempt of a task writes archives of its own name, a gzip member per
    record, and only those of the attempt that ends are in the manifest, so a
    lost or repeated task leaves no record twice. Returns archive, records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        out, done, packer, written = None, [], None, 0
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["chunk"] == 0:
                    if out is None or written >= archive_bytes:
                        if out is not None:
                            out.close()
                        done.append([f"{stem}-{len(done):04d}.warc.gz", 0])
                        out, written = system.open_output_stream(done[-1][0], compression=None), 0
                    packer = zlib.compressobj(1, wbits=31)
                    for part in _head(row["key"], row["url"], row["digest"], row["bytes"], row["record_type"], row["refers_to"]):
                        out.write(packer.compress(part))
                    done[-1][1] += 1
                if row["data"]:
                    out.write(packer.compress(row["data"]))
                    written += len(row["data"])
                if row["last"]:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"archive": [d[0] for d in done], "records": [d[1] for d in done]}, pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    rows = chunked(described(pages, key, url, payload), chunk_bytes)
    return checkpoint(rows.mapInArrow(run, "archive string, records long"))


class _Inflated(io.RawIOBase):
    """Members of a gzip file one after another, a bounded piece at a time; files without gzip pass as they are."""

    def __init__(self, source):
        self.source, self.machine, self.rest, self.plain = source, None, b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if not self.rest:
                self.rest = self.source.read(1 << 16)
                if not self.rest and self.machine is None:
                    return 0
            if self.plain is None:
                self.plain = self.rest[:2] != b"\x1f\x8b"
            if self.plain:
                out, self.rest = self.rest[:len(into)], self.rest[len(into):]
            else:
                self.machine = self.machine or zlib.decompressobj(31)
                ended = not self.rest  # what the machine still holds is all there is
                out = self.machine.decompress(self.rest, len(into))
                self.rest = self.machine.unused_data if self.machine.eof else self.machine.unconsumed_tail
                if self.machine.eof:
                    self.machine = None
                elif ended and not out:
                    raise EOFError("a gzip member ends early")
            if out:
                into[:len(out)] = out
                return len(out)


def _headers(stream, most: int = 1 << 16) -> dict[str, str]:
    fields: dict[str, str] = {}
    while (line := stream.readline(most)) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def chunks_of(stream, archive: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunk rows of a decompressed WARC stream; running_bytes and running_digest cover the payload so far."""
    while first := stream.readline(1 << 16):
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{archive}: not a WARC record: {first[:40]!r}")
        head = _headers(stream)
        left = int(head["content-length"])
        row = {"archive": archive, "record": head["warc-record-id"].strip("<>"), "target": head.get("warc-target-uri"), "record_type": head["warc-type"],
               "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "declared_bytes": None, "declared_digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None}
        if head.get("content-type", "").startswith("application/http"):
            counted = _Counted(stream, left)
            counted.readline(1 << 16)
            row["declared_bytes"] = int(_headers(counted).get("content-length", -1))
            left = counted.left
        digest, size, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError(f"{archive}: record {row['record']} ends early")
            left, size = left - len(data), size + len(data)
            digest.update(data)
            yield {**row, "chunk": number, "last": not left, "data": data, "running_bytes": size, "running_digest": digest.hexdigest()}
            number += 1
            if not left:
                break


class _Counted:
    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def readline(self, most: int) -> bytes:
        line = self.stream.readline(min(most, self.left)) if self.left else b""
        self.left -= len(line)
        return line


def read(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows (CHUNKS) of the archives in a manifest, each archive streamed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (c.split(" ") for c in CHUNKS.split(", "))])
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                held, size = [], 0
                with system.open_input_stream(archive, compression=None) as source:
                    for row in chunks_of(io.BufferedReader(_Inflated(source), 1 << 16), archive, chunk_bytes):
                        held.append(row)
                        size += len(row["data"]) + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    spread = manifest.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: digest and size as read for responses, as declared for revisits."""
    number = lambda c, uri=RECORD_URI: F.when(F.startswith(c, F.lit(uri)), F.substring_index(c, ":", -1).cast("long"))
    own = F.col("record_type") == "response"
    return chunks.where("last").select(
        number(F.col("record")).alias("page_id"), F.when(own, F.col("running_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("running_digest")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"),
        (F.col("running_digest") == F.col("declared_digest")).alias("intact"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write `pages` into a fresh shared folder and return the records read back."""
    folder = scratch_dir(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{os.path.abspath(folder)}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    return records(read(write(pages, folder), folder))

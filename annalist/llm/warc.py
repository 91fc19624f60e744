"""WARC archives written and read as streams of chunks.

Writing: one archive per task (a new one when it is full), each record a gzip member of its own, fed in chunks.
Of records with equal payloads one is a response, the others are revisits that name it. Reading: each archive is
a table of chunk rows, ``(record_id, chunk_no, ...)``, with the digest of the payload so far on every row; a
record is never held as a whole. Archives lie in a folder that driver and executors share; a manifest that is
written once names the files of the attempts that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import prepare

#: Bytes of one chunk, and bytes after which a task begins another archive.
CHUNK, ARCHIVE = 1 << 16, 1 << 30

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"

MANIFEST = "archive string, n_records long"
CHUNKS = "archive string, record_no long, page_id long, url string, record_type string, refers_to long, chunk_no int, n_bytes long, digest string, declared_digest string, declared_bytes long, data binary"


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, html, refers_to)``: refers_to is null for responses.

    Of the pages with equal payloads (null counts as empty) the largest id is the response. Only ids and digests
    are compared; payloads move once. Repeated rows of one page stay repeated. Rows without an id are left out.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).where(F.col("page_id").isNotNull())
    named = rows.withColumn("_digest", F.sha1(F.encode("html", "UTF-8")))
    keys = named.select("page_id", "_digest").distinct()
    shared = keys.groupBy("_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    revisits = keys.join(shared, "_digest").where(F.col("page_id") != F.col("_first")).select(
        "page_id", "_digest", F.col("_first").alias("refers_to")
    )
    return named.join(revisits, ["page_id", "_digest"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write ``(page_id, url, html, refers_to)`` below ``folder``; the manifest ``(archive, n_records)``."""
    prepare(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        writer, n, files = None, 0, []
        for batch in batches:
            html = batch.column("html").cast(pa.large_binary())
            for i, (page, link, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")))):
                if writer is None or writer.tell() >= archive_bytes:
                    if writer is not None:
                        writer.close()
                        files[-1][1] = n
                    files.append([f"{name}-{len(files)}.warc.gz", 0])
                    writer, n = open_output(files[-1][0]), 0
                for piece in record_bytes(page, link, html[i].as_buffer(), first, chunk):
                    writer.write(piece)
                n += 1
        if writer is not None:
            writer.close()
            files[-1][1] = n
        yield pa.RecordBatch.from_pydict({"archive": [f[0] for f in files], "n_records": [f[1] for f in files]}, schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64())]))

    return cut_lineage(records.mapInArrow(write, MANIFEST))


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives of a manifest.

    A record is named by ``(archive, record_no)`` and has at least one row. ``digest`` covers the payload up to and with this chunk, so the last
    row of a record has the digest of the payload. A revisit has no payload of its own: its one row carries the
    declared digest and length.
    """
    spark = manifest.sparkSession
    prepare(spark)
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                held = 0
                for row in chunk_rows(name, chunk, with_data):
                    rows.append((name.rpartition("/")[2], *row))
                    held += len(row[-1] or b"")
                    if held > 8 * chunk or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return manifest.select("archive").repartition(files).mapInArrow(read, CHUNKS)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row per record with the facts of its full payload: ``(page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, n_chunks)``.
    """
    last = lambda c: F.max_by(c, "chunk_no").alias(c)
    rows = chunks.groupBy("archive", "record_no", "page_id", "record_type").agg(
        last("url"), F.sum("n_bytes").alias("_bytes"), last("digest"), last("declared_bytes"), last("declared_digest"),
        last("refers_to"), F.count("*").alias("n_chunks"),
    )
    own = F.col("record_type") == "response"
    return rows.select(
        "page_id", "url", F.when(own, F.col("_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type", "refers_to", "n_chunks",
    )


def digest_of(state) -> str:
    return base64.b32encode(state.digest()).decode("ascii")


def record_bytes(page: int, url: str | None, payload, refers_to: int | None, chunk: int = CHUNK) -> Iterator[bytes]:
    """The gzip member of one record in pieces; ``payload`` is any buffer and is only sliced."""
    view = memoryview(payload)
    state = hashlib.sha1(view)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(view)
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{RECORD_ID}{page}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url)),
        ("WARC-Payload-Digest", f"sha1:{digest_of(state)}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>" if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else len(view)))),
    ]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + http
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    yield packer.compress(head)
    if not revisit:
        for start in range(0, len(view), chunk):
            yield packer.compress(view[start : start + chunk])
    yield packer.compress(b"\r\n\r\n") + packer.flush()


def _file_system(name: str):
    from pyarrow import fs

    if "://" not in name and name.startswith("file:"):
        name = "file://" + name[len("file:") :]
    if "://" in name:
        return fs.FileSystem.from_uri(name)
    return fs.LocalFileSystem(), os.path.abspath(name)


def open_output(name: str):
    system, path = _file_system(name)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def plain_pieces(name: str, chunk: int) -> Iterator[bytes]:
    """Unpacked bytes of a file of gzip members, at most ``chunk`` at a time."""
    system, path = _file_system(name)
    with system.open_input_stream(path, compression=None, buffer_size=chunk) as source:
        unpacker = zlib.decompressobj(31)
        while block := source.read(chunk):
            while block:
                if piece := unpacker.decompress(block, chunk):
                    yield piece
                if unpacker.eof:
                    block, unpacker = unpacker.unused_data, zlib.decompressobj(31)
                else:
                    block = unpacker.unconsumed_tail


class _Stream:
    """Lines and counted bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\r\n")) < 0:
            piece = next(self.pieces, None)
            if piece is None:
                if self.held:
                    raise ValueError("the archive ends inside a line")
                return None
            self.held += piece
        line, self.held = self.held[:end], self.held[end + 2 :]
        return line

    def fields(self) -> dict[str, str]:
        found = {}
        while line := self.line():
            key, _, value = line.decode().partition(":")
            found[key.strip().lower()] = value.strip()
        return found

    def take(self, n: int, chunk: int) -> Iterator[bytes]:
        """The next n bytes, in pieces of exactly ``chunk`` bytes but for the last."""
        while n > 0:
            while len(self.held) < min(n, chunk):
                piece = next(self.pieces, None)
                if piece is None:
                    raise ValueError("the archive ends inside a record")
                self.held += piece
            size = min(n, chunk)
            piece, self.held = self.held[:size], self.held[size:]
            n -= size
            yield piece


def chunk_rows(name: str, chunk: int = CHUNK, with_data: bool = True) -> Iterator[tuple]:
    """The chunk rows of one archive: the number of the record in it, then the columns of ``CHUNKS`` from page_id on."""
    stream, record = _Stream(plain_pieces(name, chunk)), 0
    while (line := stream.line()) is not None:
        if line + b"\r\n" != VERSION:
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = stream.fields()
        page = int(head["warc-record-id"].strip("<>").removeprefix(RECORD_ID))
        refers = head.get("warc-refers-to")
        status = stream.line()
        http = stream.fields()
        length = int(http["content-length"])
        fixed = (page, head.get("warc-target-uri"), head["warc-type"], int(refers.strip("<>").removeprefix(RECORD_ID)) if refers else None)
        declared = (head["warc-payload-digest"].removeprefix("sha1:"), length)
        if not status.startswith(b"HTTP/"):
            raise ValueError("no HTTP block")
        state, number = hashlib.sha1(), 0
        if head["warc-type"] == "response":
            for piece in stream.take(length, chunk):
                state.update(piece)
                yield (record, *fixed, number, len(piece), digest_of(state), *declared, piece if with_data else None)
                number += 1
        if number == 0:
            yield (record, *fixed, 0, 0, digest_of(state), *declared, b"" if with_data else None)
        if stream.line() != b"" or stream.line() != b"":
            raise ValueError("no empty lines after a record")
        record += 1


_SCHEMA = pa.schema([
    ("archive", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()),
    ("n_bytes", pa.int64()), ("digest", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("data", pa.binary()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

"""WARC archives: one gzip member per record, read sequentially.

Writing: payloads are digested by Spark; of the rows that share a payload of at
least ``min_revisit_bytes`` bytes the one with the largest page_id keeps it and
the others become ``revisit`` records that name it.  The groups of equal
payloads are counted with partial aggregation and only those of two rows or
more are joined back, by a plain equi-join whose skewed keys Spark splits.
Each task streams its records into archive files of at most ``roll_bytes``.

Reading: members are inflated incrementally from a bounded buffer, records are
framed by Content-Length, and a response's payload digest is verified while it
streams by, so memory does not depend on the size of a record.

Cases: a null html is an empty payload; empty and short payloads are responses;
rows with the largest page_id of a group are all responses when that id
repeats, and rows whose whole group has null ids are responses; a null page_id
is written without its header and read as null; a null url is left out; CR and
LF in urls are percent-escaped; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .storage import materialize, new_dir, partitions

MIN_REVISIT_BYTES = 1000
ROLL_BYTES = 512 << 20
READ_BYTES = 1 << 16

_MANIFEST = "path string, records bigint, bytes bigint"
_RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_SPACE = uuid.UUID("5f0d3c1e-6f5e-4c86-9a55-7d1f0a3c9b21")


class DamagedArchive(ValueError):
    """An archive whose framing or digest does not hold."""


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, length: int, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record's bytes before compression; a revisit (``refers_to`` set) holds HTTP headers only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None = None


class _Members:
    """The inflated bytes of one gzip member after another."""

    def __init__(self, stream):
        self.stream, self.raw, self.z, self.buffer = stream, b"", None, bytearray()

    def next(self) -> bool:
        """On to the next member; False at the end of the archive."""
        if self.buffer or (self.z is not None and not self.z.eof):
            raise DamagedArchive("bytes after a record within its member")
        self.raw = self.raw or self.stream.read(READ_BYTES)
        self.z = zlib.decompressobj(31)
        return bool(self.raw)

    def fill(self) -> bool:
        """More inflated bytes into the buffer; False at the member's end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.raw or self.stream.read(READ_BYTES)
            if not data:
                raise DamagedArchive("the archive ends within a member")
            if not self.z.unconsumed_tail:
                self.raw = b""
            got = self.z.decompress(data, READ_BYTES)
            if self.z.eof:
                self.raw = self.z.unused_data + self.raw
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.fill():
                raise DamagedArchive("a header does not end")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.fill():
                raise DamagedArchive("a record is shorter than its Content-Length")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part

    def finish(self) -> None:
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise DamagedArchive("a record is longer than its Content-Length")
        while not self.z.eof:
            self.fill()


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def read_archive(stream, keep_payload: bool = False) -> Iterator[Record]:
    members = _Members(stream)
    while members.next():
        headers = _fields(members.until(b"\r\n\r\n"))
        left = int(headers["content-length"])
        http = members.until(b"\r\n\r\n")
        left -= len(http) + 4
        sha, kept = hashlib.sha1(), []
        size = left
        for part in members.take(left):
            sha.update(part)
            if keep_payload:
                kept.append(part)
        members.finish()
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "response":
            if sha.hexdigest() != digest:
                raise DamagedArchive(f"digest of {headers['warc-record-id']} is {sha.hexdigest()}, not {digest}")
        else:
            size = int(_fields(http)["content-length"])
        yield Record(headers, size, digest, b"".join(kept) if keep_payload else None)


def _write(batches, folder: str, level: int, roll_bytes: int):
    partition, number = TaskContext.get().partitionId(), 0
    uri = out = None
    records = size = 0
    done = []
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "length", "refers_to")]
        for i in range(batch.num_rows):
            page_id, url, html, digest, length, refers_to = (c[i].as_py() for c in columns)
            if out is None:
                uri, out = files.create(folder, partition, number, ".warc.gz")
                number, records, size = number + 1, 0, 0
            data = member(record(page_id, url, html or b"", digest, length, refers_to), level)
            out.write(data)
            records, size = records + 1, size + len(data)
            if size >= roll_bytes:
                out.close()
                done.append((uri, records, size))
                out = None
    if out is not None:
        out.close()
        done.append((uri, records, size))
    if done:
        a, b, c = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["path", "records", "bytes"])


def _read(batches):
    def flush(rows):
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    rows = []
    for batch in batches:
        for path, want in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
            n = 0
            with files.open_stream(path) as stream:
                for r in read_archive(stream):
                    n += 1
                    page, refers = r.headers.get("x-page-id"), r.headers.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, r.headers.get("warc-target-uri"), r.payload_bytes, r.payload_digest, r.headers["warc-type"], int(refers) if refers else None))
                    if len(rows) >= 5000:
                        yield flush(rows)
                        rows = []
            if n != want:
                raise DamagedArchive(f"{path} holds {n} records, not {want}")
    if rows:
        yield flush(rows)


def plan(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with digest, length and, for revisits, the page they refer to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "length": F.octet_length("html").cast("long")})
    groups = rows.filter(F.col("length") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1 and keeper is not null").select("digest", "keeper"), "warc-groups")
    refers = F.when(F.coalesce(F.col("page_id") < F.col("keeper"), F.col("keeper").isNotNull()), F.col("keeper"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "html", "digest", "length", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, level: int = 6, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the archives below ``folder``; returns their manifest (path, records, bytes)."""
    folder = folder or new_dir(pages.sparkSession, "warc")
    planned = plan(pages, min_revisit_bytes)
    return materialize(planned.mapInArrow(lambda batches: _write(batches, folder, level, roll_bytes), _MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record, in no order."""
    return manifest.repartition(partitions(manifest.sparkSession)).mapInArrow(_read, _RECORDS)

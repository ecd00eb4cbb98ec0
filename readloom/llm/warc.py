"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a seek table in a skippable
frame ends each archive, so any frame can be read alone. An index maps each record
to archive, frame and offset within the decompressed frame.

Archives are written by the tasks straight to the shared folder under names that are
unique to an attempt; the index is committed by Spark. A task that is run again leaves
an archive that no index row names, so a lost executor costs work and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, new_path, out_schema, rows_of, saved, table, text_bytes

#: Fixed values of the seekable Zstandard format: skippable frame, footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed values of WARC 1.1: the profile of a revisit by identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, archive string, frame int, offset long, length long, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit carries the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}" if url is not None else "",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {page_id}" if page_id is not None else "",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    block = http if refers_to is not None else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(x for x in head if x).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(frame: bytes, offset: int) -> tuple[tuple, int]:
    """The record at ``offset`` and where the next one starts. A payload that does not fit its digest is an error."""
    end = frame.index(b"\r\n\r\n", offset)
    lines = frame[offset:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, length = end + 4, int(head["Content-Length"])
    block = frame[start : start + length]
    at = block.index(b"\r\n\r\n")
    size = int(block[:at].rsplit(b": ", 1)[1])
    payload = block[at + 4 :]
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of record {head['WARC-Record-ID']} is damaged")
    number = lambda k: int(head[k]) if k in head else None
    return (number("X-Page-Id"), head.get("WARC-Target-URI"), size, digest, kind, number("X-Refers-To-Page-Id"), payload if kind == "response" else None), start + length + 4


class Bundle:
    """One archive being written."""

    def __init__(self, folder: str, level: int):
        store, path = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        store.create_dir(path, recursive=True)
        self.uri, self.out = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int]] = []
        self.frame = bytearray()
        self.written = 0

    def end_frame(self) -> None:
        if self.frame:
            data = self.zstd.compress(bytes(self.frame))
            self.out.write(data)
            self.table.append((len(data), len(self.frame)))
            self.written += len(data)
            self.frame = bytearray()

    def close(self) -> None:
        self.end_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class Seekable:
    """Reads frames of an archive through its seek table."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        self.file.seek(size - 9 - n * width)
        data = self.file.read(n * width)
        self.table, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", data, i * width)
            self.table.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.table[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 100, frame_bytes: int = 1 << 20, archive_bytes: int = 512 << 20, level: int = 3) -> DataFrame:
    """Writes a record per row and returns the index (``INDEX``).

    Of rows with equal payloads of ``min_revisit_bytes`` or more the one with the smallest id is the response; rows
    with a larger id revisit it. Rows that share id and payload have the same fate. Null payloads are empty; a null id
    never revisits; null urls leave the header out; other columns are ignored; an empty table makes no archive.

    Only ids, digests and lengths are grouped; the payload meets its revisit mark by one join on id and digest, which
    Spark makes a broadcast where the marks are few.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_bytes(payload_col).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    facts = saved(base.where(F.octet_length("payload") >= min_revisit_bytes).select("id", "digest"), "digests")
    first = facts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = facts.join(first, "digest").where("id > first").distinct()
    rows = base.join(marks, ["id", "digest"], "left").select("id", "url", "payload", "digest", "first")
    schema = out_schema(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, out = None, Rows(schema)
        for batch in batches:
            for page, url, payload, digest, first in rows_of(batch, "id", "url", "payload", "digest", "first"):
                bundle = bundle or Bundle(folder, level)
                data = record(page, url, payload, digest, first)
                due = out.add((page, bundle.uri, len(bundle.table), len(bundle.frame), len(data), "response" if first is None else "revisit"))
                bundle.frame += data
                if len(bundle.frame) >= frame_bytes:
                    bundle.end_frame()
                if bundle.written >= archive_bytes:
                    bundle.close()
                    bundle = None
                if due:
                    yield out.batch()
        if bundle:
            bundle.close()
        yield from out.rest()

    return saved(rows.mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, *, payloads: bool = True, task_bytes: int = 16 << 20) -> DataFrame:
    """Every record of the archives that ``index`` names (``RECORDS``), a frame at a time through the seek tables.

    The frames are dealt over as many tasks as ``task_bytes`` of records each ask, neighbours together: the index is small
    whatever the archives hold, so its own size can't tell.

    ``payloads=False`` checks each payload against its digest and leaves the column null. A revisit's payload is that
    of the response it refers to and isn't repeated here.
    """
    schema = out_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, archive, out = None, None, Rows(schema)
        for batch in batches:
            for name, number in rows_of(batch, "archive", "frame"):
                if name != uri:
                    uri, archive = name, Seekable(name)
                data, at = archive.frame(number), 0
                while at < len(data):
                    row, at = parse_record(data, at)
                    if out.add(row if payloads else (*row[:-1], None), len(row[-1] or b"") if payloads else 0):
                        yield out.batch()
        yield from out.rest()

    frames = index.select("archive", "frame").distinct()
    total = index.agg(F.sum("length")).first()[0] or 0
    return frames.repartitionByRange(1 + total // task_bytes, "archive", "frame").sortWithinPartitions("archive", "frame").mapInArrow(read, RECORDS)


def read_record(uri: str, frame: int, offset: int) -> tuple:
    """Random access to one record by its index entry."""
    return parse_record(Seekable(uri).frame(frame), offset)[0]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, sha256(p) AS payload_digest,
       CASE WHEN strlen(p) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, p, min(page_id) OVER (PARTITION BY p) AS first
      FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""

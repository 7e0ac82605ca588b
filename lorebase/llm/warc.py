"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about a megabyte; a bundle ends in a seek table (a skippable frame with
the compressed and plain size of each frame), and an index table maps a record's id to bundle, frame and the offset in
the frame. So one record is read by decompressing one frame. Records with equal payloads of at least 100 bytes are
stored once: the others revisit the one with the smallest id.

A task writes a bundle under a draft name and moves it when whole; the index, written once, names only the bundles of
tasks that succeeded, so bundles of lost or repeated tasks are never read.

Cases: null payloads count as empty; a row with a null id is always a response; rows that repeat an id and a payload
are alike, both responses or both revisits; null urls are empty; an empty table gives an empty index and an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_batches, by_bytes, local_path, materialize, spread_files

#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Plain bytes of a frame and of a bundle, about; payloads below the last aren't worth a revisit.
FRAME, BUNDLE, LEAST = 1 << 20, 256 << 20, 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def name(i) -> str:
    return f"<urn:page:{'' if i is None else i}>"


def record(i, url: str, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC record; a revisit holds the HTTP head alone, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(i)}", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Head, block and end of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    begin, n = end + 4, int(head["Content-Length"])
    if data[begin + n : begin + n + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has a wrong length")
    return head, data[begin : begin + n], begin + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """Opens a bundle and reads its seek table; frames are read by offset."""

    def __init__(self, uri: str):
        system, path = local_path(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        raw = self.file.read(8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", raw, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


class Writer:
    """Puts records into frames and frames into bundles; keeps one frame in memory."""

    def __init__(self, folder: str, frame: int = FRAME, bundle: int = BUNDLE):
        self.folder, self.pack, self.frame_bytes, self.bundle_bytes = folder, zstandard.ZstdCompressor(level=3), frame, bundle
        self.stream = None

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        """Bundle, frame, offset in the frame and length of the record just added."""
        if self.stream is None:
            system, top = local_path(self.folder)
            system.create_dir(top, recursive=True)
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.system, self.draft, self.final = system, os.path.join(top, f"{self.name}.part"), os.path.join(top, self.name)
            self.stream, self.frames, self.held, self.size, self.total = system.open_output_stream(self.draft), [], [], 0, 0
        place = (self.name, len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        self.total += len(data)
        if self.size >= self.frame_bytes:
            self._frame()
        if self.total >= self.bundle_bytes:
            self.close()
        return place

    def _frame(self) -> None:
        packed = self.pack.compress(b"".join(self.held))
        self.stream.write(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.stream is not None:
            if self.held:
                self._frame()
            self.stream.write(seek_table(self.frames))
            self.stream.close()
            self.system.move(self.draft, self.final)
            self.stream = None


def decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """id, digest, refers_to of the rows that revisit another. Only ids and digests are shuffled."""
    narrow = pages.where(F.octet_length("payload") >= least).select("id", "digest")
    first = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return narrow.where("id is not null").join(first, "digest").where("id <> refers_to").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes an archive in `folder` and returns its index: id, bundle, frame, start, length."""
    spark = pages.sparkSession
    bounded_batches(spark)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Decisions are written first: Spark then knows their size, sends a short list to the pages, and shuffles the pages
    # only for a long one. They are joined by id and digest, so that a page with many copies is no hot key.
    marked = rows.join(materialize(decisions(rows), spark, "revisits"), ["id", "digest"], "left").select("id", "payload", "url", "digest", "refers_to")
    kind = StructType().add("id", rows.schema["id"].dataType).add("bundle", "string").add("frame", "integer").add("start", "integer").add("length", "integer")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, waiting = Writer(f"{folder}/bundles", frame, bundle), []
        for batch in batches:
            for part in by_bytes(batch):
                waiting += [(i, *writer.add(record(i, url, payload, digest, to, date))) for i, payload, url, digest, to in zip(*(c.to_pylist() for c in part.columns))]
        writer.close()
        # Rows are given out only when the bundles that they name are whole.
        for k in range(0, len(waiting), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting[k : k + 10_000]), arrow.types)], schema=arrow)

    marked.mapInArrow(run, kind).write.parquet(f"{folder}/index")
    return spark.read.schema(kind).parquet(f"{folder}/index")


FOUND = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def found(head: dict[str, str], block: bytes, keep: bool) -> tuple:
    """A row of FOUND; a response's digest is made anew from its payload and must be the one in its head."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
    n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{head['WARC-Record-ID']} is damaged")
    plain = lambda x: x and (x[len("<urn:page:") : -1] or None)
    return plain(head["WARC-Record-ID"]), head.get("WARC-Target-URI", ""), kind, plain(head.get("WARC-Refers-To")), digest, n, payload if keep and kind == "response" else None


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= 2000 or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of an archive, read by the bundles; columns as in FOUND."""
    bundles = spread_files(spark.read.parquet(f"{folder}/index").select("bundle").distinct())
    kind = StructType.fromDDL(FOUND)
    arrow = to_arrow_schema(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                bundle = Bundle(f"{folder}/bundles/{b}")
                for k in range(len(bundle.frames)):
                    data, at = bundle.frame(k), 0
                    while at < len(data):
                        head, block, at = parse(data, at)
                        yield found(head, block, payloads)
                bundle.close()

    return bundles.mapInArrow(lambda batches: _batches(rows(batches), arrow), kind)


def lookup(spark: SparkSession, folder: str, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of some ids: their frames alone are read. Columns as in FOUND."""
    index = spark.read.parquet(f"{folder}/index").join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    kind = StructType.fromDDL(FOUND)
    arrow = to_arrow_schema(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, bundle, data = None, None, b""
        for batch in batches:
            for b, frame, start in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at[0] != b:
                    bundle = Bundle(f"{folder}/bundles/{b}")
                if at != (b, frame):
                    at, data = (b, frame), bundle.frame(frame)
                yield found(*parse(data, start)[:2], True)

    near = index.select("bundle", "frame", "start").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "start")
    return near.mapInArrow(lambda batches: _batches(rows(batches), arrow), kind)

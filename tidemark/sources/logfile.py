"""The binary log format: records framed into 32 KiB blocks.

A fragment is u32 crc32(type, data), u16 length, u8 type (full 1, first 2, middle
3, last 4), data; a block's tail under 7 bytes is zeros.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import Corruption
from tidemark.operators import batches
from tidemark.runtime import fresh_path, keep, map_arrow, opens

BLOCK, HEADER = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
#: Rows and bytes of one batch that a reader yields; batches that a writer unpacks at once.
ROWS, ROWS_BYTES, UNPACKED = 10_000, 8 << 20, 64


def frame(records: list[bytes], at: int = 0) -> bytes:
    """Framed records of a log that already has ``at`` bytes; empty ones add nothing."""
    out = bytearray()
    for record in records:
        left, begun = record, False
        while left:
            room = BLOCK - (at + len(out)) % BLOCK
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part, left = left[: room - HEADER], left[room - HEADER :]
            kind = (MIDDLE if left else LAST) if begun else (FIRST if left else FULL)
            begun = True
            out += zlib.crc32(bytes([kind]) + part).to_bytes(4, "little") + len(part).to_bytes(2, "little") + bytes([kind]) + part
    return bytes(out)


@dataclass
class Report:
    """Bytes dropped, with reasons, while a log was read."""

    dropped: list[tuple[int, str]] = field(default_factory=list)
    total: int = 0

    def __call__(self, n: int, why: str) -> None:
        self.dropped.append((n, why))
        self.total += n


def _blocks(stream: BinaryIO) -> Iterator[tuple[bytes, bool]]:
    """The blocks of a log, and whether each is the last."""
    block = stream.read(BLOCK)
    while block:
        after = stream.read(BLOCK) if len(block) == BLOCK else b""
        yield block, not after
        block = after


def _fragments(stream: BinaryIO, report: Report) -> Iterator[tuple[int, bytes]]:
    """Checked fragments; 0 marks a place where something was dropped."""
    for block, last in _blocks(stream):
        at = 0
        while len(block) - at >= HEADER:
            crc, n, kind = int.from_bytes(block[at : at + 4], "little"), int.from_bytes(block[at + 4 : at + 6], "little"), block[at + 6]
            if at + HEADER + n > len(block):
                if not last or len(block) == BLOCK:
                    report(len(block) - at, "bad record length")
                    yield 0, b""
                break  # the writer stopped within its last record
            body = block[at + HEADER : at + HEADER + n]
            if not kind and not n:
                break
            if zlib.crc32(bytes([kind]) + body) != crc:
                report(len(block) - at, "checksum mismatch")
                yield 0, b""
                break
            yield kind, body
            at += HEADER + n


def read_records(data: bytes, report: Report | None = None) -> Iterator[bytes]:
    return read_stream(io.BytesIO(data), report)


def read_stream(stream: BinaryIO, report: Report | None = None) -> Iterator[bytes]:
    """Whole records, a block of the log at a time.  Corruption is reported and skipped; a log cut short ends
    quietly, as its writer may have died."""
    report = report or Report()
    held: bytearray | None = None
    for kind, body in _fragments(stream, report):
        if kind in (FULL, FIRST):
            if held is not None:
                report(len(held), "partial record without end")
            held = None if kind == FULL else bytearray(body)
            if kind == FULL:
                yield body
        elif kind in (MIDDLE, LAST):
            if held is None:
                report(len(body), "missing start of record")
                continue
            held += body
            if kind == LAST:
                yield bytes(held)
                held = None
        else:
            lost = len(body) + len(held or b"")
            if kind:
                report(lost, "unknown record type")
            elif held:
                report(len(held), "error in middle of record")
            held = None


def _open_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Path and content of each log; the content is null where tasks can open the file
    and read it as a stream, and a log is one value only where Spark alone reads."""
    raw = spark.read.format("binaryFile").load(path)
    content = F.lit(None).cast("binary") if opens(spark, path) else F.col("content")
    return raw.select("path", content.alias("content"))


def _streams(batches_: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, BinaryIO]]:
    """Name and stream of each log."""
    for batch in batches_:
        for path, content in zip(*batch.columns):
            file = path.as_py()
            if content.is_valid:
                yield file.rsplit("/", 1)[-1], pa.BufferReader(content.as_buffer())
            else:
                store, at = fs.FileSystem.from_uri(file)
                with io.BufferedReader(store.open_input_stream(at), 1 << 20) as stream:
                    yield file.rsplit("/", 1)[-1], stream


def lost_bytes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, dropped and reason: what of each log could not be read; a log without a
    good record is reported like any other."""

    def run(logs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, stream in _streams(logs):
            report = Report()
            for record in read_stream(stream, report):
                try:
                    for _ in batches.decode(record):
                        pass
                except Corruption as e:
                    report(len(record), str(e))
            sizes, reasons = zip(*report.dropped) if report.dropped else ((), ())
            yield pa.record_batch([pa.array([file] * len(sizes), pa.string()), pa.array(sizes, pa.int64()), pa.array(reasons, pa.string())], names=["file", "dropped", "reason"])

    return map_arrow(_open_logs(spark, path), run, "file string, dropped long, reason string")


def read_log_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Change log (user_key, seq, vtype, value as binary; file; dropped bytes) of
    binary logs whose records are write batches.  Batches under 12 bytes and what
    follows an error within one are skipped; :func:`lost_bytes` tells of each.  A task
    holds a block of the log, a record and a batch of rows, however long the log."""
    kinds = {"file": pa.string(), "user_key": pa.binary(), "seq": pa.int64(), "vtype": pa.int64(), "value": pa.binary(), "dropped": pa.int64()}

    def rows(logs: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, stream in _streams(logs):
            report = Report()
            for record in read_stream(stream, report):
                lost = report.total
                try:
                    for seq, kind, key, value in batches.decode(record):
                        yield file, key, seq, kind, value, lost
                except Corruption as e:
                    report(len(record), str(e))

    def run(logs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(logs):
            held.append(row)
            size += len(row[1]) + len(row[4] or b"")
            if len(held) >= ROWS or size >= ROWS_BYTES:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds))
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds))

    return map_arrow(_open_logs(spark, path), run, "file string, user_key binary, seq long, vtype long, value binary, dropped long")


def write_log_files(batches_: DataFrame, folder: str | None = None) -> DataFrame:
    """Write batches (log, base_seq, ops: array of struct<vtype, user_key, value>) as
    one framed log for each ``log`` number, in order of base_seq; the manifest: log,
    path, n_records and n_bytes.  A log is written by one task as its rows come."""
    spark = batches_.sparkSession
    folder = folder or fresh_path(spark, "logs")
    ordered = batches_.select("log", "base_seq", "ops").repartition("log").sortWithinPartitions("log", "base_seq")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        current, out, path, n = None, None, "", 0

        def done() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.record_batch([pa.array([x], t) for x, t in ((current, pa.int64()), (path, pa.string()), (n, pa.int64()), (size, pa.int64()))], names=["log", "path", "n_records", "n_bytes"])

        # A batch of rows holds many ops, so it is unpacked in slices.
        for part in (whole.slice(i, UNPACKED) for whole in parts for i in range(0, whole.num_rows, UNPACKED)):
            for log, base_seq, ops in zip(*(c.to_pylist() for c in part.columns)):
                if log != current:
                    if out is not None:
                        yield done()
                    current, n = log, 0
                    path = f"{folder}/{uuid.uuid4().hex}.log"
                    out = store.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}")
                plain = [(o["vtype"], _bytes(o["user_key"]), None if o["value"] is None else _bytes(o["value"])) for o in ops]
                out.write(frame([batches.encode(base_seq, plain)], out.tell()))
                n += 1
        if out is not None:
            yield done()

    return keep(map_arrow(ordered, run, "log long, path string, n_records long, n_bytes long"), "log-manifest")


def _bytes(x: str | bytes) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)

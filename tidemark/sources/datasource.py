"""Table and log files as Spark data sources.

    register(spark)
    spark.read.format("tidemark_table").load("/folder")
    spark.read.format("tidemark_log").load("/folder")

A table file is read with random access: the partitions of a scan are runs of its
data blocks, and bounds on ``user_key`` that Spark pushes down pick the blocks by
the index before any is read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tidemark.functions.codec import MAX_SEQUENCE, VALUE, Corruption, pack_internal_key, parse_internal_key
from tidemark.operators import batches
from tidemark.sources import logfile
from tidemark.sources.tablefile import Table

SCHEMA = "file string, user_key binary, seq long, vtype long, value binary"
_ARROW = pa.schema([("file", pa.string()), ("user_key", pa.binary()), ("seq", pa.int64()), ("vtype", pa.int64()), ("value", pa.binary())])
#: Data blocks of one partition, and rows of one batch.
BLOCKS, ROWS = 256, 10_000


def _files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(uri, bytes) of the files of a folder, or of one file."""
    store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = store.get_file_info(base)
    found = store.get_file_info(fs.FileSelector(base)) if info.type == fs.FileType.Directory else [info]
    scheme = path.split("://", 1)[0] if "://" in path else "file"
    return sorted((f"{scheme}://{f.path}" if f.path.startswith("/") else f"{scheme}:///{f.path}", f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes))


@dataclass
class _Blocks(InputPartition):
    path: str
    size: int
    handles: list[bytes]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class TableReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        #: Least and greatest user key asked for, both inclusive.
        self.low: bytes | None = None
        self.high: bytes | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on user_key narrow the blocks; Spark still tests every row."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("user_key",) and isinstance(value, (bytes, bytearray)):
                key = bytes(value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = key if self.low is None else max(self.low, key)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = key if self.high is None else min(self.high, key)
            yield f

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path, size in _files(self.path, (".ldb", ".sst")):
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as stream:
                table = Table(stream, size, internal_keys=True)
                blocks = [(k, h) for _, k, h in (table.index.entries() if self.low is None else table.index.seek(pack_internal_key(self.low, MAX_SEQUENCE, VALUE)))]
            if self.high is not None:
                # A block's index key is not below its keys: the first past the bound is the last to read.
                past = next((i for i, (k, _) in enumerate(blocks) if k[:-8] > self.high), len(blocks))
                blocks = blocks[: past + 1]
            for a in range(0, len(blocks), BLOCKS):
                found.append(_Blocks(path, size, [h for _, h in blocks[a : a + BLOCKS]]))
        return found

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.handles:
            return
        store, at = fs.FileSystem.from_uri(partition.path)
        name, rows = partition.path.rsplit("/", 1)[-1], []
        with store.open_input_file(at) as stream:
            table = Table(stream, partition.size, internal_keys=True)
            for handle in partition.handles:
                for _, key, value in table.block(handle).entries():
                    user, seq, kind = parse_internal_key(key)
                    if (self.low is None or user >= self.low) and (self.high is None or user <= self.high):
                        rows.append((name, user, seq, kind, value))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class TableSource(DataSource):
    """Versions of table files."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_table"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TableReader:
        return TableReader(self.options["path"])


@dataclass
class _File(InputPartition):
    path: str


class LogReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(path) for path, _ in _files(self.path, (".log",))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, at = fs.FileSystem.from_uri(partition.path)
        name, rows = partition.path.rsplit("/", 1)[-1], []
        with io.BufferedReader(store.open_input_stream(at), 1 << 20) as stream:
            for record in logfile.read_stream(stream):
                try:
                    rows.extend((name, key, seq, kind, value) for seq, kind, key, value in batches.decode(record))
                except Corruption:
                    continue
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class LogSource(DataSource):
    """Versions of log files whose records are write batches; what is damaged is
    skipped, as :func:`tidemark.sources.logfile.read_log_files` does."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])


def register(spark: SparkSession) -> None:
    from tidemark.runtime import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)
    spark.dataSource.register(LogSource)

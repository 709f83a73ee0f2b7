"""The binary table format: prefix-compressed blocks with an index and a footer.

A block is entries (varint shared, varint rest, varint value length, rest, value),
u32 restart offsets and their count, then a trailer of u8 compression type (0 none,
1 snappy frames) and u32 crc32(content, type).  The metaindex names the filter
block, if there is one.  The footer is two block handles padded to 40 bytes and an
8-byte magic.
"""

from __future__ import annotations

import bisect
import functools
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import snappy
from tidemark.functions.codec import VALUE, Corruption, get_varint, internal_separator, internal_successor, pack_internal_key, parse_internal_key, put_varint, shortest_separator, short_successor
from tidemark.functions.filters import FilterBlock, FilterBlockBuilder, FilterPolicy
from tidemark.operators import files
from tidemark.runtime import fresh_path, keep, map_arrow, ship
from tidemark.sources.cache import ShardedCache, TableCache

#: Fixed value of the format.
MAGIC = 0xDB4775248B80FB57
FOOTER = 48
NONE, SNAPPY = 0, 1
FILTER_KEY = b"filter"


def by_bytes(key: bytes) -> bytes:
    return key


def by_internal_key(key: bytes) -> tuple[bytes, int]:
    """User keys up, then sequences down."""
    return key[:-8], -int.from_bytes(key[-8:], "little")


def user_part(key: bytes) -> bytes:
    return key[:-8]


class BlockBuilder:
    def __init__(self, interval: int = 16) -> None:
        self.interval, self.out, self.restarts, self.n, self.last = interval, bytearray(), [0], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n and self.n % self.interval == 0:
            self.restarts.append(len(self.out))
        elif self.n:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.out += put_varint(shared) + put_varint(len(key) - shared) + put_varint(len(value)) + key[shared:] + value
        self.n, self.last = self.n + 1, key

    def estimate(self) -> int:
        return len(self.out) + 4 * len(self.restarts) + 4

    def finish(self) -> bytes:
        return bytes(self.out) + b"".join(r.to_bytes(4, "little") for r in (*self.restarts, len(self.restarts)))


class TableBuilder:
    """Writes a table to a stream, a block at a time.

    ``order`` gives the sort key of a key; keys must increase in it.  ``policy``
    adds filters of ``filtered(key)``.  A block is compressed only where that saves
    an eighth of it.
    """

    def __init__(self, out: BinaryIO, *, block_size: int = 4096, interval: int = 16, compression: int = NONE, policy: FilterPolicy | None = None, internal_keys: bool = False) -> None:
        self.out, self.block_size, self.interval, self.compression = out, block_size, interval, compression
        self.order = by_internal_key if internal_keys else by_bytes
        self.filtered = user_part if internal_keys else by_bytes
        self.separator, self.successor = (internal_separator, internal_successor) if internal_keys else (shortest_separator, short_successor)
        self.policy = policy
        self.filters = FilterBlockBuilder(policy) if policy else None
        self.index, self.block = BlockBuilder(1), BlockBuilder(interval)
        self.waiting: bytes | None = None
        self.last: bytes | None = None
        self.file_size = self.num_entries = 0
        self.closed = False

    def add(self, key: bytes, value: bytes) -> None:
        if self.closed:
            raise ValueError("the table is closed")
        if self.last is not None and self.order(key) <= self.order(self.last):
            raise ValueError("keys must increase")
        if self.waiting is not None:
            self.index.add(self.separator(self.last, key), self.waiting)
            self.waiting = None
        if self.filters:
            self.filters.add(self.filtered(key))
        self.block.add(key, value)
        self.last, self.num_entries = key, self.num_entries + 1
        if self.block.estimate() >= self.block_size:
            self.flush()

    def flush(self) -> None:
        """End the data block, if it holds anything."""
        if self.block.n:
            self.waiting, self.block = self._put(self.block.finish()), BlockBuilder(self.interval)
            if self.filters:
                self.filters.start_block(self.file_size)

    def _put(self, content: bytes, compress: bool = True) -> bytes:
        kind = NONE
        if compress and self.compression == SNAPPY:
            packed = snappy.compress(content)
            if len(packed) < len(content) - len(content) // 8:
                kind, content = SNAPPY, packed
        handle = put_varint(self.file_size) + put_varint(len(content))
        tail = bytes([kind])
        self._write(content + tail + zlib.crc32(content + tail).to_bytes(4, "little"))
        return handle

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.file_size += len(data)

    def finish(self) -> None:
        self.flush()
        meta = BlockBuilder(self.interval)
        if self.filters:
            meta.add(FILTER_KEY + self.policy.name.encode(), self._put(self.filters.finish(), compress=False))
        if self.waiting is not None:
            self.index.add(self.successor(self.last), self.waiting)
        handles = self._put(meta.finish()) + self._put(self.index.finish())
        self._write(handles.ljust(FOOTER - 8, b"\0") + MAGIC.to_bytes(8, "little"))
        self.closed = True

    def abandon(self) -> None:
        """Give the table up; nothing more is written."""
        self.closed = True


def write_table(entries: Iterator[tuple[bytes, bytes]], block_size: int = 4096, interval: int = 16, **options) -> bytes:
    """A table of increasing keys as bytes."""
    out = io.BytesIO()
    builder = TableBuilder(out, block_size=block_size, interval=interval, **options)
    for key, value in entries:
        builder.add(key, value)
    builder.finish()
    return out.getvalue()


class Block:
    """An opened block: seeks search the restart points, then go on entry by entry."""

    def __init__(self, data: bytes, order: Callable = by_bytes) -> None:
        if len(data) < 4:
            raise Corruption("block is too short")
        n = int.from_bytes(data[-4:], "little")
        self.end = len(data) - 4 - 4 * n
        if n < 1 or self.end < 0:
            raise Corruption("bad restart count")
        self.data, self.order = data, order
        self.restarts = [int.from_bytes(data[i : i + 4], "little") for i in range(self.end, len(data) - 4, 4)]

    def entries(self, at: int = 0) -> Iterator[tuple[int, bytes, bytes]]:
        """(offset, key, value) from a restart point on."""
        key = b""
        while at < self.end:
            start = at
            shared, at = get_varint(self.data, at, 32)
            rest, at = get_varint(self.data, at, 32)
            size, at = get_varint(self.data, at, 32)
            if shared > len(key) or at + rest + size > self.end:
                raise Corruption("bad entry")
            key = key[:shared] + self.data[at : at + rest]
            yield start, key, self.data[at + rest : at + rest + size]
            at += rest + size

    def seek(self, key: bytes) -> Iterator[tuple[int, bytes, bytes]]:
        """Entries from the first whose key is not below ``key``."""
        wanted = self.order(key)
        if self.end:
            # The last restart point whose key is below the wanted one.
            i = bisect.bisect_left(self.restarts, wanted, key=lambda at: self.order(next(self.entries(at))[1]))
            reached = False
            for entry in self.entries(self.restarts[max(0, i - 1)]):
                reached = reached or self.order(entry[1]) >= wanted
                if reached:
                    yield entry

    def backward(self, before: bytes | None = None) -> Iterator[tuple[int, bytes, bytes]]:
        """Entries below ``before`` (all, if None) from the last to the first: each
        restart run is read forward and given in reverse."""
        limit = None if before is None else self.order(before)
        ends = [*self.restarts[1:], self.end]
        for start, end in zip(reversed(self.restarts), reversed(ends)):
            held = []
            for entry in self.entries(start):
                if entry[0] >= end or limit is not None and self.order(entry[1]) >= limit:
                    break
                held.append(entry)
            yield from reversed(held)


class Table:
    """Random access to a table over a stream that can seek: the footer, index and
    filters are read when it is opened, data blocks as they are asked for."""

    def __init__(self, stream: BinaryIO, size: int, *, policy: FilterPolicy | None = None, internal_keys: bool = False, verify: bool = True, blocks: ShardedCache | None = None) -> None:
        self.stream, self.verify, self.cached = stream, verify, blocks
        self.cache_id = blocks.new_id() if blocks else 0
        self.order = by_internal_key if internal_keys else by_bytes
        self.filtered = user_part if internal_keys else by_bytes
        if size < FOOTER:
            raise Corruption("file is too short to be a table")
        footer = self._read(size - FOOTER, FOOTER)
        if int.from_bytes(footer[-8:], "little") != MAGIC:
            raise Corruption("bad magic number")
        self.meta_at, at = get_varint(footer, 0)
        meta_size, at = get_varint(footer, at)
        self.index = Block(self._block(footer, at), self.order)
        self.filters: FilterBlock | None = None
        if policy:
            # A table is whole without its filters, so trouble in them is passed over.
            try:
                meta = Block(self._block(put_varint(self.meta_at) + put_varint(meta_size)))
                name = FILTER_KEY + policy.name.encode()
                found = next((v for _, k, v in meta.seek(name) if k == name), None)
                if found is not None:
                    self.filters = FilterBlock(policy, self._block(found))
            except Corruption:
                self.filters = None

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def _block(self, handle: bytes, at: int = 0) -> bytes:
        offset, at = get_varint(handle, at)
        size, _ = get_varint(handle, at)
        body = self._read(offset, size + 5)
        if len(body) != size + 5:
            raise Corruption("truncated block read")
        if self.verify and zlib.crc32(body[: size + 1]) != int.from_bytes(body[-4:], "little"):
            raise Corruption("block checksum mismatch")
        if body[size] == SNAPPY:
            return snappy.decompress(body[:size])
        if body[size] != NONE:
            raise Corruption("bad block type")
        return body[:size]

    def blocks(self) -> list[tuple[bytes, bytes]]:
        """(index key, handle) of every data block."""
        return [(k, v) for _, k, v in self.index.entries()]

    def block(self, handle: bytes) -> Block:
        if self.cached is None:
            return Block(self._block(handle), self.order)
        key = (self.cache_id, get_varint(handle, 0)[0])
        entry = self.cached.lookup(key)
        if entry is None:
            block = Block(self._block(handle), self.order)
            entry = self.cached.insert(key, block, len(block.data))
        # Python keeps a block for as long as somebody reads it.
        self.cached.release(entry)
        return entry.value

    def scan(self, start: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Entries in order, from the first key not below ``start``."""
        for i, (_, _, handle) in enumerate(self.index.entries() if start is None else self.index.seek(start)):
            block = self.block(handle)
            for _, key, value in block.entries() if start is None or i else block.seek(start):
                yield key, value

    def scan_back(self, before: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Entries below ``before`` (all, if None) in reverse order."""
        blocks = self.blocks()
        if before is not None:
            # Up to the block that could hold it; its later blocks hold only greater keys.
            blocks = blocks[: bisect.bisect_left(blocks, self.order(before), key=lambda b: self.order(b[0])) + 1]
        for _, handle in reversed(blocks):
            for _, key, value in self.block(handle).backward(before):
                yield key, value

    def get(self, key: bytes) -> tuple[bytes, bytes] | None:
        """The first entry not below ``key`` in the block that would hold it; None
        where there is none, or where the block's filter lacks the key."""
        for _, _, handle in self.index.seek(key):
            if self.filters and not self.filters.may_match(get_varint(handle, 0)[0], self.filtered(key)):
                return None
            return next(((k, v) for _, k, v in self.block(handle).seek(key)), None)
        return None

    def approximate_offset_of(self, key: bytes) -> int:
        """Offset of the block that would hold a key; past the end, that of the metaindex."""
        return next((get_varint(handle, 0)[0] for _, _, handle in self.index.seek(key)), self.meta_at)


def open_table(data: bytes, **options) -> Table:
    return Table(io.BytesIO(data), len(data), **options)


def read_block(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    return ((key, value) for _, key, value in Block(block).entries())


def read_table(data: bytes, **options) -> Iterator[tuple[bytes, bytes]]:
    """All entries in key order, with every checksum verified."""
    return open_table(data, **options).scan()


def read_table_files(spark: SparkSession, path: str, *, internal_keys: bool = True) -> DataFrame:
    """user_key, seq, vtype, value and file of table files, one task per file."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        import pandas as pd

        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                rows = [(file, *(parse_internal_key(k) if internal_keys else (k, 0, 1)), v) for k, v in read_table(content)]
                yield pd.DataFrame(rows, columns=["file", "user_key", "seq", "vtype", "value"])

    return raw.mapInPandas(run, "file string, user_key binary, seq long, vtype long, value binary").withColumn("file", F.element_at(F.split("file", "/"), -1))


def read_table_blocks(spark: SparkSession, path: str, *, internal_keys: bool = True) -> DataFrame:
    """As :func:`read_table_files`, but a row of work is a data block: files are
    opened with random access, their indexes give the blocks, and blocks are dealt
    to tasks, so that no file is ever one value or one task."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as stream:
                    handles = [h for _, h in Table(stream, size, internal_keys=internal_keys).blocks()]
                yield pa.record_batch([pa.array([file] * len(handles), pa.string()), pa.array([size] * len(handles), pa.int64()), pa.array(handles, pa.binary())], names=["file", "size", "handle"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened, table, stream = None, None, None
            for file, size, handle in zip(*(c.to_pylist() for c in batch.columns)):
                if file != opened:
                    if stream:
                        stream.close()
                    store, at = fs.FileSystem.from_uri(file)
                    stream = store.open_input_file(at)
                    opened, table = file, Table(stream, size, internal_keys=internal_keys)
                rows = [(file.rsplit("/", 1)[-1], *(parse_internal_key(k) if internal_keys else (k, 0, 1)), v) for _, k, v in table.block(handle).entries()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "user_key", "seq", "vtype", "value"])
            if stream:
                stream.close()

    blocks = map_arrow(files, index, "file string, size long, handle binary")
    return map_arrow(blocks.repartition(spark.sparkContext.defaultParallelism, "file", "handle"), read, "file string, user_key binary, seq long, vtype long, value binary")


def write_table_files(log: DataFrame, folder: str | None = None, *, first_number: int = 1, compression: int = SNAPPY, policy: FilterPolicy | None = None, block_size: int = 4096) -> DataFrame:
    """A change log (user_key, seq, vtype, value) as table files of disjoint key
    ranges, one for each range partition; the manifest: number, path, file_size,
    n_entries, smallest and largest (internal keys).

    Files are named for their attempt and counted only through the manifest, so
    what a lost executor left is never read.  All versions of a key are in one file;
    of versions that repeat a key and sequence one is kept.
    """
    spark = log.sparkSession
    folder = folder or fresh_path(spark, "tables")
    rows = log.select(F.col("user_key").cast("binary").alias("user_key"), F.col("seq").cast("long").alias("seq"), F.col("vtype").cast("int").alias("vtype"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))
    ordered = rows.dropDuplicates(["user_key", "seq"]).repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, builder, first = f"part-{uuid.uuid4().hex}.ldb", None, None, b""
        for batch in batches:
            for key, seq, kind, value in zip(*(c.to_pylist() for c in batch.columns)):
                packed = pack_internal_key(key, seq, kind)
                if builder is None:
                    out, first = store.open_output_stream(f"{base}/{name}"), packed
                    builder = TableBuilder(out, compression=compression, policy=policy, internal_keys=True, block_size=block_size)
                builder.add(packed, value)
        if builder is not None:
            builder.finish()
            out.close()
            part = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int64()), (f"{folder}/{name}", pa.string()), (builder.file_size, pa.int64()), (builder.num_entries, pa.int64()), (first, pa.binary()), (builder.last, pa.binary()))], names=["number", "path", "file_size", "n_entries", "smallest", "largest"])

    found = keep(map_arrow(ordered, run, "number long, path string, file_size long, n_entries long, smallest binary, largest binary"), "table-manifest")
    return found.withColumn("number", F.col("number") + first_number)


def get_keys(manifest: DataFrame, keys: DataFrame, snapshot: int, *, policy: FilterPolicy | None = None) -> DataFrame:
    """user_key, seq, value of the newest visible version of each key (binary
    user_key) as of a snapshot, out of table files of disjoint ranges.

    A sweep over the files' ends finds each key's file, keys meet their file in one
    task, and a key costs a filter test, a search of the index and one block.
    """
    ends = manifest.select("path", "file_size", F.col("number"), F.expr("substring(largest, 1, octet_length(largest) - 8)").alias("largest"))
    placed = files.find_file(ends, keys.distinct()).where("number is not null").join(F.broadcast(ends.select("number", "path", "file_size")), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TableCache(functools.partial(Table, policy=policy, internal_keys=True))
        for batch in batches:
            rows = []
            for path, size, key in zip(*(c.to_pylist() for c in batch.columns)):
                held = cache.use(path, size)
                # Sequences go down within a key: the first entry from here on is the newest seen.
                found = held.value.get(pack_internal_key(key, snapshot, VALUE))
                cache.release(held)
                if found:
                    user, seq, kind = parse_internal_key(found[0])
                    if user == key and kind == VALUE:
                        rows.append((key, seq, found[1]))
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()))], names=["user_key", "seq", "value"])
        cache.close()

    spread = placed.select("path", "file_size", "user_key").repartition("path").sortWithinPartitions("path", "user_key")
    return map_arrow(spread, run, "user_key binary, seq long, value binary")


def offsets_of(run: DataFrame, keys: DataFrame) -> DataFrame:
    """file, first_key, offset: where a table of each file's entries (file, user_key,
    value; plain keys, no compression) would hold the keys of ``keys`` (file,
    first_key)."""
    asked = keys.groupBy("file").agg(F.collect_list("first_key").alias("asked"))

    def fold(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("user_key")
        table = open_table(write_table((k.encode(), (v or "").encode()) for k, v in zip(rows["user_key"], rows["value"])))
        found = [(key[0], k, table.approximate_offset_of(k.encode())) for k in wanted["asked"].iloc[0]] if len(wanted) else []
        return pd.DataFrame(found, columns=["file", "first_key", "offset"])

    ship(run.sparkSession)
    return run.groupBy("file").cogroup(asked.groupBy("file")).applyInPandas(fold, "file long, first_key string, offset long")

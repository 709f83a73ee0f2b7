"""Write batches: atomic ordered lists of puts and deletes.

``ops`` tables have batch_id, base_seq and pos (place within the batch, from 0)
with vtype, user_key and value; a batch header is 12 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import Corruption, get_slice, put_slice, varint_length
from tidemark.runtime import ship, spare_name

HEADER = 12
GROUP_LIMIT, SMALL_FIRST = 1 << 20, 128 << 10


def as_batches(log: DataFrame, size: int) -> DataFrame:
    """One row per batch of ``size`` consecutive sequences: batch_id, base_seq and
    ops, an array in sequence order."""
    op = F.struct("seq", "vtype", "user_key", "value")
    return log.groupBy(F.floor((F.col("seq") - 1) / size).alias("batch_id")).agg(F.min("seq").alias("base_seq"), F.sort_array(F.collect_list(op)).alias("ops"))


def explode_batches(batches: DataFrame) -> DataFrame:
    """Apply batches: op i gets sequence base + i."""
    rows = batches.select("batch_id", "base_seq", F.posexplode("ops").alias("pos", "op"))
    return rows.select("batch_id", (F.col("base_seq") + F.col("pos")).alias("seq"), F.col("op.vtype").alias("vtype"), F.col("op.user_key").alias("user_key"), F.col("op.value").alias("value"))


def put_delete_counts(batches: DataFrame) -> DataFrame:
    ops = batches.select("batch_id", F.explode("ops").alias("op"))
    return ops.groupBy("batch_id").agg(F.count(F.when(F.col("op.vtype") == 1, 1)).alias("puts"), F.count(F.when(F.col("op.vtype") == 0, 1)).alias("deletes"))


def headers(batches: DataFrame) -> DataFrame:
    return batches.select("batch_id", "base_seq", F.size("ops").cast("long").alias("n_ops"))


def op_bytes(vtype: Column, key: Column, value: Column) -> Column:
    """Encoded bytes of one op: tag, length-prefixed key, and of a put its value."""
    k, v = F.octet_length(key).cast("long"), F.octet_length(F.coalesce(value, F.lit(""))).cast("long")
    return 1 + varint_length(k) + k + F.when(vtype == 1, varint_length(v) + v).otherwise(F.lit(0))


def sizes(ops: DataFrame) -> DataFrame:
    """Approximate size of each batch of an exploded table."""
    return ops.groupBy("batch_id").agg((F.lit(HEADER) + F.sum(op_bytes(F.col("vtype"), F.col("user_key"), F.col("value")))).alias("n_bytes"))


def append(destination: DataFrame, source: DataFrame) -> DataFrame:
    """Ops of ``source`` after those of ``destination``, batch by batch (batch_id):
    the destination's base sequence holds and the source's ops are renumbered."""
    part = spare_name(destination, "_part")
    both = destination.withColumn(part, F.lit(0)).unionByName(source.withColumn(part, F.lit(1)))
    order = Window.partitionBy("batch_id").orderBy(part, "seq")
    base = F.min(F.when(F.col(part) == 0, F.col("seq"))).over(Window.partitionBy("batch_id"))
    return both.withColumn("seq", base + F.row_number().over(order) - 1).drop(part)


def group_commits(batch_sizes: DataFrame) -> DataFrame:
    """writer, batch_id, n_bytes to writer, batch_id, group_no: queued batches of one
    writer are merged until the group passes its limit (1 MiB, or the first batch
    plus 128 KiB where that batch is small).  With a ``sync`` column a batch to be
    synced does not join a group that is not; with a ``forced`` column a batch that
    forces a compaction stands alone.  A fold, one group of rows per writer."""
    ship(batch_sizes.sparkSession)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("batch_id")
        syncs = rows["sync"] if "sync" in rows else [False] * len(rows)
        forces = rows["forced"] if "forced" in rows else [False] * len(rows)
        out, group, held, limit, synced, alone = [], -1, 0, -1, False, False
        for n, sync, forced in zip(rows["n_bytes"], syncs, forces):
            if group < 0 or held + n > limit or sync and not synced or forced or alone:
                group, held, synced, alone = group + 1, 0, sync, forced
                limit = n + SMALL_FIRST if n <= SMALL_FIRST else GROUP_LIMIT
            held += n
            out.append(group)
        return rows[["writer", "batch_id"]].assign(group_no=out)

    return batch_sizes.groupBy("writer").applyInPandas(fold, "writer long, batch_id long, group_no long")


class WriteBatch:
    """An atomic list of puts and deletes on the driver, for small writes."""

    def __init__(self) -> None:
        self.ops: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((1, key, value))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((0, key, None))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def append(self, other: WriteBatch) -> WriteBatch:
        self.ops += other.ops
        return self

    def __len__(self) -> int:
        return len(self.ops)

    @property
    def approximate_size(self) -> int:
        return len(self.encode(0))

    def encode(self, base_seq: int) -> bytes:
        return encode(base_seq, self.ops)

    @classmethod
    def decode(cls, data: bytes) -> WriteBatch:
        batch = cls()
        batch.ops = [(kind, key, value) for _, kind, key, value in decode(data)]
        return batch

    def iterate(self, put: Callable[[bytes, bytes], None], delete: Callable[[bytes], None]) -> None:
        """Hand each op to a handler, in order."""
        for kind, key, value in self.ops:
            put(key, value or b"") if kind else delete(key)


def encode(base_seq: int, ops: list[tuple[int, bytes, bytes | None]]) -> bytes:
    body = b"".join(bytes([t]) + put_slice(k) + (put_slice(v or b"") if t else b"") for t, k, v in ops)
    return base_seq.to_bytes(8, "little") + len(ops).to_bytes(4, "little") + body


def decode(data: bytes) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(seq, type, key, value) of each op.  Ops before an error are yielded, so what
    was applied stays applied; then the error is raised."""
    if len(data) < HEADER:
        raise Corruption("batch is under 12 bytes")
    base, count = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:12], "little")
    at, found = HEADER, 0
    while at < len(data):
        kind = data[at]
        if kind > 1:
            raise Corruption(f"unknown op {kind}")
        key, at = get_slice(data, at + 1)
        value = None
        if kind:
            value, at = get_slice(data, at)
        yield base + found, kind, key, value
        found += 1
    if found != count:
        raise Corruption(f"{count} ops stated, {found} found")

"""Change logs as streams.

Ingest appends micro-batches to a table idempotently.  A commit carries the stream's
name and the batch's number, and a batch that the manifest has is skipped.  Of other
batches, versions above the table's last sequence are new without a look; only late
ones are held against the table's versions of their range of sequences, so a replay
under another name changes nothing either.  The newest version per key is kept as a
stateful aggregate over the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.table import KVTable


def append_batch(table: KVTable, batch: DataFrame, source: str | None = None, batch_id: int | None = None) -> int:
    """Append what is new of one micro-batch, unless the table has that batch."""
    rows = batch.dropDuplicates(["user_key", "seq"])
    last = table.last_sequence()
    low, high, above = rows.agg(F.min(F.when(F.col("seq") <= last, F.col("seq"))), F.max(F.when(F.col("seq") <= last, F.col("seq"))), F.count(F.when(F.col("seq") > last, 1))).first()
    if low is not None:
        held = table.log().where(F.col("seq").between(low, high)).select("user_key", "seq")
        fresh = rows.where(F.col("seq") <= last).join(held, ["user_key", "seq"], "left_anti")
        if not above and fresh.isEmpty():
            return last
        rows = fresh.unionByName(rows.where(F.col("seq") > last))
    elif not above:
        return last
    return table.append_versions(rows, source=source, batch=batch_id)


def ingest(stream: DataFrame, table: KVTable, checkpoint: str, *, once: bool = True, source: str | None = None) -> StreamingQuery:
    """Write a streaming change log to a table.  ``once`` drains what is there and
    ends; else micro-batches go on, and the source's rate limits hold back writers.
    ``source`` names the stream in commits (by default its checkpoint folder)."""
    name = source or checkpoint

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(table, batch, name, batch_id)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def newest_per_key(stream: DataFrame) -> DataFrame:
    """Streaming newest version per key (update mode); tombstones included, so that
    a consumer sees deletions."""
    return stream.groupBy("user_key").agg(F.max_by(F.struct("seq", "vtype", "value"), F.struct("seq", "vtype")).alias("v")).select("user_key", "v.*")


def windowed_changes(stream: DataFrame, time_col: str, *, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Puts and deletes per event-time window, with a watermark for late rows."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("window")).agg(F.count(F.when(F.col("vtype") == 1, 1)).alias("puts"), F.count(F.when(F.col("vtype") == 0, 1)).alias("deletes"))

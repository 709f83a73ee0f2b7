"""Physical layout: prefix compression, restarts, block cuts, index keys, offsets,
bloom filters and checksums over sorted runs.

A run has file (a fixed key range), user_key and value, unique keys; entries are
taken in key order within a file, so folds run per file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import byte_hash_column, common_prefix, put_varint, separator_column, varint_length
from tidemark.runtime import ship

RESTART, BLOCK, FILTER_LG = 16, 4096, 11
FILTER_SEED, BITS_PER_KEY = 0xBC9F1D34, 10
#: Bits of one word of a filter column.
WORD = 32
#: Log framing.
LOG_BLOCK, LOG_HEADER = 32768, 7


def _sorted() -> Window:
    return Window.partitionBy("file").orderBy("user_key")


def restarts(run: DataFrame, interval: int = RESTART) -> DataFrame:
    place = F.row_number().over(_sorted()) - 1
    return run.select("file", "user_key", place.cast("long").alias("place"), (place % interval == 0).alias("restart"))


def prefix_lengths(run: DataFrame, interval: int = RESTART) -> DataFrame:
    """shared with the previous key (0 at restarts), and the length of the rest."""
    place = F.row_number().over(_sorted()) - 1
    rows = run.select("file", "user_key", place.alias("place"), F.lag("user_key").over(_sorted()).alias("before"))
    shared = F.when(F.col("place") % interval == 0, F.lit(0).cast("long")).otherwise(common_prefix(F.col("before"), F.col("user_key")))
    return rows.select("file", "user_key", shared.alias("shared")).withColumn("non_shared", F.length("user_key").cast("long") - F.col("shared"))


def block_layout(run: DataFrame, block_size: int = BLOCK, interval: int = RESTART) -> DataFrame:
    """file, block, n_entries, n_bytes, first_key, last_key.

    A block closes when its estimate (entries, restart offsets and their count)
    reaches ``block_size``; restarts begin anew in each block, so this is a fold
    over a file's entries."""
    ship(run.sparkSession)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("user_key")
        out: list[list] = []
        size, n, before = 0, 0, b""
        for key, value in zip(rows["user_key"], rows["value"]):
            raw, held = key.encode(), (value or "").encode()
            if n == 0:
                out.append([int(rows["file"].iloc[0]), len(out), 0, 0, key, key])
            shared = 0
            if n % interval:
                while shared < min(len(before), len(raw)) and before[shared] == raw[shared]:
                    shared += 1
            size += len(put_varint(shared)) + len(put_varint(len(raw) - shared)) + len(put_varint(len(held))) + len(raw) - shared + len(held)
            n, before = n + 1, raw
            estimate = size + 4 * (1 + (n - 1) // interval) + 4
            out[-1][2:] = [n, estimate, out[-1][4], key]
            if estimate >= block_size:
                size, n, before = 0, 0, b""
        return pd.DataFrame(out, columns=["file", "block", "n_entries", "n_bytes", "first_key", "last_key"])

    return run.groupBy("file").applyInPandas(fold, "file long, block long, n_entries long, n_bytes long, first_key string, last_key string")


def index_separators(blocks: DataFrame) -> DataFrame:
    """Index key of each block: a short key in [its last, the next block's first)."""
    after = F.lead("first_key").over(Window.partitionBy("file").orderBy("block"))
    cut = separator_column(F.col("last_key"), F.col("next_first"))
    return blocks.withColumn("next_first", after).select("file", "block", F.when(F.col("next_first").isNull(), F.col("last_key")).otherwise(cut).alias("index_key"))


def approximate_offsets(blocks: DataFrame, trailer: int = 5) -> DataFrame:
    """Byte offset at which each block of a file starts."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("file", "block", "first_key", F.coalesce(F.sum(F.col("n_bytes") + trailer).over(before), F.lit(0)).cast("long").alias("offset"))


def log_fragments(records: DataFrame) -> DataFrame:
    """log, rec_id, n_bytes to log, rec_id, n_fragments, offset: framing in 32 KiB
    blocks with 7-byte headers; a tail under 7 bytes is padding; an empty record
    writes nothing.  A fold over a log's records."""
    ship(records.sparkSession)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rec_id")
        out, at = [], 0
        for rec, left in zip(rows["rec_id"], rows["n_bytes"]):
            n, start = 0, None
            while left > 0:
                room = LOG_BLOCK - at % LOG_BLOCK
                if room < LOG_HEADER:
                    at, room = at + room, LOG_BLOCK
                start = at if start is None else start
                put = min(left, room - LOG_HEADER)
                at, left, n = at + LOG_HEADER + put, left - put, n + 1
            out.append((int(rows["log"].iloc[0]), rec, n, at if start is None else start))
        return pd.DataFrame(out, columns=["log", "rec_id", "n_fragments", "offset"])

    return records.groupBy("log").applyInPandas(fold, "log long, rec_id long, n_fragments long, offset long")


def reassembled(fragments: DataFrame) -> DataFrame:
    """log, fragment_no, kind (full, first, middle, last), n_bytes, ok (checksum) to
    records: log, start (fragment number), n_bytes of whole records.  A record is
    full, or first, middles and last in unbroken succession."""
    order = Window.partitionBy("log").orderBy("fragment_no")
    opens = F.col("kind").isin("full", "first")
    rows = fragments.where("ok").withColumn("_gap", F.col("fragment_no") - F.lag("fragment_no").over(order))
    rows = rows.withColumn("record", F.sum(opens.cast("long") + F.when((F.col("_gap") > 1) & ~opens, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kinds = rows.groupBy("log", "record").agg(F.min("fragment_no").alias("start"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"), F.min_by("kind", "fragment_no").alias("a"), F.max_by("kind", "fragment_no").alias("b"), F.count(F.when(F.col("kind") == "middle", 1)).alias("m"))
    whole = ((F.col("a") == "full") & (F.col("n") == 1)) | ((F.col("a") == "first") & (F.col("b") == "last") & (F.col("n") == F.col("m") + 2))
    return kinds.where(whole).select("log", "start", "n_bytes")


def probe_count(bits_per_key: int = BITS_PER_KEY) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def bit_count(n: Column, bits_per_key: int = BITS_PER_KEY) -> Column:
    return (F.ceil(F.greatest(F.lit(64), n * bits_per_key) / 8) * 8).cast("long")


def bit_positions(hash_: Column, bits: Column, k: int) -> Column:
    """Double hashing in 64-bit arithmetic: h + i * ((h >> 7) | (h << 15))."""
    step = F.shiftright(hash_, 7).bitwiseOR(F.shiftleft(hash_, 15))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (hash_ + i.cast("long") * step) % bits)


def bloom_words(run: DataFrame, key_length: int, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """file, n_bits, words: each file's filter over user keys as 32-bit words.

    A key's bits become (word, bits) pairs that are or-ed within tasks before they
    are shuffled, so a file sends at most its filter's words from each task."""
    counts = run.groupBy("file").agg(bit_count(F.count("*"), bits_per_key).alias("n_bits"))
    hashed = run.select("file", byte_hash_column(F.col("user_key"), key_length, FILTER_SEED).alias("h")).join(counts, "file")
    bits = hashed.select("file", "n_bits", F.explode(bit_positions(F.col("h"), F.col("n_bits"), probe_count(bits_per_key))).alias("bit"))
    some = bits.select("file", "n_bits", F.floor(F.col("bit") / WORD).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % WORD).cast("int")).alias("bits"))
    # Every word of a filter is there, set or not.
    blank = counts.select("file", "n_bits", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bits") - 1) / WORD))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(blank).groupBy("file", "n_bits", "word").agg(F.bit_or("bits").alias("bits"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
    return words.groupBy("file", "n_bits").agg(packed.alias("words"))


def bloom_bits(run: DataFrame, key_length: int, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """file, n_bits, bit: the set bits of each file's filter."""
    words = bloom_words(run, key_length, bits_per_key).select("file", "n_bits", F.posexplode("words").alias("word", "bits"))
    each = words.select("file", "n_bits", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("at"))
    return each.where(F.call_function("getbit", "bits", "at") == 1).select("file", "n_bits", (F.col("word").cast("long") * WORD + F.col("at")).alias("bit"))


def bloom_probe(filters: DataFrame, probes: DataFrame, key_length: int, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """file, user_key to whether the file's filter (of :func:`bloom_words`) may hold
    the key: all its bits set.  One join by file; bits are tested in its row."""
    k = probe_count(bits_per_key)
    hashed = probes.select("file", "user_key", byte_hash_column(F.col("user_key"), key_length, FILTER_SEED).alias("h")).distinct().join(filters, "file")
    word = lambda at: F.get(F.col("words"), F.floor(at / WORD).cast("int"))
    held = F.forall(bit_positions(F.col("h"), F.col("n_bits"), k), lambda at: F.call_function("getbit", word(at), (at % WORD).cast("int")) == 1)
    return hashed.select("file", "user_key", held.alias("may_match"))


def filter_groups(offsets: DataFrame) -> DataFrame:
    """Filter number (one per 2 KiB of file offset) with its blocks."""
    return offsets.groupBy("file", F.floor(F.col("offset") / (1 << FILTER_LG)).alias("filter_no")).agg(F.count("*").alias("n_blocks"), F.min("first_key").alias("first_key"))


def checksums(rows: DataFrame, payload: Column) -> DataFrame:
    """CRC-32 of the type byte and the payload, as a log fragment carries."""
    return rows.withColumn("crc", F.crc32(F.concat(F.unhex(F.lit("01")), payload.cast("binary"))))


def verified(rows: DataFrame, payload: Column) -> DataFrame:
    """``rows`` as read, with ``ok``: whether the stored ``crc`` is that of the payload."""
    return rows.withColumn("ok", F.col("crc") == F.crc32(F.concat(F.unhex(F.lit("01")), payload.cast("binary"))))


def entry_bytes(key: Column, value: Column) -> Column:
    """A memtable entry: length-prefixed internal key (8 bytes more) and value."""
    k, v = F.octet_length(key).cast("long") + 8, F.octet_length(F.coalesce(value, F.lit(""))).cast("long")
    return varint_length(k) + k + varint_length(v) + v

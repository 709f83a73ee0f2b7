"""File metadata: key ranges, levels, manifests and compaction decisions.

``files`` has level, number, file_size, smallest and largest (inclusive keys).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import keep

LEVELS, L0_TRIGGER, SLOW_AT, STOP_AT = 7, 4, 8, 12
FIRST_LIMIT, GROWTH = 10 * (1 << 20), 10
MAX_FILE, MAX_OUTPUT_LEVEL = 2 << 20, 2


def level_limit(level: Column) -> Column:
    """Byte limit: 10 MiB up to level 1, ten times more for each further level."""
    return (F.lit(FIRST_LIMIT) * F.pow(F.lit(GROWTH), F.greatest(level - 1, F.lit(0)))).cast("double")


def flush_meta(log: DataFrame, file_of: Column, entry_bytes: Column) -> DataFrame:
    """What a flush records of each file: key range, sequence range, entries, bytes."""
    rows = log.withColumn("number", file_of)
    return rows.groupBy("number").agg(F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"), F.count("*").alias("n_entries"), F.sum(entry_bytes).alias("file_size"))


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("n_bytes"))


def compaction_score(files: DataFrame) -> DataFrame:
    """Score of each level: files / 4 at level 0, bytes / limit below."""
    stats = level_stats(files)
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(L0_TRIGGER))).otherwise(F.col("n_bytes") / level_limit(F.col("level")))
    return stats.withColumn("score", F.round(score, 6)).withColumn("needs_compaction", F.col("score") >= 1).select("level", "score", "needs_compaction")


def seek_budget(files: DataFrame) -> DataFrame:
    """Seeks a file allows before it is compacted: one per 16 KiB, 100 at least."""
    return files.select("number", F.greatest(F.lit(100), F.floor(F.col("file_size") / 16384)).cast("long").alias("allowed_seeks"))


def write_state(files: DataFrame) -> DataFrame:
    n = F.count(F.when(F.col("level") == 0, 1))
    return files.agg(n.alias("n_level0"), F.when(n >= STOP_AT, "stop").when(n >= SLOW_AT, "slow").otherwise("run").alias("state"))


def overlaps(smallest: Column, largest: Column, low: Column, high: Column) -> Column:
    """Inclusive ranges; a null bound is unbounded."""
    return (low.isNull() | (largest >= low)) & (high.isNull() | (smallest <= high))


def _sweep(marks: DataFrame, asked: DataFrame, carry: dict[str, Callable[[Column], Column]], *, following: bool = False) -> DataFrame:
    """Each row of ``asked`` with what the marks before it (or, ``following``, from it
    on) add up to: a merged order of both, not a range join.

    Both have ``at``, and ``turn`` for the order of equals.  ``carry`` names columns
    of ``marks`` and how a window folds them: a max, min or sum.  The order is one
    range sort (equals are cut by a hash), and each of its partitions begins with the
    fold of those before it, so a mark stands once and all frames run forward: frames
    that look ahead are folded anew for each row.
    """
    way = F.desc if following else F.asc
    both = asked.withColumn("asked", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    placed = keep(both.orderBy(way("at"), way("turn"), F.xxhash64(*asked.columns)).withColumn("part", F.spark_partition_id()), "swept")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as partitions.
    folded = placed.groupBy("part").agg(*(fold(F.col(c)).alias(c) for c, fold in carry.items()))
    heads = folded.select("part", F.lit(0).alias("body"), *(fold(F.col(c)).over(earlier).alias(c) for c, fold in carry.items()))
    order = Window.partitionBy("part").orderBy("body", way("at"), way("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumn("body", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    return rows.select(*asked.columns, "asked", *(fold(F.col(c)).over(order).alias(c) for c, fold in carry.items())).where("asked").drop("asked")


def find_file(files: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key the first file of a sorted disjoint level whose largest >= key
    (null beyond the last)."""
    ends = files.select(F.col("largest").alias("at"), F.lit(1).alias("turn"), F.struct("largest", "number").alias("nearest"))
    asked = keys.select(F.col("user_key").alias("at"), F.lit(0).alias("turn"), "user_key")
    return _sweep(ends, asked, {"nearest": F.min}, following=True).select("user_key", F.col("nearest.number").alias("number"))


def overlap_exists(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """low, high (null is unbounded) with whether any file overlaps: of the files
    that start at or before high, the greatest end reaches low."""
    starts = files.select(F.struct(F.lit(0).alias("open"), F.col("smallest").alias("key")).alias("at"), F.lit(0).alias("turn"), F.col("largest").alias("reach"))
    asked = ranges.select(F.struct(F.col("high").isNull().cast("int").alias("open"), F.col("high").alias("key")).alias("at"), F.lit(1).alias("turn"), "low", "high")
    found = _sweep(starts, asked, {"reach": F.max})
    return found.select("low", "high", F.coalesce(F.col("reach").isNotNull() & (F.col("low").isNull() | (F.col("reach") >= F.col("low"))), F.lit(False)).alias("overlaps"))


def candidate_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Files that may hold each key in search order: level, then newest first.

    File starts cut the keys into segments.  A file covers the segments from its own
    start to the last one at or before its end, a key lies in one segment, and the
    two meet by an equal segment: what is made is bounded by the overlaps of files.
    """
    starts = files.select(F.col("smallest").alias("key")).distinct()
    numbered = starts.withColumn("segment", F.row_number().over(Window.orderBy("key")))
    marks = numbered.select(F.col("key").alias("at"), F.lit(0).alias("turn"), "segment")
    last = {"segment": F.max}
    ends = _sweep(marks, files.select(F.col("largest").alias("at"), F.lit(1).alias("turn"), "level", "number", "smallest", "largest"), last)
    ends = ends.withColumnRenamed("segment", "to").join(numbered.select(F.col("key").alias("smallest"), F.col("segment").alias("from")), "smallest")
    covers = ends.where("from <= to").select("level", "number", "largest", F.explode(F.sequence("from", "to")).alias("segment"))
    placed = _sweep(marks, keys.select(F.col("user_key").alias("at"), F.lit(1).alias("turn"), "user_key"), last).where("segment is not null")
    found = placed.select("user_key", "segment").join(covers, "segment").where(F.col("user_key") <= F.col("largest"))
    order = Window.partitionBy("user_key").orderBy("level", F.desc("number"))
    return found.select("user_key", "level", "number", F.row_number().over(order).cast("long").alias("turn"))


def overlap_islands(files: DataFrame) -> DataFrame:
    """Level-0 closure: files that overlap, directly or through others, get one
    island number (from 1, in key order) within their level."""
    before = Window.partitionBy("level").orderBy("smallest", "number").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("level").orderBy("smallest", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("largest").over(before)
    starts = files.withColumn("_new", F.when(reach.isNull() | (reach < F.col("smallest")), 1).otherwise(0))
    return starts.select("level", "number", F.sum("_new").over(upto).alias("island"))


def overlapping_inputs(files: DataFrame, level: int, low: str | bytes | None = None, high: str | bytes | None = None) -> DataFrame:
    """The files of a level that a compaction of [low, high] (None is unbounded) takes
    in.  At level 0, where files overlap each other, a file that reaches out widens
    the range until nothing more overlaps: whole islands are taken."""
    own = files.where(F.col("level") == level)
    meets = overlaps(F.col("smallest"), F.col("largest"), F.lit(low), F.lit(high))
    if level:
        return own.where(meets)
    islands = overlap_islands(own).select("number", "island")
    placed = own.join(islands, "number")
    taken = placed.groupBy("island").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest")).where(meets).select("island")
    return placed.join(taken, "island", "left_semi").select(*files.columns)


def output_level(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """range_id, low, high to the deepest level (at most 2) a flushed memtable of
    that range may go to: no overlap at level 0 nor at the next level, and at most
    ten file sizes of overlap at the level after it.

    Files that overlap are those that start at or before high less those that end
    before low; both are running sums by level.
    """
    names = [f"n{n}" for n in range(MAX_OUTPUT_LEVEL + 1)] + [f"b{n}" for n in range(2, MAX_OUTPUT_LEVEL + 2)]
    of = {c: F.when(F.col("level") == int(c[1:]), F.lit(1).cast("long") if c[0] == "n" else F.col("file_size").cast("long")) for c in names}

    def upto(bound: str, query: str, turn: int) -> DataFrame:
        marks = files.select(F.col(bound).alias("at"), F.lit(0).alias("turn"), *(x.alias(c) for c, x in of.items()))
        return _sweep(marks, ranges.select(F.col(query).alias("at"), F.lit(turn).alias("turn"), "range_id"), dict.fromkeys(names, F.sum))

    # An open high has every file at or before it; at an open low nothing ends before.
    begun = upto("smallest", "high", 1).select("range_id", "at", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names))
    whole = files.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(f"all_{c}") for c, x in of.items()))
    open_high = ranges.where("high is null").select("range_id")
    totals = whole.first()
    begun = begun.join(open_high.withColumn("open", F.lit(True)), "range_id", "left")
    begun = begun.select("range_id", *(F.when(F.col("open"), F.lit(totals[f"all_{c}"])).otherwise(F.col(c)).alias(c) for c in names))
    ended = upto("largest", "low", -1).select("range_id", *(F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0))).alias(f"before_{c}") for c in names))
    per = begun.join(ended, "range_id").select("range_id", *((F.col(c) - F.col(f"before_{c}")).alias(c) for c in names))
    small = F.lit(GROWTH * MAX_FILE)
    one = (F.col("n0") == 0) & (F.col("n1") == 0) & (F.col("b2") <= small)
    two = one & (F.col("n2") == 0) & (F.col("b3") <= small)
    return per.select("range_id", F.when(two, 2).when(one, 1).otherwise(0).cast("long").alias("level"))


def need_compaction(files: DataFrame, seeks: DataFrame) -> DataFrame:
    """level, number (null for a whole level), reason: levels whose score reaches 1,
    and files whose seeks (number, seeks) used up their budget."""
    full = compaction_score(files).where("needs_compaction").select("level", F.lit(None).cast("long").alias("number"), F.lit("score").alias("reason"))
    spent = files.select("level", "number").join(seek_budget(files).join(seeks, "number").where("seeks >= allowed_seeks").select("number"), "number", "left_semi")
    return full.unionByName(spent.select("level", "number", F.lit("seeks").alias("reason")))


def level_index(files: DataFrame) -> DataFrame:
    order = Window.partitionBy("level").orderBy("largest", "number")
    return files.select("level", "largest", "number", "file_size", F.row_number().over(order).cast("long").alias("position"))


def apply_edits(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Live files: base and edits (edit_id, action add or delete, file columns); the
    latest action for each (level, number) wins, and of equals a delete."""
    columns = ["level", "number", "file_size", "smallest", "largest"]
    rows = base.select(F.lit(-1).cast("long").alias("edit_id"), F.lit("add").alias("action"), *columns).unionByName(edits.select("edit_id", "action", *columns))
    rest = [c for c in columns if c not in ("level", "number")]
    last = rows.groupBy("level", "number").agg(F.max_by(F.struct("action", *rest), F.struct("edit_id", F.col("action") == "delete")).alias("v"))
    return last.where("v.action = 'add'").select("level", "number", *(F.col(f"v.{c}").alias(c) for c in rest))


def live_numbers(*versions: DataFrame) -> DataFrame:
    every = versions[0].select("number")
    for v in versions[1:]:
        every = every.unionByName(v.select("number"))
    return every.distinct()


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.join(present, "number", "left_anti").select("number").distinct()


def obsolete_files(listed: DataFrame, live: DataFrame) -> DataFrame:
    return listed.join(live, "number", "left_anti").select("number").distinct()


def compaction_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("level").agg(F.sum("micros").alias("micros"), F.sum("bytes_read").alias("bytes_read"), F.sum("bytes_written").alias("bytes_written"))

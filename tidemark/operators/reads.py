"""Versioned reads over a change log (user_key, seq, vtype, value).

The order of filters is what makes these right: the snapshot bound comes before
the newest version is picked, the tombstone test after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.runtime import keep, spare_name


#: Sequences of one key that are handled together where versions are put in order.
SPLIT = 1 << 16


def newest(log: DataFrame, snapshot: int | None = None, *, keys: list[str] | None = None) -> DataFrame:
    """The newest version of each key as of ``snapshot``, tombstones included.

    A partial aggregate: each task sends one row for each of its keys."""
    rows = log if snapshot is None else log.where(F.col("seq") <= snapshot)
    by = keys or ["user_key"]
    rest = [c for c in log.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("seq", "vtype")).alias("v")).select(*by, *(F.col(f"v.{c}").alias(c) for c in rest))


def snapshot_read(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Visible rows as of ``snapshot``: newest versions that are not tombstones."""
    return newest(log, snapshot).where("vtype = 1")


def point_get(log: DataFrame, key: str | bytes, snapshot: int | None = None) -> DataFrame:
    """At most one row; the key filter reaches the scan."""
    return snapshot_read(log.where(F.col("user_key") == F.lit(key)), snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    return snapshot_read(log.join(keys, "user_key", "left_semi"), snapshot)


def _split(seq: Column | str) -> Column:
    """Versions of one key are handled by runs of SPLIT sequences, so that a key with
    a large share of all versions is many groups and not one."""
    return F.floor(F.col(seq) / SPLIT) if isinstance(seq, str) else F.floor(seq / SPLIT)


def as_of_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each (user_key, probe_seq) the version visible then, if any.

    Probes and versions are put in one order per key and run of sequences, and the
    newest version so far is carried to each probe, so versions are not multiplied
    by probes.  A probe before its run's first version gets the last version of the
    runs before: one row for each key and run."""
    version = F.struct("vtype", "value", "seq")
    marks = log.select("user_key", _split("seq").alias("run"), "seq", F.lit(0).alias("turn"), version.alias("v"))
    asked = probes.select("user_key", _split("probe_seq").alias("run"), F.col("probe_seq").alias("seq"), F.lit(1).alias("turn"), F.lit(None).cast(marks.schema["v"].dataType).alias("v"))
    so_far = Window.partitionBy("user_key", "run").orderBy("seq", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.unionByName(asked).withColumn("v", F.last("v", ignorenulls=True).over(so_far)).where("turn = 1")
    lasts = log.groupBy("user_key", _split("seq").alias("run")).agg(F.max_by(version, F.struct("seq", "vtype")).alias("last"))
    runs = lasts.unionByName(asked.select("user_key", "run").distinct(), allowMissingColumns=True).groupBy("user_key", "run").agg(F.max("last").alias("last"))
    before = Window.partitionBy("user_key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("user_key", "run", F.last("last", ignorenulls=True).over(before).alias("earlier"))
    found = seen.join(carried, ["user_key", "run"]).withColumn("v", F.coalesce("v", "earlier")).where("v.vtype = 1")
    return found.select("user_key", F.col("seq").alias("probe_seq"), F.col("v.seq").alias("seq"), F.col("v.value").alias("value"))


def existing(keys: DataFrame, visible: DataFrame) -> DataFrame:
    return keys.join(visible, "user_key", "left_semi")


def missing(keys: DataFrame, visible: DataFrame) -> DataFrame:
    return keys.join(visible, "user_key", "left_anti")


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Rows numbered from 1 in a global order, without a single-task window.

    A range sort is written with its partition and place; partition sizes (as many
    rows as partitions) are summed up and added."""
    at, part, place, n, start = (spare_name(df, c) for c in ("_at", "_part", "_place", "_n", "_start"))
    placed = keep(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn(part, F.shiftright(at, 33)).withColumn(place, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy(part).agg(F.count("*").alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    # As many rows as partitions.
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(start) + F.col(place) + 1).select(*df.columns, name)


def scan(log: DataFrame, snapshot: int | None = None, *, backward: bool = False, sort_key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Visible rows in key order with their position from 1.  ``sort_key`` is another
    comparator: keys are in the order of what it makes of them."""
    key = (sort_key or (lambda k: k))(F.col("user_key"))
    return with_position(snapshot_read(log, snapshot), key.desc() if backward else key.asc())


def seek(visible: DataFrame, target: str | bytes) -> DataFrame:
    """The first visible key >= target (a top-1, not a sort)."""
    return visible.where(F.col("user_key") >= F.lit(target)).orderBy("user_key").limit(1)


def seek_before(visible: DataFrame, target: str | bytes) -> DataFrame:
    """The last visible key < target."""
    return visible.where(F.col("user_key") < F.lit(target)).orderBy(F.desc("user_key")).limit(1)


def range_scan(log: DataFrame, low: str | bytes | None, high: str | bytes | None, snapshot: int | None = None) -> DataFrame:
    """Visible rows in [low, high); None is unbounded.  Bounds reach the scan."""
    rows = log
    if low is not None:
        rows = rows.where(F.col("user_key") >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col("user_key") < F.lit(high))
    return snapshot_read(rows, snapshot)


def prefix_scan(log: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    """startswith is pushed to the scan as a string-prefix filter."""
    return snapshot_read(log.where(F.startswith("user_key", F.lit(prefix))), snapshot)


def first_last(visible: DataFrame) -> DataFrame:
    return visible.agg(F.min("user_key").alias("first_key"), F.min_by("value", "user_key").alias("first_value"), F.max("user_key").alias("last_key"), F.max_by("value", "user_key").alias("last_value"))


def neighbours(visible: DataFrame) -> DataFrame:
    """user_key, prev_key, next_key: joins on positions instead of one global window."""
    placed = keep(with_position(visible.select("user_key"), "user_key"), "positions")
    after = placed.select((F.col("position") - 1).alias("position"), F.col("user_key").alias("next_key"))
    before = placed.select((F.col("position") + 1).alias("position"), F.col("user_key").alias("prev_key"))
    return placed.join(before, "position", "left").join(after, "position", "left").select("user_key", "prev_key", "next_key")


def merge_runs(*runs: DataFrame) -> DataFrame:
    """k-way merge: all versions of all runs, (user_key, seq desc, run), numbered."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return with_position(every, F.col("user_key"), F.col("seq").desc(), F.col("run_id"))


def internal_scan(log: DataFrame) -> DataFrame:
    """Every version with its rank among its key's versions, newest first: its rank
    within its run of sequences, and the versions of the runs after."""
    run, above = spare_name(log, "_run"), spare_name(log, "_above")
    placed = log.withColumn(run, _split("seq"))
    after = Window.partitionBy("user_key").orderBy(F.desc(run)).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("user_key", run).agg(F.count("*").alias(above))
    counts = counts.select("user_key", run, F.coalesce(F.sum(above).over(after), F.lit(0)).alias(above))
    order = Window.partitionBy("user_key", run).orderBy(F.desc("seq"), F.desc("vtype"))
    ranked = placed.withColumn("version", F.row_number().over(order).cast("long")).join(counts, ["user_key", run])
    return ranked.select(*log.columns, (F.col("version") + F.col(above)).alias("version"))


def get_with_level(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Newest visible version of each key with the level it comes from: levels are
    searched from 0 down and the first hit, tombstone or not, stops the search."""
    rows = log if snapshot is None else log.where(F.col("seq") <= snapshot)
    found = rows.groupBy("user_key").agg(F.min_by(F.struct("vtype", "value", "seq", "level"), F.struct(F.col("level"), -F.col("seq"))).alias("v"))
    return found.where("v.vtype = 1").select("user_key", F.col("v.seq").alias("seq"), F.col("v.level").alias("level"), F.col("v.value").alias("value"))


def compact(log: DataFrame, snapshots: list[int], *, bottom: bool = True) -> DataFrame:
    """Major compaction: a version stays if it is the newest that some retained
    snapshot (or the present) sees; at the bottom level a tombstone with nothing
    older kept below it goes too, as no deeper run can hold what it hides."""
    bounds = sorted(set(snapshots))
    rank = sum((F.when(F.col("seq") > s, 1).otherwise(0) for s in bounds), F.lit(0))
    band = spare_name(log, "band")
    # At most one version for each key and snapshot leaves a task.
    kept = newest(log.withColumn(band, rank), keys=["user_key", band]).select(*log.columns)
    if not bottom:
        return kept
    below = spare_name(log, "_below")
    older = Window.partitionBy("user_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn(below, F.max(F.when(F.col("vtype") == 1, 1)).over(older)).where((F.col("vtype") == 1) | F.col(below).isNotNull()).drop(below)


def duplicate_versions(log: DataFrame) -> DataFrame:
    """How many (user_key, seq) pairs stand more than once, and the extra rows."""
    return log.groupBy("user_key", "seq").agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def distinct_sorted(log: DataFrame) -> DataFrame:
    """First value (by seq) of each key, in a position of the key order."""
    return with_position(log.groupBy("user_key").agg(F.min_by("value", "seq").alias("value")), "user_key")


class Cursor:
    """A place among visible rows: first, last, seek, next and prev move it.

    Each move is a top-1 query over the key bound (never a sort of the table);
    for long runs of moves, scan a range.  An error of a move is kept as ``status``
    and leaves the cursor invalid.
    """

    def __init__(self, visible: DataFrame) -> None:
        self.visible, self.row, self.status = visible, None, None

    def _move(self, found: DataFrame) -> bool:
        try:
            self.row = found.first()
        except Exception as e:  # kept, as a scan goes on where it can
            self.row, self.status = None, e
        return self.valid

    @property
    def valid(self) -> bool:
        return self.row is not None

    @property
    def key(self) -> str | bytes:
        return self._at().user_key

    @property
    def value(self) -> str | bytes:
        return self._at().value

    def _at(self) -> Row:
        if self.row is None:
            raise ValueError("the cursor is not at a row")
        return self.row

    def first(self) -> bool:
        return self._move(self.visible.orderBy("user_key").limit(1))

    def last(self) -> bool:
        return self._move(self.visible.orderBy(F.desc("user_key")).limit(1))

    def seek(self, target: str | bytes) -> bool:
        """To the first key >= target."""
        return self._move(seek(self.visible, target))

    def next(self) -> bool:
        return self._move(self.visible.where(F.col("user_key") > F.lit(self.key)).orderBy("user_key").limit(1))

    def prev(self) -> bool:
        return self._move(seek_before(self.visible, self.key))

    def __iter__(self) -> Iterator[Row]:
        """Rows from here on, a partition at a time."""
        if self.valid:
            yield from self.visible.where(F.col("user_key") >= F.lit(self.key)).orderBy("user_key").toLocalIterator()

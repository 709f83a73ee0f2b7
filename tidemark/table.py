"""A versioned key-value table on Parquet.

Data files are immutable Parquet folders, one per commit, range-partitioned and
sorted by key so that key filters prune files and row groups.  Edits are appended
to a manifest of small Parquet commits: each adds or removes data folders and
states the last sequence, and what is current is the fold of the edits (latest
action wins).  A commit is visible once its edit is written.

One writer at a time: a commit's number is claimed by creating a file before the
last sequence is read, and a claim that another writer holds is an error.  A
compaction folds the manifest into one commit and deletes those before it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import Busy, Closed, InvalidArgument, NotFound, StoreIOError
from tidemark.operators import reads

LOG = "user_key {kind}, seq long, vtype long, value {kind}"
EDIT = "edit_id long, action string, level long, folder string, last_seq long, n_rows long, source string, batch long"


@dataclass
class Options:
    """How a table is opened and written."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    key_type: str = "string"
    compression: str = "snappy"
    bloom: bool = True
    extra: dict[str, str] = field(default_factory=dict)


class KVTable:
    """Put, delete, get, scan, snapshot and compact over a folder."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        if self.options.key_type not in ("string", "binary"):
            raise InvalidArgument(f"key type {self.options.key_type}")
        self.schema = LOG.format(kind=self.options.key_type)
        self.closed, self.failure = False, None
        found = self._edits() is not None
        if found and self.options.error_if_exists:
            raise InvalidArgument(f"{path} exists")
        if not found:
            if not self.options.create_if_missing:
                raise NotFound(path)
            self._publish([("none", 0, "", 0, 0)], 0)

    def _file(self, name: str):
        """A path of this table and its file system."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claim(self) -> int:
        """The next edit's number, for this writer alone until it is published."""
        edit = self._next_edit()
        where, store = self._file(f"claims/{edit:012d}")
        if not store.createNewFile(where):
            raise Busy(f"another writer holds edit {edit} of {self.path}")
        return edit

    def release(self) -> None:
        """Give up the claim of a writer that died before it published."""
        where, store = self._file(f"claims/{self._next_edit():012d}")
        store.delete(where, False)

    def _edits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(EDIT).parquet(f"{self.path}/manifest/*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _publish(self, edits: list[tuple], edit_id: int) -> None:
        rows = [(edit_id, *edit, *(None,) * (7 - len(edit))) for edit in edits]
        self.spark.createDataFrame(rows, EDIT).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/{edit_id:012d}")

    def _open(self) -> DataFrame:
        if self.closed:
            raise Closed(self.path)
        if self.failure:
            raise Closed(f"an earlier write failed: {self.failure}")
        edits = self._edits()
        if edits is None:
            raise NotFound(self.path)
        return edits

    def live(self) -> DataFrame:
        """level, folder, n_rows of current data folders."""
        last = self._open().where("folder <> ''").groupBy("folder").agg(F.max_by(F.struct("action", "level", "n_rows"), "edit_id").alias("v"))
        return last.where("v.action = 'add'").select("v.level", "folder", "v.n_rows")

    def last_sequence(self) -> int:
        return self._open().agg(F.max("last_seq")).first()[0] or 0

    def _next_edit(self) -> int:
        return self._open().agg(F.max("edit_id")).first()[0] + 1

    def log(self) -> DataFrame:
        """All versions.  The folders of a table are bounded by compaction."""
        folders = [r.folder for r in self.live().collect()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        writer = rows.repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seq")).write.option("compression", self.options.compression)
        if self.options.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#user_key", "true")
        try:
            writer.options(**self.options.extra).parquet(f"{self.path}/data/{folder}")
        except Py4JJavaError as e:
            self.failure = str(e)[:200]
            raise StoreIOError(self.failure) from e
        return folder

    def write(self, ops: DataFrame) -> int:
        """Append ops (vtype, user_key, value, and ``pos`` for their order) as one
        atomic batch; the last sequence.  Null values of puts are empty."""
        edit = self._claim()
        try:
            base = self.last_sequence()
            kind = self.options.key_type
            if "pos" in ops.columns:
                ordered = reads.with_position(ops, "pos")
            else:
                ordered = reads.with_position(ops, "user_key", "vtype", "value")
            rows = ordered.select(F.col("user_key").cast(kind), (F.col("position") + base).alias("seq"), F.col("vtype").cast("long"), F.when(F.col("vtype") == 1, F.coalesce(F.col("value").cast(kind), F.lit("").cast(kind))).alias("value"))
            return self._append(rows, edit)
        except Exception:
            self.release()
            raise

    def append_versions(self, rows: DataFrame, *, source: str | None = None, batch: int | None = None) -> int:
        """Append versions that have their sequences (a replayed log).  A batch of a
        source that an edit already has is skipped."""
        edit = self._claim()
        try:
            if source is not None and not self._open().where((F.col("source") == source) & (F.col("batch") == batch)).isEmpty():
                self.release()
                return self.last_sequence()
            return self._append(rows, edit, source, batch)
        except Exception:
            self.release()
            raise

    def _append(self, rows: DataFrame, edit: int, source: str | None = None, batch: int | None = None) -> int:
        folder = self._write(rows.select("user_key", "seq", "vtype", "value"))
        top, n = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").agg(F.max("seq"), F.count("*")).first()
        last = max(top or 0, self.last_sequence())
        self._publish([("add", 0, folder, last, n, source, batch)], edit)
        return last

    def put(self, key: str | bytes, value: str | bytes) -> int:
        return self.write(self.spark.createDataFrame([(1, key, value)], f"vtype long, user_key {self.options.key_type}, value {self.options.key_type}"))

    def delete(self, key: str | bytes) -> int:
        """A tombstone; deleting an absent key is no error."""
        return self.write(self.spark.createDataFrame([(0, key, None)], f"vtype long, user_key {self.options.key_type}, value {self.options.key_type}"))

    def get(self, key: str | bytes, snapshot: int | None = None) -> str | bytes:
        row = reads.point_get(self.log(), key, snapshot).first()
        if row is None:
            raise NotFound(key)
        return row.value

    def snapshot(self) -> int:
        """A sequence to read as of."""
        return self.last_sequence()

    def read(self, snapshot: int | None = None) -> DataFrame:
        return reads.snapshot_read(self.log(), snapshot)

    def scan(self, low=None, high=None, snapshot: int | None = None, *, backward: bool = False) -> DataFrame:
        order = F.col("user_key").desc() if backward else F.col("user_key").asc()
        return reads.range_scan(self.log(), low, high, snapshot).orderBy(order)

    def compact(self, snapshots: list[int] | None = None, *, level: int | None = None) -> None:
        """Merge all folders into one run at level 1, or those of one ``level`` into
        the next; reads as of the present and of the given snapshots stay as they
        are.  Tombstones go only where no older run is left that they could hide."""
        every = [r for r in self.live().collect()]
        merged = [r for r in every if level is None or r.level == level]
        rest = [r for r in every if r not in merged]
        if not merged:
            return
        edit = self._claim()
        try:
            last = self.last_sequence()
            log = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{r.folder}" for r in merged))
            kept = reads.compact(log, [*(snapshots or []), last], bottom=not rest)
            folder = self._write(kept.select("user_key", "seq", "vtype", "value"))
            n = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").count()
            # The fold of all edits as one: batches seen stay known.
            seen = self._open().where("source is not null").groupBy("source").agg(F.collect_set("batch").alias("batches")).collect()
            tokens = [("none", 0, "", last, 0, r.source, b) for r in seen for b in r.batches]
            whole = [("fold", 0, "", last, 0), *(("add", r.level, r.folder, last, r.n_rows) for r in rest)]
            self._publish([*whole, ("add", 1 if level is None else level + 1, folder, last, n), *(("delete", 0, r.folder, last, 0) for r in merged), *tokens], edit)
        except Exception:
            self.release()
            raise

    def trim(self) -> list[str]:
        """Delete commits before the last compaction, and data folders and claims that
        nothing live needs; the folders' names.  For readers of old snapshots: after
        they are done."""
        live = {r.folder for r in self.live().collect()}
        edits = self._open()
        last = edits.where("action = 'fold'").agg(F.max("edit_id")).first()[0]
        for kind, gone in (("manifest", last), ("claims", self._next_edit())):
            where, store = self._file(kind)
            if gone is not None and store.exists(where):
                for s in store.listStatus(where):
                    if s.getPath().getName().isdigit() and int(s.getPath().getName()) < gone:
                        store.delete(s.getPath(), True)
        where, store = self._file("data")
        folders = [s.getPath() for s in store.listStatus(where)] if store.exists(where) else []
        dead = [f for f in folders if f.getName() not in live]
        for f in dead:
            store.delete(f, True)
        return sorted(f.getName() for f in dead)

    def obsolete(self) -> DataFrame:
        """Folders that edits once added and that are no longer live."""
        added = self._open().where("action = 'add'").select("folder").distinct()
        return added.join(self.live().select("folder"), "folder", "left_anti")

    def history(self) -> DataFrame:
        order = Window.partitionBy("edit_id").orderBy("action", "folder")
        return self._open().withColumn("place", F.row_number().over(order))

    def close(self) -> None:
        self.closed = True

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Remove a table's folder through the session's own file system."""
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

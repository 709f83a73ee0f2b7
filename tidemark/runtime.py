"""Session helpers: Python code for executors, and shared scratch tables.

Intermediate tables cut lineage and survive lost executors.  They go under the
folder named by ``spark.checkpoint.dir``, which every executor of a cluster can
see; only a local-mode session without that setting gets a folder of its own.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers import what a pickled function refers to; a session whose
    executors lack the package (or run in another folder) gets it as a py-file.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidemark-py-")
    path = Path(folder, "tidemark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; set here only where it is unset."""
    found = spark.conf.get(SETTING, None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} is unset; name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


#: Writer options for tables whose rows hold large binary values: small row groups
#: (a writer and a reader hold one each) and no dictionary of values that never repeat.
#: Sizes are looked at after each row; the default, after 100, makes pages and row groups of
#: 100 large rows at least, and a codec keeps buffers of its largest page for good.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": 1}


def keep(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with writer options, and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete tables written by :func:`keep` that nothing will read again."""
    for df in kept:
        path = getattr(df, "kept_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or the like of it that no column of ``df`` starts with."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def opens(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether Arrow has a file system for a path as Spark resolves it (for a list, its
    first), so that a task can open the files there and read them piece by piece."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path if isinstance(path, str) else path[0])
    try:
        fs.FileSystem.from_uri(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Free memory of this process, Arrow's and the C library's, goes back to the system.

    The C library keeps what numpy frees (some 50 to 85 MB after a task) unless asked;
    where it has no ``malloc_trim``, as outside of glibc, only Arrow's goes back.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on every executor.

    At a task's end free memory is given back, so that a worker kept for the next
    task holds little more than an idle one.
    """
    ship(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(released, schema)

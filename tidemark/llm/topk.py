"""Exact top-k search by block-at-a-time pruning.

Vectors are laid in an order that puts similar ones together - by the nearest of
``PIVOTS`` rows, then by id - and cut into blocks of document ranges of that order.
A block keeps a forward index (its ids and an integer matrix) and the maximum and
minimum of every term (dimension), so a query's score in the block is at most the
sum over terms of the larger of weight times maximum and weight times minimum.

For each query a task orders its blocks by that bound and scores them through their
forward indexes until the next bound falls below the k-th best score; a block whose
bound equals it is still scored, since it may hold a smaller id.  The k-th best
score starts from a floor that all tasks share: a first round scores, in every
task, only the best block of each query, and the k-th best of what it found
anywhere is a score that the final k-th cannot be below.

Queries are a table in the shared folder.  Tasks read it in groups of at most
``GROUP``, so neither the driver nor a task holds more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import keep, map_arrow

ROWS = 128
"""Most vectors in one block."""
GROUP = 1024
"""Queries that a task holds at a time."""
PIVOTS = 256
"""Rows, those of least hash, that give blocks their order; results do not depend on them."""
SEARCHED = 128 << 20
"""Bytes of blocks that a task holds at a time."""
BLOCKS = "width int, ids binary, matrix binary, high binary, low binary"
_EXACT = float(1 << 53)
_LONG = 2.0**63


def quantised(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of every component as long; null where the vector is null or
    holds a null or non-finite component.  A product beyond 64 bits is its largest
    or smallest number, as in a cast to long."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), scaled.cast("array<bigint>"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column padded with zeros: a missing component adds nothing to a product."""
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(column), max(int(lengths.max(initial=0)), width or 0)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def _placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v and the number of the nearest pivot, by direction."""
    units = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                matrix = _matrix(part.column(1)).astype(np.float64)
                n = min(matrix.shape[1], units.shape[1])
                near = (matrix[:, :n] @ units[:, :n].T).argmax(axis=1) if n else np.zeros(len(matrix), np.int64)
                yield pa.record_batch([pa.array(near, pa.int32()), part.column(0), part.column(1)], names=["near", "vec_id", "v"])

    return map_arrow(vectors, run, "near int, vec_id long, v array<bigint>")


def build_blocks(vectors: DataFrame) -> DataFrame:
    """The block table of (vec_id, v): ranges of rows in order of pivot and id."""
    some = [r.v for r in vectors.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(PIVOTS).select("v").toLocalIterator()]
    pivots = _matrix(pa.array(some, pa.list_(pa.int64()))).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(near[1:] != near[:-1]) + 1).tolist(), len(near)]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                for a in range(begin, end, ROWS):
                    b = min(a + ROWS, end)
                    matrix = _matrix(batch.column(2).slice(a, b - a))
                    yield pa.record_batch(
                        [pa.array([matrix.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[a:b], matrix, matrix.max(axis=0), matrix.min(axis=0)))],
                        names=["width", "ids", "matrix", "high", "low"],
                    )

    ordered = _placed(vectors, pivots).repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id")
    return map_arrow(ordered, run, BLOCKS)


class Block:
    def __init__(self, width: int, ids: bytes, matrix: bytes, high: bytes, low: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.matrix = np.frombuffer(matrix, np.int64).reshape(len(self.ids), width)
        self.high, self.low = (np.frombuffer(x, np.int64).astype(np.float64) for x in (high, low))
        self.width = width
        self.largest = float(np.maximum(np.abs(self.high), np.abs(self.low)).max(initial=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of each query's scores, as float rounded up."""
        n = min(self.width, queries.shape[1])
        q = queries[:, :n]
        up, down = np.maximum(q, 0) @ self.high[:n], np.minimum(q, 0) @ self.low[:n]
        return up + down + (np.abs(up) + np.abs(down)) * 2.0**-40 + 1

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Exact integer products; float arithmetic where no sum can round, wider
        numbers where a sum of 64 bits could overflow.  A product that is itself
        beyond 64 bits counts as the largest or smallest such number."""
        n = min(self.width, len(query))
        q = query[:n]
        size = float(np.abs(q.astype(np.float64)).sum()) * self.largest
        if size < _EXACT:
            return (self.matrix[:, :n].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        if size < _LONG:
            return self.matrix[:, :n] @ q
        wide = self.matrix[:, :n].astype(object) @ q.astype(object) if n else np.zeros(len(self.ids), object)
        return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in wide], np.int64)


def best_of(blocks: list[Block], queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray | None = None, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query id, ids, scores, blocks scored) of the k best of all blocks but the
    query itself.  ``floors`` are scores that the k-th best of the whole search is
    not below; ``most`` ends after that many blocks."""
    as_floats = queries.astype(np.float64)
    bounds = np.stack([b.bounds(as_floats) for b in blocks], axis=1)
    order = np.argsort(-bounds, axis=1, kind="stable")
    for i, own in enumerate(query_ids.tolist()):
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        least = -(2**63) if floors is None else int(floors[i])
        scored = 0
        for j in order[i][:most].tolist():
            if bounds[i, j] < least:
                break
            block = blocks[j]
            got = block.scores(queries[i])
            scored += 1
            take = np.flatnonzero((block.ids != own) & (got >= least))
            ids, scores = np.concatenate((ids, block.ids[take])), np.concatenate((scores, got[take]))
            top = np.lexsort((ids, ~scores))[:k]
            ids, scores = ids[top], scores[top]
            if len(ids) >= k:
                least = max(least, int(scores[-1]))
        yield own, ids, scores, scored


def _groups(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, floors) of the query table, some rows at a time."""
    store, at = fs.FileSystem.from_uri(path)
    for batch in ds.dataset(at, filesystem=store, format="parquet", exclude_invalid_files=False).to_batches(batch_size=GROUP):
        if batch.num_rows:
            floors = batch.column("least").fill_null(-(2**63))
            yield np.asarray(batch.column("vec_id")).astype(np.int64), _matrix(batch.column("v")), np.asarray(floors).astype(np.int64)


def _search(index: DataFrame, queries: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """query_id, vec_id, score and the numbers of blocks met and scored: the k best
    of each task's blocks for each query of a kept table."""
    path = queries.kept_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(blocks: list[Block]) -> Iterator[pa.RecordBatch]:
            for query_ids, vectors, floors in _groups(path):
                found = list(best_of(blocks, vectors, query_ids, k, floors, most))
                sizes = [len(x) for _, x, _, _ in found]
                numbers = (np.repeat([q for q, _, _, _ in found], sizes), np.concatenate([x for _, x, _, _ in found]), np.concatenate([s for _, _, s, _ in found]))
                yield pa.record_batch([pa.array(x.astype(np.int64), pa.int64()) for x in numbers], names=["query_id", "vec_id", "score"])

        blocks: list[Block] = []
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                blocks.append(Block(*(batch.column(i)[row].as_py() for i in range(5))))
                size += blocks[-1].matrix.nbytes
                if size > SEARCHED:
                    yield from out(blocks)
                    blocks, size = [], 0
        if blocks:
            yield from out(blocks)

    return map_arrow(index, run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row that meets ``is_query`` the k
    rows of the largest integer inner product, ties to the smaller id.

    A row is never a candidate of a query with its own id.  Rows with a null id, a
    null vector or null or non-finite components take no part; vectors of other
    lengths are as if padded with zeros; rows that repeat an id are candidates each
    and, as queries, one query (the vector that sorts first); other columns are
    ignored; an empty table, or no queries, give no rows.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), factor).alias("v"), is_query.alias("asks")).where("v is not null")
    index = keep(build_blocks(rows.select("vec_id", "v")), "vector-blocks")
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = keep(asked.withColumn("least", F.lit(None).cast("long")), "queries")
    floors = ranked(_search(index, queries, k, most=1)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    queries = keep(queries.drop("least").join(floors, "vec_id", "left"), "queries")
    return ranked(_search(index, queries, k)).select("query_id", "rank", "vec_id", "score")

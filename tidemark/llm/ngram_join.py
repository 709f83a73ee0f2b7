"""N-gram Jaccard join with multiple-global-order filtering.

A document's set holds its distinct word shingles (64-bit hashes).  Two sets of
Jaccard similarity at least t share a token in their prefixes - the first
|x| - ceil(t |x|) + 1 tokens - under *every* global token order, so candidates
are intersected over several orders before any pair is verified:

* order A: a fixed hash-defined universe of tokens comes first, rarest first by
  exact document frequency, then all others by hash.  Tokens of frequency one
  cannot meet anything, so they take up their places in the prefix but are not
  shuffled to lists.  A document that meets no other in these prefixes is done.
* order B, the indexed one: rarest first over *all* tokens of the documents that
  order A left, by their frequency among those, with a size and position filter.
  Common passages stand last and leave the prefixes.
* orders C and D: two independent hash permutations.  Every node left by order A has
  a sketch, its two prefixes as 32-bit hashes; a pair must share a token in both
  before any full set travels to it.

Skew.  Documents with equal sets are collapsed first.  Frequencies are partial
sums.  A posting list never becomes pairs wholesale: three centres (the member with the
fewest tokens of its own, and two drawn by hash) are verified against the other
members, and links contract the list to components.  Only members of *different*
components are then paired, and in all but short lists not by the list's token
alone: the key is that token together with a token of order C's prefix, which every
linked pair shares too.  So a list of many dissimilar members is split by what else they hold, and the
join stays exact without the square of a group of near copies.

Every stage is a shuffle join or a partial aggregate over Parquet tables in the
shared folder; nothing but counts of fixed size reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _kernels as K
from tidemark.runtime import drop, keep, map_arrow, spare_name
from tidemark.llm.components import connected_components

#: The indexed universe holds this multiple of the prefix share of all tokens.
UNIVERSE = 1.6
#: Keys of documents to verify are broadcast up to this many (8 bytes each).
BROADCAST_KEYS = 1_000_000
#: A list of up to this many members is paired by its token alone: fewer rows than
#: its members have tokens under order C.
SHORT_LIST = 48
_FLIP = np.uint64(1 << 63)


def _universe_limit(num: int, den: int) -> int:
    """Largest token value, as unsigned 64 bits, of the indexed universe."""
    return min((1 << 64) - 1, int(UNIVERSE * (1 - num / den) * 2.0**64))


def prefix_length(n: int | np.ndarray, num: int, den: int) -> int | np.ndarray:
    """|x| - ceil(t |x|) + 1."""
    return n - (-(-num * n // den)) + 1


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, set) of every row; the text is the batch's last column."""
    for batch in batches:
        raw, offsets = K.string_buffers(batch.column(batch.num_columns - 1))
        for a, b in K.pieces(offsets):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, first = K.words(part, at, K.NOT_SPACE)
            hashes = K.word_hashes(part, starts, ends)
            for i in range(b - a):
                yield batch, a + i, K.shingle_set(hashes[first[i] : first[i + 1]], k)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        one = K.mix(tokens).sum(dtype=np.uint64)
        two = K.mix(tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _signed(tokens: np.ndarray) -> np.ndarray:
    """Unsigned order kept in Spark's signed longs."""
    return (tokens ^ _FLIP).view(np.int64)


def _base(spark_docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """rid, id, key, n, s1, s2, tokens: the indexed tokens of each row in order."""
    limit = np.uint64(_universe_limit(num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        rows: list[list] = [[] for _ in range(7)]
        size = 0

        def out() -> pa.RecordBatch:
            lengths = [len(x) for x in rows[6]]
            flat = np.concatenate(rows[6]) if rows[6] else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat, pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([*(pa.array(x, t) for x, t in zip(rows, kinds)), lists], names=["rid", "id", "key", "n", "s1", "s2", "tokens"])

        ids, keys, last = [], [], None
        for batch, i, tokens in _sets(batches, k):
            if batch is not last:
                ids, keys, last = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch
            n = len(tokens)
            inside = int(np.searchsorted(tokens, limit, side="right"))
            taken = max(inside, min(n, prefix_length(n, num, den))) if n else 0
            for column, value in zip(rows, (rid, ids[i], keys[i], n, *_signature(tokens), _signed(tokens[:taken]))):
                column.append(value)
            rid += 1
            size += taken + 8
            if size > 200_000:
                yield out()
                rows, size = [[] for _ in range(7)], 0
        if rows[0]:
            yield out()

    return map_arrow(spark_docs, run, "rid long, id long, key long, n long, s1 long, s2 long, tokens array<bigint>")


def _full_sets(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """s1, s2, tokens (all of them), and the sketch: prefixes under orders C and D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            longs, ints = pa.int64(), pa.list_(pa.int32())
            return pa.record_batch([pa.array([r[0] for r in rows], longs), pa.array([r[1] for r in rows], longs), pa.array([r[2].tobytes() for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], ints) for i in (3, 4))], names=["s1", "s2", "tokens", "c", "d"])

        for _, _, tokens in _sets(batches, k):
            prefixes = (_permuted_prefix(tokens, factor, prefix_length(len(tokens), num, den)) for factor in ORDERS) if len(tokens) else ((), ())
            rows.append((*_signature(tokens), tokens, *prefixes))
            size += len(tokens) + 8
            if size > 200_000:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return map_arrow(texts, run, "s1 long, s2 long, tokens binary, c array<int>, d array<int>")


def _permuted_prefix(tokens: np.ndarray, factor: int, length: int) -> np.ndarray:
    """The first tokens under another hash order, as 32 bits of that hash."""
    with np.errstate(over="ignore"):
        ranks = K.mix(tokens * np.uint64(factor))
    first = np.partition(ranks, length - 1)[:length] if length < len(ranks) else ranks
    return np.unique(first.astype(np.uint32).view(np.int32))


#: Orders C and D, as odd multipliers before the finaliser.
ORDERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """The exact test on two sorted sets."""
    a, b = len(x), len(y)
    if den * min(a, b) < num * max(a, b):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (a + b - both)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link: first by their sketches, then by their sets."""
    sketches = [sets.select(F.col("node").alias(x), F.col("c").alias(f"c{x}"), F.col("d").alias(f"d{x}")) for x in "ab"]
    drawn = pairs.select("a", "b").join(sketches[0], "a").join(sketches[1], "b")
    drawn = drawn.where(F.arrays_overlap("ca", "cb") & F.arrays_overlap("da", "db")).select("a", "b")
    one, two = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"set_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), num, den) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = drawn.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
    return map_arrow(found, run, "a long, b long")


def _index_b(sets: DataFrame, num: int, den: int) -> DataFrame:
    """h, node, n, place, alone, spread: the prefixes under order B, without tokens
    of frequency one.  ``place`` counts those too, ``alone`` is how many a node has;
    ``spread`` is a hash of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            sizes = [len(x) for x in lists]
            for a in range(0, len(lists), 256):
                part, n = np.concatenate(lists[a : a + 256]), sizes[a : a + 256]
                nodes = np.repeat(np.asarray(batch.column(0))[a : a + 256], n)
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(np.repeat(n, n), pa.int32()), pa.array(_signed(part), pa.int64())], names=["node", "n", "h"])

    tokens = map_arrow(sets.select("node", "tokens"), run, "node long, n int, h long")
    common = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df >= 2")
    by_node = Window.partitionBy("node")
    return (
        tokens.join(common, "h")
        .withColumn("alone", F.col("n") - F.count("*").over(by_node))
        .withColumn("place", F.col("alone") + F.row_number().over(by_node.orderBy("df", "h")))
        .where(F.col("place") <= _prefix(F.col("n").cast("long"), num, den))
        .select("h", "node", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"), "alone", F.xxhash64("node").alias("spread"))
    )


def _prefix(n: Column, num: int, den: int) -> Column:
    return n - F.ceil(F.lit(num) * n / F.lit(den)).cast("long") + 1


def _can_link(n: str, m: str, i: str, j: str, num: int, den: int) -> Column:
    """Size and position filter of a token at places i and j of two prefixes.

    If it is the first token that both have, they share at most
    1 + min(n - i, m - j); a pair that links passes at its first shared token.
    Places are lower bounds, which keeps the filter safe.
    """
    sizes = F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)
    most = 1 + F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return sizes & (F.lit(num + den) * most >= F.lit(num) * (F.col(n) + F.col(m)))


def ngram_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents that link at Jaccard >= num / den on k-word shingles.

    Words are lower-cased (A-Z) runs of non-white-space; a text of fewer than k
    words is one shingle.  One row per input row: the id, ``n_shingles`` (size of
    its set), ``component_id`` (smallest id of its component) and ``n_linked``
    (how many different texts the component holds).

    Defined cases: a null or wordless text has the empty set, links with nothing
    and is its own component; rows that repeat are copies of each other; a null
    id stays null and its component is the smallest id among its links (null if
    there is none); ids that repeat with other texts are other documents; other
    columns of ``docs`` are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    base = keep(_base(rows.select("id", "key", "text"), k, num, den), "ngram-base")

    # One node for each distinct set: the first row that has it.
    heads = base.where("n > 0").groupBy("s1", "s2").agg(F.min("rid").alias("node"), F.min("id").alias("low"), F.count("*").alias("copies"))
    heads = keep(heads, "ngram-heads")
    meta = base.select(F.col("rid").alias("node"), "n", "key", "s1", "s2").join(heads.select("node"), "node", "left_semi")

    # Order A: exact document frequencies over the nodes' indexed tokens.
    own = base.where("n > 0").select(F.col("rid").alias("node"), "tokens").join(heads.select("node"), "node", "left_semi")
    tokens = own.select("node", F.explode("tokens").alias("h"))
    common = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df >= 2")
    shared = tokens.join(common, "h")
    limit = _universe_limit(num, den) - (1 << 63)
    sizes = base.where("n > 0").select(F.col("rid").alias("node"), "n", F.size(F.filter("tokens", lambda h: h <= F.lit(limit))).alias("inside"))
    listed = shared.join(sizes, "node")
    by_node = Window.partitionBy("node")
    outside = (F.col("h") > F.lit(limit)).alias("outside")
    ranked = (
        listed.select("node", "h", "df", "n", "inside", outside)
        .withColumn("rank", F.row_number().over(by_node.orderBy("outside", "df", "h")))
        .withColumn("alone", F.col("inside") - F.sum((~F.col("outside")).cast("long")).over(by_node))
        .where(F.col("outside") | (F.col("rank") + F.col("alone") <= _prefix(F.col("n"), num, den)))
    )
    lists_a = ranked.select("h", "node")
    lists_a = keep(lists_a, "ngram-lists")
    met = lists_a.groupBy("h").agg(F.count("*").alias("members")).where("members >= 2").select("h")
    active = lists_a.join(met, "h", "left_semi").select("node").distinct()
    keys = keep(active.join(meta, "node").select("node", "key", "s1", "s2"), "ngram-active")
    wanted = keys.select("key").distinct()
    wanted = F.broadcast(wanted) if keys.count() <= BROADCAST_KEYS else wanted
    sets = _full_sets(rows.join(wanted, "key", "left_semi").select("text"), k, num, den).dropDuplicates(["s1", "s2"])
    sets = keep(sets.join(keys.select("s1", "s2", "node"), ["s1", "s2"]).select("node", "tokens", "c", "d"), "ngram-sets")

    # Order B: frequencies among the nodes that order A left, over all their tokens.
    index = keep(_index_b(sets, num, den), "ngram-index")
    sizes_b = index.groupBy("h").agg(F.count("*").alias("members"), F.min(F.struct("alone", "spread", "node", "n", "place")).alias("c0"), F.max(F.struct("spread", "node", "n", "place")).alias("c1"), F.min(F.struct("spread", "node", "n", "place")).alias("c2")).where("members >= 2")
    centres = sizes_b.select("h", F.explode(F.array(*(F.struct(F.col(f"{c}.node").alias("centre"), F.col(f"{c}.n").alias("m"), F.col(f"{c}.place").alias("at")) for c in ("c0", "c1", "c2")))).alias("c")).select("h", "c.*").distinct()
    stars = (
        index.join(centres, "h")
        .where((F.col("node") != F.col("centre")) & _can_link("n", "m", "place", "at", num, den))
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )
    stars = keep(stars, "ngram-stars")
    links = keep(_verify(stars, sets, num, den), "ngram-links")
    parts = connected_components(links, "a", "b")

    # Members of one list that are still in different components.
    placed = (
        index.join(sizes_b.select("h"), "h", "left_semi")
        .join(parts, "node", "left")
        .select("h", "node", "n", "place", F.coalesce("component", "node").alias("component"))
    )
    placed = keep(placed, "ngram-placed")
    open_lists = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high").select("h", "members")
    open_members = placed.join(open_lists, "h")
    short = open_members.where(F.col("members") <= SHORT_LIST).withColumn("c", F.lit(0))
    long = open_members.where(F.col("members") > SHORT_LIST).join(sets.select("node", F.explode("c").alias("c")), "node")
    rest = short.unionByName(long.select(*short.columns))
    left, right = (rest.select("h", "c", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), F.col("component").alias(f"k{x}")) for x in "ab")
    crossing = (
        left.join(right, ["h", "c"])
        .where((F.col("a") < F.col("b")) & (F.col("ka") != F.col("kb")) & _can_link("na", "nb", "pa", "pb", num, den))
        .select("a", "b")
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    crossing = keep(crossing, "ngram-crossing")
    more = keep(_verify(crossing, sets, num, den), "ngram-more")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more), "a", "b")

    grouped = heads.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n_linked"))
    named = keep(grouped.join(lows, "component").select("s1", "s2", "component_id", "n_linked", "copies"), "ngram-named")
    drop(lists_a, keys, sets, index, stars, placed, crossing, more)
    return _attach(base, named)


def _attach(base: DataFrame, named: DataFrame) -> DataFrame:
    """Sets that stand alone keep their own id; the rest are looked up."""
    several = named.where("copies > 1 or n_linked > 1")
    out = base.select("id", "n", "s1", "s2").join(several, ["s1", "s2"], "left")
    linked = (F.col("n") > 0) & F.col("n_linked").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(linked, F.col("n_linked")).otherwise(F.lit(1).cast("long")).alias("n_linked"),
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents whose id is the smallest of its component.

    Rows with a null id stay (nothing can name them), as do wordless texts.  Ids are
    taken to be unique; rows that repeat an id stay or go together.  The ids to drop
    are broadcast when they are few by count, else joined in a shuffle.  Columns may
    have any names; an empty table stays empty.
    """
    name = spare_name(docs, "_gone")
    found = ngram_components(docs, **options)
    gone = keep(found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "ngram-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")

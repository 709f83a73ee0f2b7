"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of blocks in the shared folder.  A block holds the postings
(term, positions) of all words of a run of training documents - about
``BLOCK_BYTES``, or one longer document - so it is built without a shuffle, serves any test
set, and is also the unit of search: nothing about a hot word is ever gathered in
one place.  Terms are 64-bit word hashes, and equal hashes are taken as equal words.

A search first sums the index's counts of the test terms.  Windows with a term
that the corpus lacks cannot occur, and every other window is filed under its
rarest term.  A block looks up the terms it has, so it meets only windows whose
rarest term it holds; of those it keeps the ones whose terms it has all, and
intersects their position lists, each moved by its term's offset, from the
shortest list on.  Proximity search asks for all terms within a width.

The test set is read in slices of at most ``SLICE_WORDS`` words; each slice is a
pass over the index, written before the next one is read, so no size of test set
grows what the driver or a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kernels as K
from tidemark.runtime import LARGE_ROWS, keep, map_arrow, spare_name

WINDOW = 8
SLICE_WORDS = 500_000
#: Bytes of text of one block: its lists stay below half a megabyte, which a JVM
#: need not keep apart from its small objects.
BLOCK_BYTES = 1 << 19
#: Hashes of texts to drop are broadcast up to this many (8 bytes each).
BROADCAST_KEYS = 1_000_000


@dataclass
class TestSlice:
    """Distinct windows of some test items, as term numbers."""

    vocabulary: np.ndarray
    """Sorted distinct word hashes; a term is its place here."""
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    """Length to an (n, length) array of terms."""
    items: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    """Length to (bounds, item numbers): the items of each window."""
    names: list[str] = field(default_factory=list)
    """Item number to item id as text."""


def text_words(text: str | None) -> np.ndarray:
    """Word hashes of one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = K.words(raw, np.array([0, len(raw)]), K.ALNUM)
    return K.word_hashes(raw, starts, ends)


def _slice(items: list[tuple[str, np.ndarray]], width: int) -> TestSlice:
    out = TestSlice(np.unique(np.concatenate([w for _, w in items])) if items else np.empty(0, np.uint64))
    out.names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(out.names)}
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for name, hashes in items:
        length = min(width, len(hashes))
        terms = np.searchsorted(out.vocabulary, hashes)
        if length:
            rows = np.lib.stride_tricks.sliding_window_view(terms, length)
            found.setdefault(length, []).append((rows, number[name]))
    for length, parts in found.items():
        rows = np.concatenate([r for r, _ in parts])
        owners = np.concatenate([np.full(len(r), i) for r, i in parts])
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), owners], axis=1), axis=0)
        out.windows[length] = distinct.astype(np.int32)
        out.items[length] = (np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1])
    return out


def test_slices(benchmark: DataFrame, *, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> Iterator[TestSlice]:
    """The test set in bounded slices; items without an id or words have no windows."""
    held: list[tuple[str, np.ndarray]] = []
    size = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).where(F.col(id_col).isNotNull()).toLocalIterator():
        hashes = text_words(text)
        if not len(hashes):
            continue
        if held and size + len(hashes) > SLICE_WORDS:
            yield _slice(held, width)
            held, size = [], 0
        held.append((item, hashes))
        size += len(hashes)
    if held:
        yield _slice(held, width)


BLOCKS = "block long, ids array<long>, first array<int>, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Block table: document ids, the word position at which each document starts
    (one more than documents), and the postings: distinct terms in order (uint64),
    their counts and their positions, ordered by term and position (int32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(1))
            for a, b in K.pieces(offsets, BLOCK_BYTES):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = K.words(part, at, K.ALNUM)
                hashes = K.word_hashes(part, starts, ends)
                order = np.argsort(hashes, kind="stable").astype(np.int32)
                ranked = hashes[order]
                heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, np.int64)
                postings = (ranked[heads], np.diff(np.append(heads, len(ranked))).astype(np.int32), order)
                yield pa.record_batch(
                    [
                        pa.array([block], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a)),
                        pa.array([first.astype(np.int32)], pa.list_(pa.int32())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in postings),
                    ],
                    names=["block", "ids", "first", "terms", "counts", "positions"],
                )
                block += 1

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, BLOCKS)


class Postings:
    """One block's inverted index, read for the terms of a vocabulary."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> None:
        self.first, self.words, self.positions = first, int(first[-1]), positions
        self.place = np.full(len(vocabulary), -1, np.int32)
        """Number of a vocabulary term among the block's terms."""
        at = np.searchsorted(vocabulary, terms)
        at[at == len(vocabulary)] = 0
        found = np.flatnonzero(vocabulary[at] == terms) if len(vocabulary) else np.empty(0, np.int64)
        self.present = at[found]
        """Vocabulary terms that the block has, in order."""
        self.place[self.present] = found
        self.start, self.count = np.cumsum(counts, dtype=np.int64) - counts, counts
        # Term and position in one number: all lists laid end to end are in order.
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64) << 32, counts) | positions

    def list_of(self, term: int) -> np.ndarray:
        i = self.place[term]
        return self.positions[self.start[i] : self.start[i] + self.count[i]].astype(np.int64)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``windows``, start position) of each exact occurrence of rows of terms."""
        length = windows.shape[1]
        places = self.place[windows]
        held = np.flatnonzero((places >= 0).all(axis=1))
        if not len(held):
            return held, held
        places = places[held]
        counts = self.count[places]
        order = np.argsort(counts, axis=1, kind="stable")
        every = np.arange(len(held))
        rare = order[:, 0]
        lengths = counts[every, rare]
        which = np.repeat(every, lengths)
        within = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = self.positions[self.start[places[every, rare]][which] + within].astype(np.int64) - rare[which]
        ok = (at >= 0) & (at + length <= self.words)
        which, at = which[ok], at[ok]
        for j in range(1, length):
            offset = order[which, j]
            wanted = places[which, offset].astype(np.int64) << 32 | (at + offset)
            found = np.searchsorted(self.keys, wanted)
            found[found == len(self.keys)] = 0
            ok = self.keys[found] == wanted
            which, at = which[ok], at[ok]
        ok = np.searchsorted(self.first, at, side="right") == np.searchsorted(self.first, at + length - 1, side="right")
        return held[which[ok]], at[ok]

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Start positions of the least spans, of at most ``width`` words of one
        document, that hold all distinct ``terms``; each span starts at a term."""
        distinct = np.unique(terms)
        if not len(distinct) or (self.place[distinct] < 0).any():
            return np.empty(0, np.int64)
        lists = sorted((self.list_of(t) for t in distinct), key=len)
        anchors = lists[0]
        parts = []
        for l in lists:
            place = np.searchsorted(anchors, l)
            parts.append(l[(place < len(anchors)) & (anchors[np.minimum(place, len(anchors) - 1)] - l < width)])
        begins = np.unique(np.concatenate(parts))
        ends = begins.copy()
        for l in lists:
            at = np.searchsorted(l, begins)
            ends = np.maximum(ends, np.where(at < len(l), l[np.minimum(at, len(l) - 1)], np.iinfo(np.int64).max - 1))
        ok = (ends - begins < width) & (ends < self.words)
        begins, ends = begins[ok], ends[ok]
        return begins[np.searchsorted(self.first, begins, side="right") == np.searchsorted(self.first, ends, side="right")]


def _open(batch: pa.RecordBatch, row: int, vocabulary: np.ndarray) -> Postings:
    column = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
    arrays = [np.frombuffer(column[c].as_py(), kind) for c, kind in (("terms", np.uint64), ("counts", np.int32), ("positions", np.int32))]
    return Postings(*arrays, np.asarray(column["first"].values, np.int64), vocabulary)


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often the corpus has each vocabulary term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                terms, counts = (np.frombuffer(batch.column(i)[r].as_py(), kind) for i, kind in ((0, np.uint64), (1, np.int32)))
                at = np.searchsorted(vocabulary, terms)
                at[at == len(vocabulary)] = 0
                found = vocabulary[at] == terms
                sums[at[found]] += counts[found]
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        found = map_arrow(index.select("terms", "counts"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        out[found["term"].to_numpy(np.int64)] = found["n"]
    return out


def _filed(tests: TestSlice, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length to (window numbers by their rarest term, bounds by term, windows):
    windows with a term that the corpus lacks are left out."""
    out = {}
    for length, windows in tests.windows.items():
        often = counts[windows]
        possible = np.flatnonzero(often.min(axis=1) > 0)
        rare = windows[possible, often[possible].argmin(axis=1)]
        order = np.argsort(rare, kind="stable")
        out[length] = (possible[order], np.searchsorted(rare[order], np.arange(len(counts) + 1)), windows)
    return out


def _runs(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the runs ``bounds[r]:bounds[r + 1]`` end to end, their lengths)."""
    lengths = bounds[rows + 1] - bounds[rows]
    return np.arange(int(lengths.sum())) + np.repeat(bounds[rows] - (np.cumsum(lengths) - lengths), lengths), lengths


HITS = "block long, row int, doc_id long, n_words long, items array<string>, starts array<int>, ends array<int>"


def search(index: DataFrame, tests: TestSlice, *, every: bool = True) -> DataFrame:
    """One row per document (or, not ``every``, per document with a hit): its words,
    the ids of the items found in it, and the hit words as disjoint [start, end)
    spans of word numbers."""
    filed = _filed(tests, term_counts(index, tests.vocabulary))
    vocabulary, owners_of, names = tests.vocabulary, tests.items, tests.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                postings = _open(batch, r, vocabulary)
                first = postings.first
                n = len(first) - 1
                cover = np.zeros(postings.words + 1, np.int32)
                found: list[np.ndarray] = []
                for length, (numbers, bounds, windows) in filed.items():
                    candidates = numbers[_runs(bounds, postings.present)[0]]
                    which, at = postings.phrases(windows[candidates])
                    if not len(at):
                        continue
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length, -1)
                    row = np.searchsorted(first, at, side="right") - 1
                    pair = np.unique(np.stack([row, candidates[which]], axis=1), axis=0)
                    item_bounds, owners = owners_of[length]
                    at, lengths = _runs(item_bounds, pair[:, 1])
                    found.append(np.stack([np.repeat(pair[:, 0], lengths), owners[at]], axis=1))
                items: list[list[str]] = [[] for _ in range(n)]
                starts: list[list[int]] = [[] for _ in range(n)]
                ends: list[list[int]] = [[] for _ in range(n)]
                if found:
                    for row, item in np.unique(np.concatenate(found), axis=0).tolist():
                        items[row].append(names[item])
                    hit = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
                    cut = np.zeros(postings.words + 1, bool)  # spans end with their document
                    cut[first] = True
                    begin = np.flatnonzero(hit[1:] & (~hit[:-1] | cut))
                    end = np.flatnonzero(hit[:-1] & (~hit[1:] | cut))
                    row = np.searchsorted(first, begin, side="right") - 1
                    for i, a, b in zip(row.tolist(), (begin - first[row]).tolist(), (end - first[row]).tolist()):
                        starts[i].append(a)
                        ends[i].append(b)
                elif not every:
                    continue
                out = pa.record_batch(
                    [
                        pa.array([batch.column(0)[r].as_py()] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        batch.column(1)[r].values,
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(ends, pa.list_(pa.int32())),
                    ],
                    names=["block", "row", "doc_id", "n_words", "items", "starts", "ends"],
                )
                yield out if every else out.filter(pa.array([bool(x) for x in items], pa.bool_()))

    return map_arrow(index, run, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, every: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` (or, not ``every``, per row with a hit): doc_id,
    n_words, n_hit (words inside any occurrence), n_items, ``items`` (ids as text,
    sorted) and the hit spans.

    A window is ``width`` consecutive item words, or a shorter item as a whole.
    Null or wordless texts have no words and no hits; items without an id or
    words match nothing; items that repeat an id are one item; a null id stays;
    rows that repeat are reported each; a very long text is a block of its own;
    other columns are ignored; empty tables give no rows, or rows without hits.
    """
    index = keep(build_index(docs, id_col=id_col, text_col=text_col), "postings", **LARGE_ROWS)
    passes: list[DataFrame] = []
    held: TestSlice | None = None
    for tests in test_slices(benchmark, width=width, id_col=item_col, text_col=item_text_col):
        if held is not None:
            passes.append(keep(search(index, held, every=every and not passes), "hits"))
        held = tests
    last = search(index, held or TestSlice(np.empty(0, np.uint64)), every=every and not passes)
    return _united([*passes, last]) if passes else _counted(last)


def _counted(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), F.arrays_zip("starts", "ends").alias("spans"))


def _united(passes: list[DataFrame]) -> DataFrame:
    """Slices of the test set joined per document of the index, overlapping spans united."""
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    every = every.groupBy("block", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), spans.alias("all"))
    # Spans in order: each one less what those before it reach.
    none = F.array().cast("array<struct<starts:int,ends:int>>")
    reach = F.struct(none.alias("out"), F.lit(0).alias("end"))
    fresh = F.aggregate(
        "all",
        reach,
        lambda r, s: F.struct(
            F.when(s["ends"] > r["end"], F.concat(r["out"], F.array(F.struct(F.greatest(s["starts"], r["end"]).alias("starts"), s["ends"].alias("ends"))))).otherwise(r["out"]).alias("out"),
            F.greatest(s["ends"], r["end"]).alias("end"),
        ),
        lambda r: r["out"],
    )
    return _counted(every.withColumn("fresh", fresh).select("doc_id", "n_words", "items", F.col("fresh.starts").alias("starts"), F.col("fresh.ends").alias("ends")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item; null texts stay.

    What is dropped hangs on the text alone, so rows are named by a hash of it, not
    by their id: rows with a null or repeated id are judged like any other.  The
    hashes are broadcast when they are few by count, else joined in a shuffle.
    """
    spare = spare_name(docs, "_text")
    texts = docs.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = keep(contamination(texts, benchmark, width=width, every=False, **options).select(F.col("doc_id").alias(spare)).distinct(), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    # A null text has the hash of nothing, which no hit has.
    return docs.join(gone, F.xxhash64(docs[text_col]) == gone[spare], "left_anti")


def proximity_matches(docs: DataFrame, phrases: list[str], width: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, phrase, start): word numbers from which all distinct words of a
    phrase stand, in any order, within ``width`` words of one document; of spans
    that start at one word the least counts.

    A null or wordless text, and a phrase without words, match nothing; rows and
    phrases that repeat are reported each; a null id stays; other columns are
    ignored; an empty table gives no rows.
    """
    hashes = [text_words(p) for p in phrases]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
    asked = [np.searchsorted(vocabulary, h) for h in hashes]
    index = keep(build_index(docs, id_col=id_col, text_col=text_col), "postings", **LARGE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                postings = _open(batch, r, vocabulary)
                ids = batch.column(1)[r].values
                for phrase, terms in zip(phrases, asked):
                    at = postings.near(terms, width)
                    row = np.searchsorted(postings.first, at, side="right") - 1
                    yield pa.record_batch([ids.take(pa.array(row, pa.int64())), pa.array([phrase] * len(at), pa.string()), pa.array(at - postings.first[row], pa.int64())], names=["doc_id", "phrase", "start"])

    return map_arrow(index, run, "doc_id long, phrase string, start long")

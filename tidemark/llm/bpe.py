"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

The distinct pieces of a batch are laid out as rows of numpy matrices, one for
each length bucket, padded at the right.  In every round each unfinished row
merges its leftmost pair of least rank: ranks of adjacent pairs come from an
open-addressing hash table probed for whole matrices at once, and the row is
compacted by one place.  Rows without a mergeable pair leave the matrix.
A piece beyond the widest bucket (a text without any break) is a matrix of one
row, whose rounds merge every place of the least rank at once.

A worker remembers the ids of pieces by a 64-bit hash, in tables that grow with
their content, and keeps at most ``KEPT`` pieces from task to task.  Decoded bytes are held
against the text they came from, so a hash that two pieces share is noticed, and
that text is encoded afresh from its own pieces.

Ranks are token ids, as in rank files; decoding joins the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kernels as K
from tidemark.runtime import map_arrow
from tidemark.llm.pretokens import piece_starts

#: Bucket widths in bytes; a longer piece is a row of its own.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256)
#: Distinct pieces remembered by a worker before it starts anew.
REMEMBERED = 1_000_000
#: Pieces that a worker may remember between tasks (some 15 MB at most).
KEPT = 200_000
#: Slots, a power of two, for pieces met lately.
NEAR = 1 << 16
#: Bytes of text encoded at a time.
PIECE = 2 << 20
#: As that, where the ids are decoded and named too (a worker took 70 MB at this, 151 MB at 2 MB).
CHECKED = 1 << 19
#: Cells of one matrix.
CELLS = 1 << 19
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (base64 and rank on each line)."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines()) if token}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total, dtype=np.int64)
    return out


class HashTable:
    """uint64 keys (0 is no key) to int32 values, by open addressing; at most half of
    the slots are taken, and the table grows with its content."""

    def __init__(self, room: int = 0, none: int = -1) -> None:
        self.none, self.used = np.int32(none), 0
        self._resize(room)

    def _resize(self, room: int) -> None:
        self.bits = max(4, int(3 * max(1, room) - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, self.none, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys."""
        if 2 * (self.used + len(keys)) > self.mask:
            held = self.keys != 0
            old_keys, old_values = self.keys[held], self.values[held]
            self._resize(self.used + len(keys))
            self.used = 0
            self.put(old_keys, old_values)
        self.used += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            chosen = free[first]
            self.keys[at[chosen]], self.values[at[chosen]] = keys[chosen], values[chosen]
            left = np.ones(len(keys), bool)
            left[chosen] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.keys[at]
        hit = held == keys
        out = np.where(hit, self.values[at], self.none)
        open_ = np.flatnonzero(~hit & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out


class _Flat:
    """Runs of numbers kept end to end, addressed by (start, length)."""

    def __init__(self, kind: type) -> None:
        self.data = np.empty(1 << 16, kind)
        self.starts, self.lengths = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.used = self.runs = 0

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.resize(self.data, 2 * len(self.data))
        while self.runs + len(lengths) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        self.data[self.used : self.used + len(data)] = data
        self.starts[self.runs : self.runs + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.runs : self.runs + len(lengths)] = lengths
        self.used, self.runs = self.used + len(data), self.runs + len(lengths)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the runs end to end, lengths of the runs)."""
        lengths = self.lengths[which]
        return self.data[ragged(self.starts[which], lengths)], lengths


class PieceIds:
    """Ids of distinct pieces, remembered by hash; subclasses encode new ones."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.table, self.flat = HashTable(), _Flat(np.int32)
        # The piece met last at each slot: common ones are found here, near at hand.
        self.near, self.near_runs = np.zeros(NEAR, np.uint64), np.zeros(NEAR, np.int32)

    def rest(self) -> None:
        """At a task's end, or after a run of texts: what a worker keeps from then on is bounded."""
        if self.flat.runs > KEPT:
            self.forget()

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each piece) of the pieces raw[start:end]."""
        raise NotImplementedError

    def lookup(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Run number in ``flat`` of each piece; new pieces are learnt."""
        hashes = K.word_hashes(raw, starts, ends, lower=False) | np.uint64(1)
        if self.flat.runs > REMEMBERED:
            self.forget()
        slots = (hashes >> np.uint64(64 - NEAR.bit_length() + 1)).astype(np.int64)
        runs = self.near_runs[slots]
        far = np.flatnonzero(self.near[slots] != hashes)
        runs[far] = self.table.find(hashes[far])
        new = far[runs[far] < 0]
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            which = new[first]
            base = self.flat.runs
            if base + len(keys) > 2 * REMEMBERED:  # more new pieces than room: a table of their own
                self.forget()
                base = 0
                keys, which = np.unique(hashes, return_index=True)
                new = far = np.arange(len(hashes))
            self.flat.add(*self.learn(raw, starts[which], ends[which]))
            self.table.put(keys, np.arange(base, base + len(keys), dtype=np.int32))
            runs[new] = self.table.find(hashes[new])
        self.near[slots[far]], self.near_runs[slots[far]] = hashes[far], runs[far]
        return runs

    def encode_raw(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, bounds of each text's ids) of texts laid end to end."""
        starts = piece_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        ids, lengths = self.flat_take(self.lookup(raw, starts, ends))
        sums = np.concatenate(([0], np.cumsum(lengths)))
        return ids, sums[np.searchsorted(starts, offsets, side="left")]

    def flat_take(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.flat.take(runs)

    def count_raw(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        starts = piece_starts(raw, offsets)
        runs = self.lookup(raw, starts, np.append(starts[1:], len(raw)))
        sums = np.concatenate(([0], np.cumsum(self.flat.lengths[runs])))
        return np.diff(sums[np.searchsorted(starts, offsets, side="left")])


class Encoder(PieceIds):
    """Encodes and decodes texts by a rank table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32 | right) + 1] = rank
        self.pairs = HashTable(len(pairs), int(_NONE))
        self.pairs.put(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.token_bytes = _Flat(np.uint8)
        self.token_bytes.add(np.frombuffer(b"".join(self.tokens), np.uint8), np.array([len(t) for t in self.tokens]))
        names = [f",{i}".encode() for i in range(len(self.tokens))]
        self.names = _Flat(np.uint8)
        self.names.add(np.frombuffer(b"".join(names), np.uint8), np.array([len(t) for t in names]))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.find((left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1))

    def _matrix(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix of byte ids; (ids, lengths)."""
        width = ids.shape[1]
        inside = np.arange(width) < lengths[:, None]
        ranks = np.full((len(ids), width), _NONE, np.int32)
        paired = inside[:, 1:]
        ranks[:, :-1][paired] = self._rank(ids[:, :-1][paired], ids[:, 1:][paired])
        out_ids, out_lengths = ids.copy(), lengths.copy()
        where, places = np.arange(len(ids)), np.arange(width)
        while len(where):
            at = ranks.argmin(axis=1)
            every = np.arange(len(where))
            best = ranks[every, at]
            live = best != _NONE
            if not live.all():
                out_ids[where[~live]], out_lengths[where[~live]] = ids[~live], lengths[~live]
                ids, ranks, lengths, where, at, best = ids[live], ranks[live], lengths[live], where[live], at[live], best[live]
                every = every[: len(where)]
                if not len(where):
                    break
            ids[every, at] = best
            moved = places[:-1] > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            lengths = lengths - 1
            ranks[every, at] = _NONE
            for column, ok in ((at - 1, at > 0), (at, at < lengths - 1)):
                row, column = every[ok], column[ok]
                ranks[row, column] = self._rank(ids[row, column], ids[row, column + 1])
        return out_ids, out_lengths

    def _row(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one long row of byte ids.

        A round merges the places of the least rank from left to right, up to the
        first whose merge makes a pair of a lesser rank: what one merge at a time
        would do in as many rounds."""
        ranks = np.append(self._rank(ids[:-1], ids[1:]), _NONE)
        while (best := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == best)
            heads = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            # Of places that overlap, every second one is left for a merge.
            at = at[(np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))) % 2 == 0]
            lesser = np.zeros(len(at), bool)
            left = at > 0
            touching = np.diff(at, prepend=-3)[left] == 2
            lesser[left] = self._rank(np.where(touching, best, ids[at[left] - 1]), np.full(left.sum(), best)) < best
            right = at + 2 < len(ids)
            lesser[right] |= self._rank(np.full(right.sum(), best), ids[at[right] + 2]) < best
            if lesser.any():
                at = at[: lesser.argmax() + 1]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids[at], ranks[at] = best, _NONE
            ids, ranks = ids[kept], ranks[kept]
            at = at - np.arange(len(at))
            for pair in (at[at > 0] - 1, at[at < len(ids) - 1]):
                ranks[pair] = self._rank(ids[pair], ids[pair + 1])
        return ids

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = ends - starts
        rows: list[np.ndarray] = []  # numbers of pieces, in the order of `parts`
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        low = 0
        for width in WIDTHS:
            members = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            step = max(1, CELLS // width)
            for i in range(0, len(members), step):
                some = members[i : i + step]
                ids = np.zeros((len(some), width + 1), np.int32)
                ids[np.arange(width + 1) < sizes[some][:, None]] = self.single[raw[ragged(starts[some], sizes[some])]]
                ids, lengths = self._matrix(ids, sizes[some])
                rows.append(some)
                parts.append(ids[np.arange(width + 1) < lengths[:, None]])
                counts.append(lengths)
        for i in np.flatnonzero(sizes > WIDTHS[-1]):
            ids = self._row(self.single[raw[starts[i] : ends[i]]])
            rows.append(np.array([i]))
            parts.append(ids)
            counts.append(np.array([len(ids)]))
        order, flat, lengths = np.concatenate(rows), np.concatenate(parts), np.concatenate(counts)
        at = np.cumsum(lengths) - lengths
        back = np.argsort(order)
        return flat[ragged(at[back], lengths[back])], lengths[back]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_raw(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return self.token_bytes.take(np.asarray(ids, np.int64))[0].tobytes()

    def encode_checked(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, their bounds, decoded bytes and their bounds, for each text.

        Where the decoded bytes are not the text (two pieces share a hash), the
        batch is encoded again with nothing remembered, text by text."""
        ids, bounds = self.encode_raw(raw, offsets)
        decoded, lengths = self.token_bytes.take(ids)
        if len(decoded) != len(raw) or not np.array_equal(decoded, raw):
            parts = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                starts = piece_starts(raw[a:b], np.array([0, b - a]))
                parts.append(self.learn(raw[a:b], starts, np.append(starts[1:], b - a))[0] if b > a else np.empty(0, np.int32))
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            decoded, lengths = self.token_bytes.take(ids)
        return ids, bounds, decoded, np.concatenate(([0], np.cumsum(lengths)))[bounds]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a rank file, built once for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


def text_runs(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of about ``most`` bytes; null is empty."""
    raw, offsets = K.string_buffers(column)
    for a, b in K.pieces(offsets, most):
        yield a, b - a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


Shape = Callable[[Encoder, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]


def encode_documents(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ``ids`` (array<int>) and ``decoded`` (binary),
    the bytes that the ids decode to again.

    A null text is empty and has no ids; a null id stays; rows that repeat are
    encoded each; other columns are ignored; an empty table gives no rows.
    """
    return _mapped(docs, ranks_path, id_col, text_col, "doc_id long, ids array<int>, decoded binary", _whole)


def encode_digests(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, but n_tokens and SHA-256 of the ids (decimal,
    comma-joined) and of the decoded bytes in place of the values."""
    return _mapped(docs, ranks_path, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _whole(coder: Encoder, ids: np.ndarray, bounds: np.ndarray, decoded: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
    return [lists, pa.array([decoded[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())]


def _digests(coder: Encoder, ids: np.ndarray, bounds: np.ndarray, decoded: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    text, lengths = coder.names.take(ids)
    cuts = np.concatenate(([0], np.cumsum(lengths)))[bounds].tolist()
    text, decoded, at = memoryview(text.tobytes()), memoryview(decoded.tobytes()), at.tolist()
    named = [hashlib.sha256(text[min(a + 1, b) : b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]
    plain = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
    return [pa.array(np.diff(bounds), pa.int64()), pa.array(named, pa.string()), pa.array(plain, pa.string())]


def _mapped(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, schema: str, shape: Shape) -> DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        for batch in batches:
            for first, count, raw, offsets in text_runs(batch.column(1), CHECKED):
                yield pa.record_batch([batch.column(0).slice(first, count), *shape(coder, *coder.encode_checked(raw, offsets))], names=names)
                coder.rest()

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, schema)


def count_tokens(docs: DataFrame, ranks_path: str, *, text_col: str = "text") -> DataFrame:
    """length, n_docs of each task: partial counts, not yet summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        counts: dict[int, int] = {}
        for batch in batches:
            for _, _, raw, offsets in text_runs(batch.column(0)):
                for n, docs_of in zip(*map(np.ndarray.tolist, np.unique(coder.count_raw(raw, offsets), return_counts=True))):
                    counts[n] = counts.get(n, 0) + docs_of
        if counts:
            yield pa.record_batch([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n_docs"])
        coder.rest()

    return map_arrow(docs.select(text_col), run, "length long, n_docs long")

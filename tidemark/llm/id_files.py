"""Token ids in binary files under an adaptive context-mixing range coder.

Three models predict the next id of a block:

* order 2: the id that last followed the same two ids in the block;
* order 1: the id that last followed the same id;
* order 0: the frequencies of the block's ids so far, brought up to date after
  ``UPDATES`` ids, and the frequencies of all ids of the file's section (the prior).

Which of the four gives the id in the fewest bits is a symbol whose probabilities mix
adaptive ones kept under three contexts - the confidence of the order-2 prediction,
that of the order-1 prediction, and the two symbols before.  Each lane weighs the
contexts by how probable they held the symbols it had.  The symbol, and the id where
order 0 gives it, drive a range coder of 64 bits that moves 32 bits at once; carries
are added to the words that have been moved when a block ends.

Ids are cut into blocks of ``BLOCK``; every block starts from reset models (its
section's prior) and has a checksum, so a block decodes with its section's prior
alone, and all blocks of a batch run in step as lanes of numpy arrays.

A file is a header, then chunks, each led by a type byte:

    header     magic "TMID1\\0", u8 version
    documents  u32 documents, u32 payload bytes, u32 crc32 of the payload; zlib of
               i64 ids, u8 whether the id is null, i64 numbers of token ids
    prior      u32 distinct ids, u32 payload bytes, u32 crc32 of the payload; zlib of
               u32 differences of the ids in order, u32 frequencies
    block      u32 ids, u32 payload bytes, u32 crc32 of the ids as u32 little-endian; payload
    end        u64 documents, u64 ids

A documents chunk stands before the blocks of its documents' ids, and a prior begins
a section: the blocks up to the next prior.  A section has at most ``DISTINCT``
distinct ids; ids are any unsigned 32-bit numbers.  Documents go to files in
ascending id order (range partitions, sorted within).
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import fresh_path, keep, map_arrow, partitions
from tidemark.llm.bpe import PieceIds, ragged, text_runs

MAGIC = b"TMID1\0"
VERSION = 3
HEADER, ENTRY, TOTALS = struct.Struct("<6sB"), struct.Struct("<BIII"), struct.Struct("<BQQ")
END_CHUNK, DOCUMENTS, IDS, PRIOR = 0, 1, 2, 3
BLOCK = 8192
#: Most blocks coded in step; numpy's cost for a call is shared by so many ids.
LANES = 1152
#: Ids of a section, but for the last of a file, which has from half to one and a
#: half of it (or all of a small file).
SECTION = 768 * BLOCK
#: Bytes of text for which a file of its own is worth while.
FILE_BYTES = 64 << 20
#: Numbers of ids, powers of two, after which a block's own frequencies are counted anew.
UPDATES = (128, 512, 2048)
#: Steps for which a batch looks its ids up at a time, and those it codes at a time.
STEPS, RUN = 512, 32
#: Lanes whose predictions are found at a time.
GROUP = 8
#: Distinct ids of a section; its frequencies add up to 2**PRIOR_BITS, each at least 1.
PRIOR_BITS = 16
DISTINCT = 1 << PRIOR_BITS
#: Bits of the tables of predictions (order 2 and order 1).
_TABLE = 11
#: Three cumulative probabilities, of 2**12, lie in the 16-bit fields of a word.
_KIND_BITS, _RATE = np.uint64(12), np.uint64(5)
_EVEN = np.uint64(1024 | 2048 << 16 | 3072 << 32)
_DECAY = np.uint64(0x007F007F007F)
#: A 32nd of where a symbol draws the fields: up those after it, down those before.
#: Targets of neighbouring fields differ by 1, which leaves every symbol some share.
_TARGET = np.array([123 | 124 << 16 | 125 << 32, 1 | 124 << 16 | 125 << 32, 1 | 2 << 16 | 125 << 32, 1 | 2 << 16 | 3 << 32], np.uint64)
_CUMULATIVE, _WHOLE = np.uint64(0x0FFF0FFF0FFF), np.uint64(4096 << 48)
_FIELD, _FOUR, _SIXTEEN, _MOVED = (np.uint64(x) for x in (0xFFFF, 4, 16, 32))
_LEAST = np.uint64(1 << 32)
#: Numbers of the tables' own width: a step of confidence, the most, and a shift.
_SURER, _MOST, _FOUR_DOWN = np.int32(1), np.int32(15), np.int32(4)
_BYTE_ONE, _FIVE = np.uint8(1), np.uint64(5)
#: Steps between changes of the weights, which add up to 16, and how the past fades.
_WEIGH, _FADE = 8, np.float32(0.875)
#: An entry of a frequency table: symbol, start and size in one number.
_PART, _SYMBOL, _MASK = np.uint64(17), np.uint64(34), np.uint64((1 << 17) - 1)


class Corrupt(ValueError):
    """A file whose header, length or checksum is not right."""


class Prior:
    """Frequencies of a section's distinct ids; ids are coded by their place here."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.counts = ids.astype(np.int64), counts.astype(np.int64)
        if len(ids) > DISTINCT:
            raise ValueError(f"more than {DISTINCT} distinct ids in a section")
        whole = self.counts if len(ids) else np.ones(1, np.int64)
        shares = np.cumsum(whole) * (DISTINCT - len(whole)) // int(whole.sum())
        self.size = 1 + np.diff(shares, prepend=0)
        self.start = np.cumsum(self.size) - self.size
        self.packed = (self.start << 16 | self.size - 1).astype(np.uint32)
        self.share = self.size.astype(np.float32) / np.float32(DISTINCT)

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        return cls(*_distinct(ids))

    def places(self, ids: np.ndarray) -> np.ndarray:
        if len(self.ids) and int(self.ids[-1]) < 1 << 22:
            table = np.zeros(int(self.ids[-1]) + 1, np.uint16)
            table[self.ids] = np.arange(len(self.ids))
            return table[ids]
        return np.searchsorted(self.ids, ids).astype(np.uint16)

    def entries(self) -> np.ndarray:
        """The entry of every frequency slot."""
        return np.repeat(_entry(np.arange(len(self.size)), self.start, self.size), self.size)

    def pack(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=0).astype("<u4").tobytes() + self.counts.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, n: int, payload: bytes) -> Prior:
        raw = zlib.decompress(payload)
        return cls(np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<u4", n, 4 * n))


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, with their counts."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(ids, return_counts=True)


def sections(ids: np.ndarray) -> Iterator[tuple[np.ndarray, Prior]]:
    """Runs of ids with at most DISTINCT distinct ones, halved until they are."""
    found = _distinct(ids)
    if len(found[0]) <= DISTINCT:
        yield ids, Prior(*found)
        return
    middle = len(ids) // 2
    yield from sections(ids[:middle])
    yield from sections(ids[middle:])


def _entry(symbol: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (symbol.astype(np.uint64) << _PART | start.astype(np.uint64)) << _PART | size.astype(np.uint64)


class _History:
    """The frequencies of the first ids of every lane: runs of equal ids in order."""

    def __init__(self, columns: np.ndarray) -> None:
        lanes, self.n = columns.shape
        ranked = np.sort(columns, axis=1, kind="stable").ravel()
        head = np.empty(len(ranked), bool)
        head[0] = True
        np.not_equal(ranked[1:], ranked[:-1], out=head[1:])
        head[:: self.n] = True
        heads = np.flatnonzero(head)
        self.sizes = np.diff(np.append(heads, len(ranked)))
        self.lanes = heads // self.n
        self.starts = heads - self.lanes * self.n
        self.symbols = ranked[heads].astype(np.int64)

    def find(self, columns: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of each id in its lane's history; size 0 if it is not there.

        Some lanes at a time are looked up in a table of all symbols."""
        starts, sizes = np.append(self.starts, 0).astype(np.uint16), np.append(self.sizes, 0).astype(np.uint16)
        start, size = np.empty(columns.shape, np.uint16), np.empty(columns.shape, np.uint16)
        group = max(1, (1 << 19) // symbols)
        table = np.full(group * symbols, -1, np.int32)
        cuts = np.searchsorted(self.lanes, np.arange(0, len(columns) + group, group))
        for i, a in enumerate(range(0, len(columns), group)):
            runs = np.arange(cuts[i], cuts[i + 1])
            at = (self.lanes[runs] - a) * symbols + self.symbols[runs]
            table[at] = runs.astype(np.int32)
            part = columns[a : a + group]
            found = table.take(np.arange(len(part))[:, None] * symbols + part)
            start[a : a + group], size[a : a + group] = starts.take(found), sizes.take(found)
            table[at] = -1
        return start, size

    def entries(self) -> np.ndarray:
        return np.repeat(_entry(self.symbols, self.starts, self.sizes), self.sizes)


class _Models:
    """The probabilities of kinds under three contexts, for all lanes, and their weights."""

    def __init__(self, lanes: int) -> None:
        self.rows = (np.arange(3) * lanes)[:, None] + np.arange(lanes) << 4
        self.shares = np.full(3 * lanes << 4, _EVEN, np.uint64)
        self.credit = np.full((3, lanes), 1, np.float32)
        self.weights = np.repeat(np.array([[6], [5], [5]], np.uint64), lanes, axis=1)
        self.last = np.zeros(lanes, np.int64)
        self.steps = 0
        self.held, self.part = np.empty((2, 3, lanes), np.uint64)
        self.target = np.empty(lanes, np.uint64)

    def mix(self, places: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Start and size of each kind (a field of 16 bits) for the next id of every lane,
        where ``places`` has those of the first two contexts."""
        np.add(self.rows[2], self.last, out=places[2])
        self.shares.take(places, out=self.held, mode="clip")
        part = np.multiply(self.held, self.weights, out=self.part)
        np.add(part[0], part[1], out=start)
        start += part[2]
        start >>= _FOUR
        start &= _CUMULATIVE
        np.bitwise_or(start, _WHOLE, out=size)
        start <<= _SIXTEEN
        size -= start

    def learn(self, places: np.ndarray, kind: np.ndarray) -> None:
        """Take in the kinds of all lanes' ids (0 order 2, 1 order 1, 2 the block's
        frequencies, 3 the prior)."""
        held, part = self.held, self.part
        if self.steps % _WEIGH == 0:
            self.weigh(kind)
        self.steps += 1
        np.right_shift(held, _RATE, out=part)
        part &= _DECAY
        held -= part
        held += _TARGET.take(kind, out=self.target, mode="clip")
        self.shares[places] = held
        last = self.last
        last <<= 2
        last |= kind
        last &= 15

    def weigh(self, kind: np.ndarray) -> None:
        """Weigh the contexts by how probable they held the kinds."""
        given = ((self.held | _WHOLE) - (self.held << _SIXTEEN)) >> (kind.astype(np.uint64) << _FOUR) & _FIELD
        self.credit = self.credit * _FADE + given.astype(np.float32) / np.float32(4096)
        cubes = self.credit * self.credit * self.credit
        parts = (cubes * (np.float32(16) / np.add.reduce(cubes))).astype(np.uint64)
        parts[0] = np.uint64(16) - parts[1] - parts[2]
        self.weights = parts


class _Tables:
    """Predictions of all lanes (order 2, order 1) with their confidence in the low four
    bits, as a decoder needs them: it has an id only after its step."""

    def __init__(self, lanes: int) -> None:
        self.rows = (np.arange(2) * lanes)[:, None] + np.arange(lanes) << _TABLE
        self.tables = np.full(2 * lanes << _TABLE, -16, np.int32)
        self.slot, self.before = np.zeros((2, lanes), np.int32), np.zeros(lanes, np.int32)
        self.at = np.empty((2, lanes), np.int64)
        self.entry, self.sure, self.part = np.empty((3, 2, lanes), np.int32)
        self.hit = np.empty((2, lanes), bool)

    def look(self, guess: np.ndarray) -> np.ndarray:
        """Predictions for the next id of every lane, and their confidence."""
        np.add(self.rows, self.slot, out=self.at)
        self.tables.take(self.at, out=self.entry, mode="clip")
        np.right_shift(self.entry, _FOUR_DOWN, out=guess)
        return np.bitwise_and(self.entry, _MOST, out=self.sure)

    def learn(self, ids: np.ndarray, guess: np.ndarray) -> None:
        entry, slot = self.sure, self.slot
        np.equal(guess, ids, out=self.hit)
        entry += _SURER
        np.minimum(entry, _MOST, out=entry)
        entry *= self.hit
        entry |= ids << _FOUR_DOWN
        self.tables[self.at] = entry
        np.multiply(self.before, np.int32(1009), out=slot[0])
        slot[0] += ids
        slot[1] = ids
        slot &= np.int32((1 << _TABLE) - 1)
        self.before = ids


def _predictions(columns: np.ndarray) -> np.ndarray:
    """What both tables hold before every id: (order, step, lane) confidence, and 16 where
    the id predicted is the id.

    An encoder knows all ids, so nothing is looked up step by step: a stable sort by slot
    lays what a slot predicts next to what came, and confidence is a run of hits.
    """
    lanes, n = columns.shape
    out = np.empty((2, n, lanes), np.uint8)
    for a in range(0, lanes, GROUP):
        part = columns[a : a + GROUP]
        slots = np.zeros((2, *part.shape), np.uint16)
        slots[:, :, 1:] = part[:, :-1]
        slots[0, :, 2:] += part[:, :-2] * np.uint16(1009)
        slots &= np.uint16((1 << _TABLE) - 1)
        order = np.argsort(slots, axis=2, kind="stable").reshape(-1, n)
        order += (np.arange(len(order)) * n)[:, None]
        order = order.ravel()
        slot, ids = slots.ravel().take(order), np.concatenate((part, part)).ravel().take(order)
        again = np.zeros(len(order), bool)
        np.equal(slot[1:], slot[:-1], out=again[1:])
        again[::n] = False
        hit = again.copy()
        hit[1:] &= ids[1:] == ids[:-1]
        at = np.arange(len(order), dtype=np.int32)
        run = at - np.maximum.accumulate(at * ~hit)
        found = hit.astype(np.uint8) << 4
        found[1:] |= np.minimum(run[:-1], 15).astype(np.uint8) * again[1:]
        met = np.empty(len(order), np.uint8)
        met[order] = found
        out[:, :, a : a + GROUP] = met.reshape(slots.shape).transpose(0, 2, 1)
    return out


def _choose(models: _Models, met: np.ndarray, own: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, size) for each step and lane: the kind of the id that takes the
    fewest bits, where the block's frequencies and the prior give the id the shares
    ``own`` and ``prior``, and the share of 2**12 which that kind has."""
    steps, lanes = own.shape
    places = np.empty((steps, 3, lanes), np.int64)
    np.add((met & 15).transpose(1, 0, 2), models.rows[:2], out=places[:, :2])
    chances = np.empty((steps, 4, lanes), np.float32)
    chances[:, :2] = (met >> 4).transpose(1, 0, 2)
    chances[:, 2], chances[:, 3] = own, prior
    kinds, (starts, sizes) = np.empty((steps, lanes), np.int64), np.empty((2, steps, lanes), np.uint64)
    fields = sizes.view(np.uint16).reshape(steps, lanes, 4).transpose(0, 2, 1)
    worth, best = np.empty((4, lanes), np.float32), np.empty(lanes, np.float32)
    # True is 1, so a kind comes from sums and products of comparisons.
    more, number = np.empty(lanes, bool), np.empty(lanes, np.uint8)
    one = more.view(np.uint8)
    second, first, by_own, by_prior = worth
    for place, chance, kind, start, size, field in zip(places, chances, kinds, starts, sizes, fields):
        models.mix(place, start, size)
        np.multiply(field, chance, out=worth)
        np.greater(by_prior, by_own, out=more)
        np.add(one, _BYTE_ONE, out=number)
        np.maximum(by_own, by_prior, out=best)
        np.less_equal(first, best, out=more)
        number *= one
        number += _BYTE_ONE
        np.maximum(best, first, out=best)
        np.less_equal(second, best, out=more)
        number *= one
        kind[:] = number
        models.learn(place, kind)
    shift = kinds.astype(np.uint64) << _FOUR
    return kinds, starts >> shift & _FIELD, sizes >> shift & _FIELD


class _Writer:
    """Range coders of all lanes.  A width is 2**32 or more before each id, enough for
    its kind (12 bits) and what follows (16)."""

    def __init__(self, lanes: int) -> None:
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.steps = 0
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.carried: list[tuple[int, np.ndarray]] = []

    def put(self, start: np.ndarray, size: np.ndarray, then: np.ndarray, then_bits: np.ndarray) -> None:
        """For every step and lane a share of 2**12 and then one of 2**then_bits: ``then``
        is the start and the size less 1 of the latter."""
        steps, lanes = start.shape
        then_start, then_size = then >> _SIXTEEN, (then & _FIELD) + np.uint64(1)
        over, small = np.empty(start.shape, bool), np.empty(start.shape, bool)
        words = np.empty(start.shape, np.uint64)
        low, width, part = self.low, self.width, np.empty(lanes, np.uint64)
        for a, n, then_a, then_n, bits, carry, moves, word in zip(start, size, then_start, then_size, then_bits, over, small, words):
            width >>= _KIND_BITS
            np.multiply(a, width, out=part)
            width *= n
            width >>= bits
            then_a *= width
            part += then_a
            width *= then_n
            low += part
            np.less(low, part, out=carry)  # past 64 bits: one more for the word moved last
            np.less(width, _LEAST, out=moves)
            np.right_shift(low, _MOVED, out=word)
            np.copyto(part, moves)
            part <<= _FIVE
            low <<= part
            width <<= part
        for step in np.flatnonzero(over.any(axis=1)).tolist():
            self.carried.append((self.steps + step, over[step].nonzero()[0]))
        who, what = small.nonzero()[1].astype(np.uint16), words[small].astype(np.uint32)
        ends = np.cumsum(np.count_nonzero(small, axis=1)).tolist()
        for i, j in zip([0, *ends], ends):
            self.lanes.append(who[i:j])
            self.words.append(what[i:j])
        self.steps += steps

    def mark(self) -> tuple[int, int]:
        """Where the last lane stands: the steps made, and its low."""
        return self.steps, int(self.low[-1])

    def payloads(self, mark: tuple[int, int] | None = None) -> list[bytes]:
        """The bytes of every lane; of the last one, those up to the mark."""
        n, last = len(self.low), len(self.low) - 1
        lanes = np.concatenate(self.lanes) if self.lanes else np.empty(0, np.uint16)
        order = np.argsort(lanes, kind="stable")
        words = np.concatenate(self.words)[order].astype(np.int64) if self.words else np.empty(0, np.int64)
        ends = np.cumsum(np.bincount(lanes, minlength=n))
        stops, lows = ends.copy(), self.low.copy()
        carried = self.carried
        if mark is not None:
            steps, lows[-1] = mark
            after = sum(int((x == last).sum()) for x in self.lanes[steps:])
            stops[-1] -= after
            carried = [(t, x if t < steps else x[x != last]) for t, x in carried]
        if carried:
            # The word before a carry: the last of its lane that an earlier step moved.
            moved = np.cumsum([0, *map(len, self.lanes)]).tolist()
            keys = order + np.repeat(np.arange(n) << 32, np.diff(ends, prepend=0))
            at = np.searchsorted(keys, np.concatenate([(x << 32) + moved[t] for t, x in carried])) - 1
            np.add.at(words, at, 1)
            while len(over := np.flatnonzero(words >> 32)):
                words[over] &= 0xFFFFFFFF
                np.add.at(words, over - 1, 1)
        data, begins = words.astype("<u4"), np.concatenate(([0], ends[:-1]))
        # The number low itself lies in the last range: its bits end a payload.
        return [data[a:b].tobytes() + np.array([low >> 32, low & 0xFFFFFFFF], "<u4").tobytes() for a, b, low in zip(begins.tolist(), stops.tolist(), lows.tolist())]


class _Reader:
    def __init__(self, payloads: list[bytes]) -> None:
        sizes = np.array([len(p) // 4 for p in payloads])
        # Lanes end to end.  A lane that has run out, as only one that is done or not
        # right does, reads on in the next.
        self.data = np.concatenate([*(np.frombuffer(p, "<u4", n) for p, n in zip(payloads, sizes.tolist())), np.zeros(2, "<u4")]).astype(np.uint64)
        self.at = np.cumsum(sizes) - sizes + 2
        #: What the code is above low.
        self.ahead = self.data.take(self.at - 2) << _MOVED | self.data.take(self.at - 1)
        self.width = np.full(len(payloads), 2**64 - 1, np.uint64)

    def settle(self) -> None:
        small = (self.width < _LEAST).astype(np.uint64)
        shift = small << _FIVE
        self.width <<= shift
        self.ahead <<= shift
        words = self.data.take(self.at, mode="clip")
        words *= small
        self.ahead |= words
        self.at += small.view(np.int64)


def encode_blocks(ids: np.ndarray, prior: Prior, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """(ids, crc32, payload) of each block of an id array that the prior covers."""
    out: list[tuple[int, int, bytes]] = []
    cuts = range(0, len(ids), block)
    for i in range(0, len(cuts), LANES):
        some = [ids[a : a + block] for a in cuts[i : i + LANES]]
        # Only the last block can be shorter; its lane goes on, unread.
        longest, last = len(some[0]), len(some[-1])
        columns = np.zeros((len(some), longest), np.uint16)
        for lane, b in zip(columns, some):
            lane[: len(b)] = prior.places(b)
        models, writer = _Models(len(some)), _Writer(len(some))
        met = _predictions(columns)
        mark, t = None, 0
        for until in [*(u for u in UPDATES if u < longest), longest]:
            bits = np.array([0, 0, max(1, t).bit_length() - 1, PRIOR_BITS], np.uint64)
            history, scale = _History(columns[:, :t]) if t else None, np.float32(1 / max(1, t))
            for begin in range(t, until, STEPS):
                ahead = columns[:, begin : min(begin + STEPS, until)]
                part = np.ascontiguousarray(ahead.T)
                start, size = (x.T for x in history.find(ahead, len(prior.size))) if history else np.zeros((2, *part.shape), np.uint16)
                # A run ends where the last block does.
                cuts = sorted({*range(0, len(part), RUN), len(part), min(max(last - begin, 0), len(part))})
                for a, b in zip(cuts, cuts[1:]):
                    if t == last:
                        mark = writer.mark()
                    kind, *share = _choose(models, met[:, t : t + b - a], size[a:b] * scale, prior.share.take(part[a:b]))
                    # Start and size less 1 of every id under its frequencies.
                    own = (start[a:b].astype(np.uint32) << np.uint32(16)) + size[a:b] - np.uint32(1)
                    then = np.where(kind == 3, prior.packed.take(part[a:b]), own * (kind == 2)).astype(np.uint64)
                    writer.put(*share, then, bits.take(kind))
                    t += b - a
        for b, payload in zip(some, writer.payloads(mark)):
            out.append((len(b), zlib.crc32(b.astype("<u4").tobytes()), payload))
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]], prior: Prior) -> np.ndarray:
    """The ids of blocks laid end to end; a wrong checksum is :class:`Corrupt`."""
    parts: list[np.ndarray] = []
    # What follows a prediction: nothing, the whole of a range.
    slots = np.concatenate((np.ones(1, np.uint64), prior.entries()))
    names = prior.ids if len(prior.ids) else np.zeros(1, np.int64)
    for i in range(0, len(blocks), LANES):
        some = blocks[i : i + LANES]
        lanes = len(some)
        models, tables, reader = _Models(lanes), _Tables(lanes), _Reader([p for _, _, p in some])
        longest = max(n for n, _, _ in some)
        columns = np.zeros((longest, lanes), np.uint16)
        every, t = np.arange(lanes), 0
        fourth, places = 4 * every, np.empty((3, lanes), np.int64)
        # Start and size of each kind: a field each; a kind's number is how many starts after the first it reaches.
        start, size, part = np.empty((3, lanes), np.uint64)
        starts, sizes = start.view(np.uint16), size.view(np.uint16)
        fields = starts.reshape(lanes, 4).T[1:]
        bounds, reached = np.empty((3, lanes), np.uint64), np.empty((3, lanes), bool)
        by_first, by_second, by_third = reached.view(np.uint8)
        # The id by each kind.
        choice = np.empty((4, lanes), np.int32)
        guess = choice[:2]
        for until in [*(u for u in UPDATES if u < longest), longest]:
            # One table: the prior's slots, then those of every lane's history.
            entries = np.concatenate((slots, _History(columns[:t].T).entries())) if t else slots
            bits = np.array([0, 0, max(1, t).bit_length() - 1, PRIOR_BITS], np.uint64)
            most = (np.uint64(1) << bits) - np.uint64(1)
            base = np.zeros((4, lanes), np.int64)
            base[2], base[3] = len(slots) + every * t if t else 0, 1
            for t in range(t, until):
                np.add(models.rows[:2], tables.look(guess), out=places[:2])
                models.mix(places, start, size)
                ahead, unit = reader.ahead, reader.width
                unit >>= _KIND_BITS
                np.less_equal(np.multiply(fields, unit, out=bounds), ahead, out=reached)
                kind = (by_first + by_second + by_third).astype(np.int64)
                field, which = kind + fourth, kind * lanes
                which += every
                ahead -= np.multiply(starts.take(field), unit, out=part)
                unit *= sizes.take(field)
                unit >>= bits[kind]
                value = np.minimum(np.floor_divide(ahead, unit, out=part), most[kind], out=part).view(np.int64)
                value += base.take(which)
                entry = entries.take(value)
                np.right_shift(entry, _PART, out=part)
                part &= _MASK
                part *= unit
                ahead -= part
                unit *= np.bitwise_and(entry, _MASK, out=part)
                reader.settle()
                entry >>= _SYMBOL
                choice[2:] = entry
                found = choice.take(which)
                columns[t] = found
                models.learn(places, kind)
                tables.learn(found, guess)
            t = until
        for j, ((n, crc, _), lane) in enumerate(zip(some, np.ascontiguousarray(columns.T))):
            got = names[np.minimum(lane[:n], len(names) - 1)].astype("<u4")
            if zlib.crc32(got.tobytes()) != crc:
                raise Corrupt(f"block {i + j}: checksum")
            parts.append(got)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class IdFileWriter:
    """Writes documents' ids to a stream in the format above."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.documents, self.ids = out, 0, 0
        self.held: list[tuple[int | None, int]] = []
        self.parts: list[np.ndarray] = []
        self.size = 0
        out.write(HEADER.pack(MAGIC, VERSION))

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with their ids laid end to end."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 32:
            raise ValueError("an id is not an unsigned 32-bit number")
        self.held += zip(doc_ids, counts.tolist())
        self.parts.append(ids)
        self.size += len(ids)
        while 2 * self.size >= 3 * SECTION:
            # What is left for the end fills many lanes, too.
            self.flush(int(np.searchsorted(np.cumsum([n for _, n in self.held]), SECTION)) + 1)

    def chunk(self, kind: int, n: int, payload: bytes) -> None:
        self.out.write(ENTRY.pack(kind, n, len(payload), zlib.crc32(payload)) + payload)

    def flush(self, documents: int | None = None) -> None:
        """Write the first documents held (all, if None)."""
        now, self.held = self.held[:documents], self.held[len(self.held) if documents is None else documents :]
        if not now:
            return
        ids, size = np.concatenate(self.parts), sum(n for _, n in now)
        self.parts, ids = [ids[size:].copy()], ids[:size]
        names = np.array([0 if d is None else d for d, _ in now], "<i8")
        nulls = np.array([d is None for d, _ in now], "u1")
        self.chunk(DOCUMENTS, len(now), zlib.compress(names.tobytes() + nulls.tobytes() + np.array([n for _, n in now], "<i8").tobytes(), 1))
        for part, prior in sections(ids):
            self.chunk(PRIOR, len(prior.ids), prior.pack())
            for n, crc, payload in encode_blocks(part, prior):
                self.out.write(ENTRY.pack(IDS, n, len(payload), crc) + payload)
        self.documents, self.ids, self.size = self.documents + len(now), self.ids + size, self.size - size

    def finish(self) -> None:
        self.flush()
        self.out.write(TOTALS.pack(END_CHUNK, self.documents, self.ids))


def _exactly(stream: BinaryIO, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise Corrupt("the file ends too soon")
    return data


def read_ids(stream: BinaryIO) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, token ids) of a file in order, with all checks."""
    magic, version = HEADER.unpack(_exactly(stream, HEADER.size))
    if magic != MAGIC or version != VERSION:
        raise Corrupt("not a token id file")
    waiting: list[tuple[int | None, int]] = []
    next_, documents, ids = 0, 0, 0
    blocks: list[tuple[int, int, bytes]] = []
    prior: Prior | None = None
    rest = np.empty(0, np.uint32)
    while True:
        kind = _exactly(stream, 1)[0]
        if blocks and (kind != IDS or len(blocks) == LANES):
            if prior is None:
                raise Corrupt("a block without its prior")
            rest = np.concatenate((rest, decode_blocks(blocks, prior)))
            blocks, at = [], 0
            while next_ < len(waiting) and at + waiting[next_][1] <= len(rest):
                name, n = waiting[next_]
                yield name, rest[at : at + n]
                at, next_ = at + n, next_ + 1
            rest = rest[at:]
        if kind == END_CHUNK:
            if TOTALS.unpack(bytes([kind]) + _exactly(stream, TOTALS.size - 1))[1:] != (documents, ids) or next_ < len(waiting) or len(rest):
                raise Corrupt("totals do not agree")
            return
        _, count, size, crc = ENTRY.unpack(bytes([kind]) + _exactly(stream, ENTRY.size - 1))
        payload = _exactly(stream, size)
        if kind == IDS:
            blocks.append((count, crc, payload))
            ids += count
        elif kind not in (DOCUMENTS, PRIOR) or zlib.crc32(payload) != crc:
            raise Corrupt("unknown chunk or wrong checksum")
        elif kind == PRIOR:
            prior = Prior.unpack(count, payload)
        else:
            raw = zlib.decompress(payload)
            names, nulls, counts = np.frombuffer(raw, "<i8", count), np.frombuffer(raw, "u1", count, 8 * count), np.frombuffer(raw, "<i8", count, 9 * count)
            waiting = waiting[next_:] + [(None if z else x, n) for x, z, n in zip(names.tolist(), nulls.tolist(), counts.tolist())]
            next_, documents = 0, documents + count


class LibraryIds(PieceIds):
    """Ids from a tokenizers file: distinct pieces go through the library's model,
    texts with an added token of the file through the whole library."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # Byte-level alphabet: printable bytes stand for themselves, the others
        # for the characters from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(shown)]
        self.alphabet = np.arange(256, dtype="<u4")
        self.alphabet[others] = 256 + np.arange(len(others))

    def encode_raw(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = super().encode_raw(raw, offsets)
        held = self.with_added(raw.tobytes(), offsets)
        if not len(held):
            return ids, bounds
        parts, lengths, at = [], np.diff(bounds), 0
        for i in held.tolist():
            text = raw[offsets[i] : offsets[i + 1]].tobytes().decode()
            own = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            parts += [ids[at : bounds[i]], own]
            lengths[i], at = len(own), bounds[i + 1]
        return np.concatenate([*parts, ids[at:]]), np.concatenate(([0], np.cumsum(lengths)))

    def with_added(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold an added token, in order."""
        found: set[int] = set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                inside = at + len(token) <= offsets[i + 1]
                if inside:
                    found.add(i)
                # The rest of a text that is found needs no search.
                at = data.find(token, int(offsets[i + 1]) if inside else at + 1)
        return np.array(sorted(found), np.int64)

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - starts
        text = self.alphabet[raw[ragged(starts, lengths)]].tobytes().decode("utf-32-le")
        cuts = np.cumsum(lengths).tolist()
        pieces = [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]
        ids, counts = [], []
        for a in range(0, len(pieces), 4096):
            found = list(map(self.model.tokenize, pieces[a : a + 4096]))
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), np.int32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)


_LIBRARY: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryIds(path)
    return _LIBRARY[path]


def write_ids(docs: DataFrame, tokenizer_path: str, *, end: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end``, write the files; the manifest (file_no,
    path, n_docs, n_ids, n_bytes), files in ascending order of their documents.

    A null text is empty (only ``end``); null ids come first; rows that repeat an
    id stand side by side, ordered by a hash of the text; other columns are
    ignored; an empty table writes no file.  A file is named for its attempt and
    counts only through the manifest, so lost executors leave nothing that is read.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Fewer files than partitions where the texts are few, so that each fills its lanes.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(partitions(spark), max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, out = library_ids(tokenizer_path), None, None
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.ids"
        for batch in batches:
            for first, count, raw, offsets in text_runs(batch.column(1)):
                ids, bounds = coder.encode_raw(raw, offsets)
                counts = np.diff(bounds) + 1
                ends = np.cumsum(counts)
                every = np.full(int(ends[-1]), end, np.int32)
                inside = np.ones(len(every), bool)
                inside[ends - 1] = False
                every[inside] = ids
                if writer is None:
                    out = store.open_output_stream(f"{base}/{name}")
                    writer = IdFileWriter(out)
                writer.add(batch.column(0).slice(first, count).to_pylist(), every, counts)
        if writer is not None and out is not None:
            writer.finish()
            size = out.tell()
            out.close()
            coder.rest()
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([f"{folder}/{name}"], pa.string()), *(pa.array([x], pa.int64()) for x in (writer.documents, writer.ids, size))], names=["file_no", "path", "n_docs", "n_ids", "n_bytes"])

    return keep(map_arrow(ordered, run, "file_no long, path string, n_docs long, n_ids long, n_bytes long"), "id-manifest")


def document_digests(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with io.BufferedReader(store.open_input_stream(at), 1 << 20) as stream:
                    rows: list[tuple] = []
                    for name, ids in read_ids(stream):
                        rows.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return map_arrow(files.repartition(max(1, manifest.count())), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

"""Vectorised byte kernels shared by the text operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column: word
boundaries come from a 256-entry byte class table, and word and shingle hashes
from whole-array arithmetic, so no Python loop runs per word.  Batches are cut
into pieces of about ``PIECE`` bytes at document boundaries, which bounds the
scratch memory of a task by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
"""Target bytes per numpy pass; a single longer document is its own piece."""

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)

#: A-Z become a-z, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Boolean table over the 256 byte values, true inside any given range."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF)])
#: Everything but space and 0x09-0x0D.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, by exponent."""

    BASE = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=U64)

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.up):
            self.up, self.down = self.table(self.BASE), self.table(pow(self.BASE, -1, 1 << 64))
        return self.up, self.down

    @staticmethod
    def table(base: int) -> np.ndarray:
        out = np.empty(SPAN, dtype=U64)
        out[0], n = 1, 1
        with np.errstate(over="ignore"):
            while n < SPAN:  # the first n powers give the next n
                step = U64(pow(base, n, 1 << 64))
                out[n : 2 * n] = out[:n] * step
                n *= 2
        return out


#: Bytes hashed over one table of powers.
SPAN = 1 << 17
_POWERS = _Powers()
#: A 64-bit number for every byte.
_BYTES = mix((np.arange(256, dtype=U64) + U64(1)) * _GOLD)
#: Masks of a number's first 0 to 8 bytes, and odd factors of the two numbers.
_UPTO = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_FIRST, _SECOND = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents holding about ``size`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words and, per document, the
    index of its first word (one more entry than documents)."""
    inside = table[raw]
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    before[heads] = False
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:][offsets[1:] > 0]
    after[tails - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word.

    Up to 16 bytes are read as two numbers, multiplied and added; longer words hash
    by a polynomial in their bytes.  A word's hash hangs on its bytes alone.
    """
    if not len(starts):
        return np.empty(0, U64)
    lengths = ends - starts
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = LOWER[raw] if lower else raw
    # The eight bytes from every place on, as one number.
    eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = (eight[starts] & _UPTO.take(np.minimum(lengths, 8))) * _FIRST
        second = np.flatnonzero(lengths > 8)
        out[second] += (eight[starts[second] + 8] & _UPTO.take(np.minimum(lengths[second] - 8, 8))) * _SECOND
        long = np.flatnonzero(lengths > 16)
        if len(long):
            out[long] = _polynomials(padded, starts[long], ends[long])
        return mix(out + lengths.astype(U64) * _GOLD)


def _polynomials(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial in each word's bytes: running sums over the words laid end to end
    give every word's as a difference, brought down by the power of its own start."""
    lengths = ends - starts
    ends = np.cumsum(lengths)
    raw = raw[np.arange(int(ends[-1])) + np.repeat(starts - (ends - lengths), lengths)]
    starts = ends - lengths
    out = np.empty(len(starts), U64)
    up, down = _POWERS.get()
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            begin = int(starts[a])
            b = int(np.searchsorted(ends, begin + SPAN, side="right"))
            if b <= a:  # a word longer than the table, in parts
                out[a] = _long_hash(raw[begin : int(ends[a])])
                a += 1
                continue
            sums = np.zeros(int(ends[b - 1]) - begin + 1, U64)
            values = _BYTES[raw[begin : int(ends[b - 1])]]
            values *= up[: len(values)]
            np.cumsum(values, out=sums[1:])
            first = starts[a:b] - begin
            out[a:b] = (sums[ends[a:b] - begin] - sums[first]) * down[first]
            a = b
    return out


def _long_hash(word: np.ndarray) -> np.ndarray:
    """The polynomial of a word longer than the table of powers."""
    up, _ = _POWERS.get()
    total, scale = U64(0), 1
    step = pow(_Powers.BASE, SPAN, 1 << 64)
    for at in range(0, len(word), SPAN):
        values = _BYTES[word[at : at + SPAN]]
        total += (values * up[: len(values)]).sum(dtype=U64) * U64(scale)
        scale = scale * step % (1 << 64)
    return total


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes (len - k + 1 of them)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        weights = mix((np.arange(k, dtype=U64) + U64(1)) * _GOLD) | U64(1)
        out = np.full(m, U64(k) * _GOLD, U64)
        for i in range(k):
            out += hashes[i : i + m] * weights[i]
        return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one document; a shorter text is one shingle
    over all its words, and no words give the empty set."""
    n = len(hashes)
    if not n:
        return np.empty(0, U64)
    return np.unique(shingle_hashes(hashes, k)) if n >= k else shingle_hashes(hashes, n)

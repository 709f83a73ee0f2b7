"""Cutting text into the pieces that merges never cross, for whole batches.

This is the public split pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

stated over runs of one character class (letter, number, other, white space):

* a run of letters, numbers or others is a piece, with a single space before it;
* of white space before such a run, the last character stands apart (it is the
  space of the next piece, or a piece of its own), what precedes it is one piece;
* white space at the end of a text is one piece;
* a lone apostrophe that starts a piece takes the s, t, m, d, re, ve or ll after
  it, and the rest of those letters is another piece.

So the piece starts follow from class changes by array operations, and texts are
laid end to end: a text's first character always starts a piece.
"""

from __future__ import annotations

import numpy as np
import tiktoken

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of every code point, built once for each worker.

    The tokenizer libraries' own Unicode tables decide what is a letter, a number
    or white space: a one-class pattern keeps just those of all code points.
    """
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, _OTHER, np.uint8)
        # Surrogates never occur in text.
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([i]): i for i in range(256)}
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            found = bytes(only.encode_ordinary(every)).decode("utf-8")
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _CLASSES = table
    return _CLASSES


def _kinds(raw: np.ndarray) -> np.ndarray:
    """Class of every byte: that of its character."""
    classes = _classes()
    kinds = classes[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        first = raw[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first.astype(np.int32) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for i in (1, 2, 3):
            more = np.flatnonzero(size > i)
            code[more] = code[more] << 6 | raw[lead[more] + i] & 0x3F
        found = classes[code]
        kinds[lead] = found
        for i in (1, 2, 3):
            more = size > i
            kinds[lead[more] + i] = found[more]
    return kinds


def _contractions(raw: np.ndarray, kinds: np.ndarray, heads: np.ndarray, starts: np.ndarray) -> None:
    """Move piece starts where an apostrophe takes the letters after it."""
    n = len(raw)
    at = np.flatnonzero(raw == 39)
    at = at[at + 1 < n]
    at = at[starts[at] & (kinds[at + 1] == _LETTER) & ~heads[at + 1]]
    if not len(at):
        return
    one = raw[at + 1]
    where = np.minimum(at + 2, n - 1)
    two = np.where((at + 2 < n) & ~heads[where], raw[where], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    taken = np.where(single, 1, np.where(double, 2, 0))
    at, taken = at[taken > 0], taken[taken > 0]
    starts[at + 1] = False
    rest = at + 1 + taken
    rest = rest[rest < n]
    rest = rest[(kinds[rest] == _LETTER) & ~heads[rest]]
    starts[rest] = True


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start, over texts laid end to end.

    ``raw`` is UTF-8; ``offsets`` are the texts' bounds (one more than texts).  All is
    done on bytes: those of one character have its class, so no class changes within.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    kinds = _kinds(raw)
    heads = np.zeros(n, bool)
    heads[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts |= heads
    # A run after white space: the last white-space character starts a piece,
    # and the run itself does too unless that character is a plain space.
    after = np.flatnonzero(starts)
    after = after[(kinds[after] != _SPACE) & ~heads[after]]
    after = after[kinds[after - 1] == _SPACE]
    space = after - 1
    for _ in range(3):  # back to the first byte of that character
        inside = (raw[space] & 0xC0) == 0x80
        space = space - inside
    starts[space] = True
    starts[after[raw[space] == 32]] = False
    _contractions(raw, kinds, heads, starts)
    return np.flatnonzero(starts)

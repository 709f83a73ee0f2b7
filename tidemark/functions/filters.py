"""Filter policies: what a table stores to tell that it lacks a key.

A policy has a name, builds one filter of a list of keys, and answers whether a
filter may hold a key.  It may say yes in error, never no.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from tidemark.functions.codec import byte_hash

#: Seed of the filter's hash: a fixed value of the format.
SEED = 0xBC9F1D34
#: One filter for each 2**BASE_LG bytes of file offset.
BASE_LG = 11


class FilterPolicy(Protocol):
    name: str

    def create(self, keys: list[bytes]) -> bytes: ...

    def may_match(self, key: bytes, data: bytes) -> bool: ...


class BloomPolicy:
    """Bits set at double-hashed places, and the number of probes in a last byte.

    ``name`` is what a table's metaindex files the filters under; a reader uses
    only filters under its own policy's name.
    """

    def __init__(self, bits_per_key: int = 10, name: str = "tidemark.bloom") -> None:
        self.bits_per_key, self.name = bits_per_key, name
        self.probes = min(30, max(1, int(bits_per_key * 0.69)))

    def _places(self, key: bytes, bits: int, probes: int) -> Iterable[int]:
        """As in the column form: a step of 64 bits, without wrapping."""
        h = byte_hash(key, SEED)
        step = h >> 7 | h << 15
        return ((h + i * step) % bits for i in range(probes))

    def create(self, keys: list[bytes]) -> bytes:
        size = -(-max(64, len(keys) * self.bits_per_key) // 8)
        out = bytearray(size)
        for key in keys:
            for at in self._places(key, 8 * size, self.probes):
                out[at // 8] |= 1 << at % 8
        return bytes(out) + bytes([self.probes])

    def may_match(self, key: bytes, data: bytes) -> bool:
        if len(data) < 2:
            return False
        # Numbers of probes over 30 are kept for other encodings.
        return data[-1] > 30 or all(data[at // 8] >> at % 8 & 1 for at in self._places(key, 8 * (len(data) - 1), data[-1]))


class FilterBlockBuilder:
    """Filters of a table's data blocks: one for the keys of all blocks that start
    in the same 2 KiB of the file."""

    def __init__(self, policy: FilterPolicy) -> None:
        self.policy, self.keys, self.offsets, self.out = policy, [], [], bytearray()

    def start_block(self, offset: int) -> None:
        while offset >> BASE_LG > len(self.offsets):
            self._close()

    def add(self, key: bytes) -> None:
        self.keys.append(key)

    def _close(self) -> None:
        self.offsets.append(len(self.out))
        if self.keys:
            self.out += self.policy.create(self.keys)
            self.keys = []

    def finish(self) -> bytes:
        if self.keys:
            self._close()
        array = len(self.out)
        return bytes(self.out) + b"".join(x.to_bytes(4, "little") for x in (*self.offsets, array)) + bytes([BASE_LG])


class FilterBlock:
    """Reads a filter block; what it cannot read may match."""

    def __init__(self, policy: FilterPolicy, data: bytes) -> None:
        self.policy, self.data, self.number = policy, data, 0
        if len(data) < 5:
            return
        self.array, self.lg = int.from_bytes(data[-5:-1], "little"), data[-1]
        if self.array <= len(data) - 5:
            self.number = (len(data) - 5 - self.array) // 4

    def may_match(self, block_offset: int, key: bytes) -> bool:
        i = block_offset >> self.lg if self.number else 0
        if i >= self.number:
            return True
        at = self.array + 4 * i
        start, limit = (int.from_bytes(self.data[x : x + 4], "little") for x in (at, at + 4))
        if start == limit:
            return False
        return limit > self.array or start > limit or self.policy.may_match(key, self.data[start:limit])

"""Key and record codecs as column expressions (JVM-side) and as plain Python.

Keys order by unsigned bytes; strings in UTF-8 order alike.  Lengths and values
that pass 63 bits are decimals or Python integers, never wrapped longs.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SEQUENCE = (1 << 56) - 1
DELETION, VALUE = 0, 1


class Corruption(ValueError):
    """Bytes that are not what their format says."""


def varint_length(n: Column, most: int = 10) -> Column:
    """Bytes of a non-negative long as a base-128 varint; with ``most`` up to 18, of
    a decimal of no more bytes than that."""
    out = F.lit(most)
    for size in range(most - 1, 0, -1):
        # 9 bytes hold 63 bits: every non-negative long.
        top = (1 << 7 * size) - 1
        out = F.when(n <= F.lit(top if size < 10 else Decimal(top)), F.lit(size)).otherwise(out)
    return out.cast("long")


def put_varint(n: int) -> bytes:
    if not 0 <= n < 1 << 64:
        raise ValueError("a varint holds 0 to 2**64 - 1")
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, next position); truncation and more than ``bits`` bits are errors."""
    value, shift = 0, 0
    while True:
        if at >= len(data):
            raise Corruption("varint is cut short")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            if value >> bits:
                raise Corruption(f"varint has over {bits} bits")
            return value, at
        if shift >= 70 or shift >= bits + 7:
            raise Corruption(f"varint has over {bits} bits")


def put_slice(data: bytes) -> bytes:
    return put_varint(len(data)) + data


def get_slice(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = get_varint(data, at, 32)
    if at + n > len(data):
        raise Corruption("slice is cut short")
    return data[at : at + n], at + n


def pack_internal_key(user_key: bytes, seq: int, vtype: int) -> bytes:
    if not 0 <= seq <= MAX_SEQUENCE or vtype not in (DELETION, VALUE):
        raise ValueError("sequence or type out of range")
    return user_key + (seq << 8 | vtype).to_bytes(8, "little")


def parse_internal_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8:
        raise Corruption("internal key is under 8 bytes")
    tag = int.from_bytes(data[-8:], "little")
    if tag & 0xFF > VALUE:
        raise Corruption(f"value type {tag & 0xFF}")
    return data[:-8], tag >> 8, tag & 0xFF


def packed_tag(seq: Column, vtype: Column) -> Column:
    """seq << 8 | type; a decimal, as the product passes 63 bits."""
    return (seq.cast("decimal(20,0)") * F.lit(256) + vtype.cast("decimal(20,0)")).cast("decimal(20,0)")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings; 0 where either is null."""
    upto = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: (i > 0) & (F.left(a, i) == F.left(b, i)))
    return F.coalesce(F.size(upto), F.lit(0)).cast("long")


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short key in [start, limit): start cut after its first differing byte plus
    one where that stays below limit's byte, else start."""
    n = next((i for i, (x, y) in enumerate(zip(start, limit)) if x != y), None)
    if n is None or start[n] == 0xFF or start[n] + 1 >= limit[n]:
        return start
    return start[:n] + bytes([start[n] + 1])


def short_successor(key: bytes) -> bytes:
    """A short key >= key: its first byte below 0xff plus one, and nothing after."""
    n = next((i for i, x in enumerate(key) if x != 0xFF), None)
    return key if n is None else key[:n] + bytes([key[n] + 1])


def internal_separator(start: bytes, limit: bytes) -> bytes:
    """Separator of internal keys: re-tagged with the largest sequence if the user
    key became shorter and greater."""
    user, limit_user = start[:-8], limit[:-8]
    cut = shortest_separator(user, limit_user)
    return pack_internal_key(cut, MAX_SEQUENCE, VALUE) if len(cut) < len(user) and user < cut else start


def internal_successor(key: bytes) -> bytes:
    user = key[:-8]
    cut = short_successor(user)
    return pack_internal_key(cut, MAX_SEQUENCE, VALUE) if len(cut) < len(user) and user < cut else key


def separator_column(start: Column, limit: Column) -> Column:
    """:func:`shortest_separator` for ASCII strings, as an expression."""
    n = common_prefix(start, limit).cast("int")
    x, y = F.ascii(F.substring(start, n + 1, F.lit(1))), F.ascii(F.substring(limit, n + 1, F.lit(1)))
    bump = (n < F.least(F.length(start), F.length(limit))) & (x + 1 < y)
    return F.when(bump, F.concat(F.left(start, n), F.chr((x + 1).cast("long")))).otherwise(start)


def successor_column(key: Column) -> Column:
    """:func:`short_successor` for ASCII strings (no byte is 0xff)."""
    return F.when(F.length(key) > 0, F.chr((F.ascii(key) + 1).cast("long"))).otherwise(key)


_M, _SHIFT, _U32 = 0xC6A4A793, 24, 1 << 32


def byte_hash(data: bytes, seed: int) -> int:
    """The 32-bit multiplicative hash of bytes that filters use."""
    h = (seed ^ len(data) * _M) % _U32
    full = len(data) - len(data) % 4
    for i in range(0, full, 4):
        h = (h + int.from_bytes(data[i : i + 4], "little")) * _M % _U32
        h ^= h >> 16
    if len(data) % 4:
        h = (h + int.from_bytes(data[full:], "little")) * _M % _U32
        h ^= h >> _SHIFT
    return h


def _times_m(x: Column) -> Column:
    """x * M mod 2**32 without passing 63 bits: 16-bit halves of M."""
    low, high = x * F.lit(_M & 0xFFFF), (x * F.lit(_M >> 16)) % F.lit(1 << 16)
    return (low + high * F.lit(1 << 16)) % F.lit(_U32)


def byte_hash_column(key: Column, length: int, seed: int) -> Column:
    """:func:`byte_hash` of ASCII strings of one length, in long arithmetic."""

    def byte(i: int) -> Column:
        return F.ascii(F.substring(key, i + 1, 1)).cast("long")

    h = F.lit((seed ^ length * _M) % _U32)
    full = length - length % 4
    for i in range(0, full, 4):
        word = byte(i) + byte(i + 1) * 256 + byte(i + 2) * 65536 + byte(i + 3) * 16777216
        h = _times_m((h + word) % F.lit(_U32))
        h = h.bitwiseXOR(F.shiftright(h, 16))
    if length % 4:
        tail = F.lit(0).cast("long")
        for j in range(length % 4):
            tail = tail + byte(full + j) * (1 << (8 * j))
        h = _times_m((h + tail) % F.lit(_U32))
        h = h.bitwiseXOR(F.shiftright(h, _SHIFT))
    return h


_NUMBERED = re.compile(r"(\d+)\.(log|sst|ldb|dbtmp)")


def parse_file_name(name: str) -> tuple[str, int] | None:
    """(kind, number) of a store's file, None for any other name."""
    kinds = {"CURRENT": "current", "LOCK": "lock", "LOG": "info", "LOG.old": "info"}
    if name in kinds:
        return kinds[name], 0
    if m := re.fullmatch(r"MANIFEST-(\d+)", name):
        found = "manifest", int(m[1])
    elif m := _NUMBERED.fullmatch(name):
        found = {"log": "log", "dbtmp": "temp"}.get(m[2], "table"), int(m[1])
    else:
        return None
    return found if found[1] < 1 << 64 else None


def file_name_columns(name: Column) -> Column:
    """:func:`parse_file_name` as an expression: struct<kind, number>, null for any
    other name and for a number that passes 64 bits.  The number is a decimal."""
    digits = F.regexp_extract(name, r"^(?:MANIFEST-)?0*([0-9]+)(?:\.(?:log|sst|ldb|dbtmp))?$", 1)
    number = F.when(F.length(digits) <= 20, digits.cast("decimal(20,0)"))
    kind = (
        F.when(name.isin("CURRENT", "LOCK"), F.lower(name))
        .when(name.isin("LOG", "LOG.old"), "info")
        .when(name.rlike(r"^MANIFEST-[0-9]+$"), "manifest")
        .when(name.rlike(r"^[0-9]+\.log$"), "log")
        .when(name.rlike(r"^[0-9]+\.dbtmp$"), "temp")
        .when(name.rlike(r"^[0-9]+\.(sst|ldb)$"), "table")
    )
    zero = F.lit(0).cast("decimal(20,0)")
    fits = F.when(digits == "", zero).otherwise(number)
    return F.when(kind.isNotNull() & (fits <= F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")), F.struct(kind.alias("kind"), fits.alias("number")))


def file_name(kind: str, number: int = 0) -> str:
    shapes = {"log": "{:06d}.log", "table": "{:06d}.ldb", "old_table": "{:06d}.sst", "temp": "{:06d}.dbtmp", "manifest": "MANIFEST-{:06d}", "current": "CURRENT", "lock": "LOCK", "info": "LOG", "old_info": "LOG.old"}
    return shapes[kind].format(number)

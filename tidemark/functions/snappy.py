"""The Snappy framing format over Arrow's raw codec.

A stream is chunks of u8 type, u24 length and data: the stream identifier first,
then data chunks of at most 64 KiB uncompressed, each led by the masked CRC-32C of
its uncompressed bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.functions.codec import Corruption, get_varint

#: Fixed values of the format.
IDENTIFIER = b"\xff\x06\x00\x00sNaPpY"
COMPRESSED, UNCOMPRESSED, PADDING, STREAM = 0x00, 0x01, 0xFE, 0xFF
MOST = 1 << 16
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8


def _table() -> list[int]:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out.tolist()


_TABLE = _table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = _TABLE[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def compress(data: bytes) -> bytes:
    out, codec = bytearray(IDENTIFIER), pa.Codec("snappy")
    for at in range(0, len(data), MOST):
        part = data[at : at + MOST]
        packed = codec.compress(part, asbytes=True)
        kind, body = (COMPRESSED, packed) if len(packed) < len(part) - len(part) // 8 else (UNCOMPRESSED, part)
        out += bytes([kind]) + (len(body) + 4).to_bytes(3, "little") + masked(crc32c(part)).to_bytes(4, "little") + body
    return bytes(out)


def decompress(data: bytes) -> bytes:
    """The bytes of a framed stream; anything not in the format is Corruption."""
    if data[: len(IDENTIFIER)] != IDENTIFIER:
        raise Corruption("no snappy stream identifier")
    out, at, codec = bytearray(), len(IDENTIFIER), pa.Codec("snappy")
    while at < len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        if len(data) - at < 4 or len(body) != size:
            raise Corruption("snappy chunk is cut short")
        at += 4 + size
        if kind in (COMPRESSED, UNCOMPRESSED):
            if size < 4:
                raise Corruption("snappy chunk without a checksum")
            part = body[4:]
            if kind == COMPRESSED:
                length, _ = get_varint(part, 0, 32)
                if length > MOST:
                    raise Corruption("snappy chunk is too long")
                try:
                    part = codec.decompress(part, length, asbytes=True)
                except (pa.ArrowException, OSError, ValueError) as e:
                    raise Corruption(f"snappy: {e}") from e
            if masked(crc32c(part)) != int.from_bytes(body[:4], "little"):
                raise Corruption("snappy chunk checksum mismatch")
            out += part
        elif kind == STREAM:
            if body != IDENTIFIER[4:]:
                raise Corruption("bad snappy stream identifier")
        elif kind < 0x80:
            raise Corruption(f"snappy chunk type {kind}")
    return bytes(out)

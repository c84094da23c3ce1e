"""TFRecord files of tiles: framing with masked CRC-32C, and the few protocol buffer messages that a tile needs."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np


_POLYNOMIAL = 0x82F63B78  # Castagnoli's, reflected


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out


_CRC = _table()
_CRC_LIST = _CRC.tolist()
_LANES = 256


def _plain(data: bytes, crc: int) -> int:
    for b in data:
        crc = _CRC_LIST[(crc ^ b) & 255] ^ crc >> 8
    return crc


@lru_cache(256)
def _after(n: int) -> np.ndarray:
    """What n bytes of zeros make of each single bit of a checksum's register; the rest follows, as they act linearly."""
    if n == 0:
        return np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n % 2:
        x = _after(n - 1)
        return _CRC[x & 255] ^ x >> 8
    half = _after(n // 2)
    return np.array([_through(half, int(x)) for x in half], np.uint32)


def _through(bits: np.ndarray, crc: int) -> int:
    return int(np.bitwise_xor.reduce(bits[(crc >> np.arange(32)) & 1 == 1], initial=0))


def crc32c(data: bytes) -> int:
    """CRC-32C; long data in lanes that advance together, joined by how zeros move a register."""
    n = len(data) // _LANES
    if n < 16:
        return _plain(data, 0xFFFFFFFF) ^ 0xFFFFFFFF
    lanes = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * _LANES).reshape(_LANES, n).T)
    crc = np.zeros(_LANES, np.uint32)
    for column in lanes:
        crc = _CRC[(crc ^ column) & 255] ^ crc >> 8
    joined, move = 0xFFFFFFFF, _after(n)
    for lane in crc.tolist():
        joined = _through(move, joined) ^ lane
    return _plain(data[n * _LANES :], joined) ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        record = data[at + 12 : at + 12 + n]
        if struct.unpack_from("<I", data, at + 8)[0] != masked(data[at : at + 8]) or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(record):
            raise ValueError(f"a wrong checksum at byte {at}")
        yield record
        at += 16 + n


def varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def example(features: dict[str, bytes | int]) -> bytes:
    """Bytes become lists of bytes, integers packed lists of 64-bit integers, in the order given."""
    body = b""
    for name, value in features.items():
        feature = field(1, field(1, value)) if isinstance(value, bytes) else field(3, field(1, varint(value)))
        body += field(1, field(1, name.encode()) + field(2, feature))
    return field(1, body)


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a message: bytes, or a number."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 2:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"a field of wire type {tag & 7}")


def parse(data: bytes) -> dict[str, bytes | int]:
    """An example's features by name: the first of a list of bytes, or of 64-bit integers."""
    out: dict[str, bytes | int] = {}
    for _, features in fields(data):
        for _, entry in fields(features):
            pair = dict(fields(entry))
            for kind, values in fields(pair[2]):
                first = next(fields(values))[1]
                if kind == 3:  # integers, packed
                    first = first if isinstance(first, int) else next(fields(b"\x08" + first))[1]
                    first -= (first >> 63) << 64
                out[pair[1].decode()] = first
    return out


def tile_example(slide: str, jpeg: bytes, loc_x: int, loc_y: int) -> bytes:
    return example({"slide": slide.encode(), "image_raw": jpeg, "loc_x": loc_x, "loc_y": loc_y})

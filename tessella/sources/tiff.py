"""Pyramidal tiled TIFF (classic and Big) read by its tags, and a small writer of such files."""

from __future__ import annotations

import struct
from typing import BinaryIO

from tessella.errors import InvalidMetadata, UnsupportedFormat

# Fixed values of the format: tag numbers, and struct codes of its field types.
WIDTH, HEIGHT, COMPRESSION, PHOTOMETRIC, DESCRIPTION, TILE_W, TILE_H, OFFSETS, COUNTS, TABLES = 256, 257, 259, 262, 270, 322, 323, 324, 325, 347
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def directories(f: BinaryIO) -> list[dict[int, object]]:
    """The tags of every image of a file: numbers as tuples, text as str, bytes as bytes."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise UnsupportedFormat("not a TIFF file")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43):
        raise UnsupportedFormat("not a TIFF file")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    out, met = [], set()
    while at:
        if at in met:
            raise InvalidMetadata("image directories form a loop")
        met.add(at)
        f.seek(at)
        n = _unpack(f, order, "Q" if big else "H")[0]
        entries = [_unpack(f, order, "HHQ8s" if big else "HHI4s") for _ in range(n)]
        at = _unpack(f, order, "Q" if big else "I")[0]
        out.append({tag: _value(f, order, big, kind, count, raw) for tag, kind, count, raw in entries if kind in TYPES})
    return out


def _unpack(f: BinaryIO, order: str, kind: str) -> tuple:
    size = struct.calcsize(order + kind)
    data = f.read(size)
    if len(data) < size:
        raise InvalidMetadata("the file ends too early")
    return struct.unpack(order + kind, data)


def _value(f: BinaryIO, order: str, big: bool, kind: int, count: int, raw: bytes):
    code = TYPES[kind]
    size = count * struct.calcsize(order + code)
    if size > len(raw):
        f.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
        raw = f.read(size)
        if len(raw) < size:
            raise InvalidMetadata("the file ends too early")
    raw = raw[:size]
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind in (1, 7):
        return raw
    return struct.unpack(f"{order}{count * len(code)}{code[0]}", raw)


def write(path: str, images: list[dict]) -> None:
    with open(path, "wb") as f:
        f.write(dumps(images))


def dumps(images: list[dict]) -> bytes:
    """A classic little-endian file. An image: width, height, description, tile (w, h) or None, tiles (bytes each), tables, photometric."""
    body, at = bytearray(b"II*\0\0\0\0\0"), []
    for image in images:
        tags: list[tuple[int, int, int, bytes]] = []
        number = lambda tag, *v: tags.append((tag, 4, len(v), struct.pack(f"<{len(v)}I", *v)))  # noqa: E731, B023
        number(WIDTH, image["width"])
        number(HEIGHT, image["height"])
        tags.append((COMPRESSION, 3, 1, struct.pack("<HH", 7, 0)))
        tags.append((PHOTOMETRIC, 3, 1, struct.pack("<HH", image.get("photometric", 2), 0)))
        if image.get("description") is not None:
            text = image["description"].encode() + b"\0"
            tags.append((DESCRIPTION, 2, len(text), text))
        if image.get("tile"):
            number(TILE_W, image["tile"][0])
            number(TILE_H, image["tile"][1])
            offsets = []
            for tile in image["tiles"]:
                offsets.append(len(body))
                body += tile
            number(OFFSETS, *offsets)
            number(COUNTS, *image.get("counts", map(len, image["tiles"])))
            if image.get("tables"):
                tags.append((TABLES, 7, len(image["tables"]), image["tables"]))
        entries = b""
        for tag, kind, count, data in sorted(tags):
            if len(data) > 4:
                place = len(body)
                body += data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0")
        at.append((len(body), len(tags)))
        body += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    struct.pack_into("<I", body, 4, at[0][0])
    for (place, n), (following, _) in zip(at, at[1:], strict=False):
        struct.pack_into("<I", body, place + 2 + 12 * n, following)
    return bytes(body)

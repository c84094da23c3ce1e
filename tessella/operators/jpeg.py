"""Baseline JPEG in numpy. Colours are left as stored: whether they are YCbCr is the caller's to say."""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

from tessella.errors import UnsupportedFormat

# Fixed values of the standard: quantisation and Huffman tables of its annex K.
LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
CHROMA = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32)
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))


def zigzag() -> np.ndarray:
    """Places of the 64 coefficients in order of their diagonals, whose direction alternates."""
    return np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[sum(p) % 2 == 0 and 1 or 0]))])


ZIGZAG = zigzag()
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def code_of(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """A Huffman code of at most 16 bits a word (counts by length, symbols), whose word of ones alone stays unused."""
    while True:
        heap = [(w, i, (x,)) for i, (x, w) in enumerate(sorted(weights.items()))] + [(0, -1, (-1,))]
        heapq.heapify(heap)
        length = dict.fromkeys([*weights, -1], 0)
        while len(heap) > 1:
            (v, i, x), (w, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for symbol in x + y:
                length[symbol] += 1
            heapq.heappush(heap, (v + w, i + len(length), x + y))
        if max(length.values()) <= 16:
            break
        weights = {x: w**0.9 for x, w in weights.items()}  # flatter, until no word is too long
    deepest = max(length.values())
    order = sorted(weights, key=lambda x: (length[x], x))
    counts = [sum(length[x] == n for x in order) for n in range(1, 17)]
    assert length[-1] == deepest  # the least weight has one of the longest words, canonically the last
    return bytes(counts), bytes(order)


#: A code for AC symbols of any image: weights fall with the run of zeros and with the size of what ends it.
AC = code_of({0x00: 0.25, 0xF0: 0.002, **{run << 4 | size: 0.6 ** (run + 2.0 * (size - 1)) / 4 for run in range(16) for size in range(1, 11)}})


def words(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (length, code), canonically."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (length, code)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    quality = min(max(quality, 1), 100)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA))


def to_ycc(x: np.ndarray) -> np.ndarray:
    r, g, b = (x[..., i].astype(np.float64) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402], -1)


def to_rgb(x: np.ndarray) -> np.ndarray:
    y, cb, cr = (x[..., i].astype(np.float64) for i in range(3))
    out = np.stack([y + 1.402 * (cr - 128), y - 0.344136286 * (cb - 128) - 0.714136286 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def encode(pixels: np.ndarray, quality: int = 75, factors: tuple[int, int] = (2, 2), colour: bool = True, own_code: bool = False) -> bytes:
    """h x w (gray) or h x w x 3; factors: horizontal and vertical chroma subsampling; colour False: components as they are, factors (1, 1).

    own_code: Huffman codes made for this image, smaller; else those of all images, so that tiles can share a level's tables.
    """
    if pixels.shape[0] > 65535 or pixels.shape[1] > 65535 or not pixels.size:
        raise UnsupportedFormat(f"an image of {pixels.shape} can't be a JPEG")
    gray = pixels.ndim == 2 or pixels.shape[2] == 1
    planes = pixels.reshape(*pixels.shape[:2], -1).astype(np.float64) if gray or not colour else to_ycc(pixels)
    n = planes.shape[2]
    h, v = (1, 1) if gray or not colour else factors
    height, width = pixels.shape[:2]
    rows, cols = -(-height // (8 * v)), -(-width // (8 * h))
    tables = quantisers(quality)
    blocks = []
    for i in range(n):
        p = np.pad(planes[..., i], ((0, rows * 8 * v - height), (0, cols * 8 * h - width)), "edge")
        own = (h, v) if i == 0 else (1, 1)
        if i and (h, v) != (1, 1):
            p = p.reshape(p.shape[0] // v, v, p.shape[1] // h, h).mean((1, 3))
        q = tables[0 if i == 0 or not colour else 1].reshape(8, 8)
        b = p.reshape(rows, own[1], 8, cols, own[0], 8).transpose(0, 3, 1, 4, 2, 5) - 128
        c = np.rint(DCT @ b @ DCT.T / q).astype(np.int64).reshape(rows * cols, own[0] * own[1], 64)[..., ZIGZAG]
        blocks.append(c)
    tokens = _tokens(blocks)
    kinds = [0, *[int(colour)] * (n - 1)]  # which tables each component takes
    codes = {}
    for kind in sorted(set(kinds)):
        for ac in (0, 1):
            counts = np.bincount(tokens[0][(np.array(kinds)[tokens[3]] == kind) & (tokens[4] == ac)], minlength=256)
            fixed = AC if ac else (DC_COUNTS, DC_SYMBOLS)
            codes[kind, ac] = code_of({int(x): int(counts[x]) for x in np.flatnonzero(counts)} or {0: 1}) if own_code else fixed
    out = _packed(tokens, np.array(kinds), codes)
    part = lambda marker, data: struct.pack(">BBH", 255, marker, len(data) + 2) + data
    head = b"\xff\xd8" + b"".join(part(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables[: 1 if n == 1 else 2]))
    if not colour and n == 3:
        head += part(0xEE, b"Adobe\0d\0\0\0\0\0")
    head += part(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, (h << 4 | v) if i == 0 else 0x11, 0 if i == 0 or not colour else 1]) for i in range(n)))
    head += b"".join(part(0xC4, bytes([ac << 4 | kind]) + counts + symbols) for (kind, ac), (counts, symbols) in codes.items())
    return head + part(0xDA, bytes([n]) + b"".join(bytes([i + 1, 17 * k]) for i, k in enumerate(kinds)) + b"\0\x3f\0") + out + b"\xff\xd9"


def _tokens(blocks: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """What is coded, in order: symbol, extra bits, their number, component, and 0 for a DC or 1 for an AC symbol.

    blocks: for each component its coefficients in zigzag order, by unit and block of the unit.
    """
    sizes = [b.shape[1] for b in blocks]
    component = np.tile(np.repeat(np.arange(len(blocks)), sizes), blocks[0].shape[0])
    dc = [np.diff(b[..., 0].reshape(-1), prepend=0).reshape(b.shape[:2]) for b in blocks]
    first = np.concatenate(dc, 1).reshape(-1)
    c = np.concatenate(blocks, 1).reshape(-1, 64)
    at, place = np.nonzero(c[:, 1:])
    place += 1
    value = c[at, place]
    fresh = np.diff(at, prepend=-1) != 0
    run = place - np.where(fresh, 0, np.concatenate([[0], place[:-1]])) - 1
    size = lambda v: np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
    last = np.zeros(len(c), np.int64)
    last[at] = place  # the greatest comes last
    ends, long = np.flatnonzero(last < 63), np.repeat(np.arange(len(run)), run // 16)
    values = np.concatenate([first, value])
    bits = size(values)
    none = np.zeros(len(long) + len(ends), np.int64)
    symbol = np.concatenate([bits[: len(first)], (run % 16) << 4 | bits[len(first) :], np.full(len(long), 0xF0), np.zeros(len(ends), np.int64)])
    extra = np.concatenate([np.where(values >= 0, values, values + (1 << bits) - 1), none])
    owner = np.concatenate([np.arange(len(c)), at, at[long], ends])
    order = np.argsort(owner * 256 + np.concatenate([np.zeros(len(c), np.int64), place * 2 + 1, place[long] * 2, np.full(len(ends), 255)]), kind="stable")
    ac = np.arange(len(symbol)) >= len(c)
    return symbol[order], extra[order], np.concatenate([bits, none])[order], component[owner[order]], ac[order].astype(np.int64)


def _packed(tokens: tuple[np.ndarray, ...], kinds: np.ndarray, codes: dict[tuple[int, int], tuple[bytes, bytes]]) -> bytes:
    """The entropy-coded bytes, stuffed, filled up with ones."""
    symbol, extra, bits, component, ac = tokens
    length, code = np.zeros((2, 2, 256), np.int64), np.zeros((2, 2, 256), np.int64)
    for key, table in codes.items():
        for x, (n, word) in words(*table).items():
            length[key][x], code[key][x] = n, word
    kind = kinds[component]
    total = length[kind, ac, symbol] + bits
    word = code[kind, ac, symbol] << bits | extra
    left = np.repeat(np.cumsum(total), total) - 1 - np.arange(total.sum())
    stream = (np.repeat(word, total) >> left & 1).astype(np.uint8)
    stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])
    return np.packbits(stream).tobytes().replace(b"\xff", b"\xff\0")


def split_tables(data: bytes) -> tuple[bytes, bytes]:
    """A stream's quantisation and Huffman tables as a stream of their own, and the abbreviated rest."""
    tables, rest, at = b"\xff\xd8", b"\xff\xd8", 2
    while data[at + 1] != 0xDA:
        stop = at + 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] in (0xDB, 0xC4):
            tables += data[at:stop]
        else:
            rest += data[at:stop]
        at = stop
    return tables + b"\xff\xd9", rest + data[at:]


def join_tables(tables: bytes, tile: bytes) -> bytes:
    """A whole stream from a level's tables and a tile's abbreviated one."""
    if len(tables) < 2 or tables[-2:] != b"\xff\xd9":
        raise UnsupportedFormat("JPEG tables that don't end")
    return tables[:-2] + tile[2:]


def decode(data: bytes, colour: bool = False) -> np.ndarray:
    """h x w for one component, else h x w x n; colour True: YCbCr becomes RGB."""
    at, quant, codes, frame, interval, scan = 2, {}, {}, None, 0, None
    if data[:2] != b"\xff\xd8":
        raise UnsupportedFormat("not a JPEG stream")
    while scan is None:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 255:
            raise UnsupportedFormat("a JPEG stream that breaks off")
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            height, width, n = struct.unpack(">HHB", body[1:6])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise UnsupportedFormat("only baseline JPEG is understood")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if frame is None:
        raise UnsupportedFormat("a JPEG stream without a frame")
    high, tall = max(f[1] for f in frame), max(f[2] for f in frame)
    rows, cols = -(-height // (8 * tall)), -(-width // (8 * high))
    grids = [np.zeros((rows, cols, f[1] * f[2], 64)) for f in frame]
    pieces = _restarts(data[at:])
    if any(name not in scan or 0x00 | scan[name] >> 4 not in codes or 0x10 | scan[name] & 15 not in codes for name, *_ in frame):
        raise UnsupportedFormat("a component without a scan or its tables")
    plan = [(i, h * v, _lookup(codes[scan[name] >> 4]), _lookup(codes[16 | scan[name] & 15])) for i, (name, h, v, _) in enumerate(frame)]
    places, values = [[] for _ in frame], [[] for _ in frame]
    units, each = rows * cols, interval or rows * cols
    for piece, m0 in enumerate(range(0, units, each)):
        if piece >= len(pieces):
            raise UnsupportedFormat("data that ends too early")
        ahead, limit = _ahead(pieces[piece]), 8 * len(pieces[piece]) + 16
        pos, before = 0, [0] * len(frame)
        for m in range(m0, min(m0 + each, units)):
            for i, n_blocks, dc, ac in plan:
                put, got = places[i].append, values[i].append
                for k in range(m * n_blocks, (m + 1) * n_blocks):
                    k *= 64
                    j, table, stop = 0, dc, k + 64
                    while j < 64:
                        seen = ahead[pos >> 3]
                        found = table[seen >> 24 - (pos & 7) & 0xFFFF]
                        if found < 0:
                            raise UnsupportedFormat("a code that no table has")
                        size, run = found & 15, found >> 4 & 15
                        used = (pos & 7) + (found >> 8) + size
                        pos += (found >> 8) + size
                        value = seen >> 40 - used & (1 << size) - 1
                        if size and not value >> size - 1:
                            value -= (1 << size) - 1
                        if not j:
                            before[i] += value
                            put(k)
                            got(before[i])
                            table, j = ac, 1
                        elif size:
                            j += run
                            if k + j < stop:
                                put(k + j)
                                got(value)
                            j += 1
                        elif run == 15:
                            j += 16
                        else:
                            break
                    if pos > limit:
                        raise UnsupportedFormat("data that ends too early")
    for g, where, what in zip(grids, places, values, strict=True):
        g.reshape(-1)[where] = what
    planes = []
    for (_, h, v, q), g in zip(frame, grids, strict=True):
        c = np.empty_like(g)
        c[..., ZIGZAG] = g * quant[q]
        b = (DCT.T @ c.reshape(rows, cols, v, h, 8, 8) @ DCT) + 128
        p = np.clip(np.floor(b.transpose(0, 2, 4, 1, 3, 5).reshape(rows * v * 8, cols * h * 8) + 0.5), 0, 255)
        planes.append(p.repeat(tall // v, 0).repeat(high // h, 1)[:height, :width])
    out = np.stack(planes, -1).astype(np.uint8)
    return out[..., 0] if len(frame) == 1 else to_rgb(out) if colour and len(frame) == 3 else out


@lru_cache(64)
def _lookup(table: bytes) -> list[int]:
    """By the next 16 bits: length * 256 + symbol, -1 where no code begins so. A DC symbol is its size, at most 15."""
    out = np.full(1 << 16, -1, np.int64)
    for symbol, (length, code) in words(table[:16], table[16:]).items():
        out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return out.tolist()


def _ahead(piece: bytes) -> list[int]:
    """For each byte, the 40 bits that begin there; ones after the end, enough for a block of nothing but the longest words."""
    b = np.frombuffer(piece + b"\xff" * 300, np.uint8).astype(np.int64)
    return (b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]).tolist()


def _restarts(data: bytes) -> list[bytes]:
    """Entropy-coded data without stuffing, cut at restart markers, up to the end of the scan."""
    out, piece, at = [], bytearray(), 0
    while at < len(data):
        stop = data.find(b"\xff", at)
        if stop < 0 or stop + 1 >= len(data):
            piece += data[at:]
            break
        piece += data[at:stop]
        following = data[stop + 1]
        if following == 0:
            piece.append(255)
        elif 0xD0 <= following <= 0xD7:
            out.append(bytes(piece))
            piece = bytearray()
        elif following != 255:
            break
        at = stop + (1 if following == 255 else 2)
    return [*out, bytes(piece)]

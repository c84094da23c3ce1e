"""Texts as numpy arrays: UTF-8 bytes of many documents side by side, words, 64-bit hashes of words and word windows.

White space is [\\x20\\x09-\\x0D]; everything else belongs to words. Hashes are polynomials modulo 2^64 over a
table of random 64-bit values a byte, finished by a mixing function; equal strings have equal hashes, and two of n
different strings meet with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | U(1)
_P = U(0x9E3779B97F4A7C15 | 1)
_PINV = U(pow(int(_P), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        out = np.full(max(n, BLOCK), base, U)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[int(base)] = known = np.multiply.accumulate(out)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.copy()
    with np.errstate(over="ignore"):
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds about size bytes of texts or a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, in bytes; a text's end ends its last word."""
    n = len(data)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each of the disjoint ascending spans; an empty span has that of the empty string. which: 0 or 1, for two independent hashes."""
    out = np.zeros(len(starts), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
            n = int(ends[j - 1]) - base
            sums = np.zeros(n + 1, U)
            np.cumsum(_BYTES[which][data[base : base + n]] * powers(_P, n), out=sums[1:])
            a, b = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * powers(_PINV, n + 1)[a]
            i = j
        return mix(out + (ends - starts).astype(U) * U(0xD1342543DE82EF95))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words that begin at each word but the last n - 1."""
    if len(words) < n:
        return np.zeros(0, U)
    k, out = U(0xC2B2AE3D27D4EB4F | 1), np.zeros(len(words) - n + 1, U)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * k + words[i : len(words) - n + 1 + i]
        return mix(out + U(n) * U(0x9FB21C651E98DF25))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of words, their hashes, and n + 1 offsets of the documents' words."""
    data, offsets = utf8(column)
    starts, ends = spans(data, offsets)
    return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values within each of the segments between offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for counts[0] numbers, then starts[1] and so on."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def lower_ascii(column: pa.Array) -> pa.Array:
    """A-Z in lower case, all else as it is (pyarrow's own would change other letters too)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(data))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \n-split lines of every text (an empty text has one, empty), and n + 1 offsets of the documents' lines."""
    breaks = np.flatnonzero(data == 10)
    counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[:-1]] = False
    starts[inner], starts[bounds[:-1]] = breaks + 1, offsets[:-1]
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    ends[inner], ends[bounds[1:] - 1] = breaks, offsets[1:]
    return starts, ends, bounds

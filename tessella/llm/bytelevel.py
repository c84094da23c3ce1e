"""Byte-level BPE over whole batches of texts.

Texts are cut into pre-tokens by numpy operations over code points, and each different pre-token of a chunk is encoded
once, by any encoder of single pre-tokens: the priority-queue merger of bpe.py, the counter of token_counts.py or a library.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex

from tessella.llm import textnum
from tessella.llm.textnum import U

SPACES, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CHUNK = 1 << 21


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary: printable bytes for themselves, the rest in order from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def load(path: str) -> dict:
    """Vocabulary, merges and added tokens of a tokenizer file. Only plain byte-level BPE files are understood."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or any(odd):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    alphabet = byte_alphabet()
    vocab = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        a, b = (bytes(alphabet[c] for c in x) for x in (a, b))
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in spec.get("added_tokens") or []):
        raise ValueError(f"{path}: an added token of a kind that is not understood")
    return {"vocab": vocab, "merges": merges, "added": added}


@functools.lru_cache(4)
def classes(path: str) -> bytes:
    """The class of every code point as the library of the tokenizer file sees it, compressed.

    Two versions of Unicode, of the regex module and of Python, agree on nearly all; the library is asked for the others.
    """
    from tokenizers import Tokenizer

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACES, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    major = np.frombuffer("".join(unicodedata.category(c)[0] for c in every).encode("ascii"), np.uint8)
    older = np.where(major == ord("L"), LETTER, np.where(major == ord("N"), NUMBER, OTHER))
    known = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    doubtful = known[(older != table[known]) & (table[known] != SPACES)]
    asked = Tokenizer.from_file(path).pre_tokenizer
    for c in doubtful.tolist():  # after a letter and after a digit: a letter or digit goes on with its like
        cuts = {a for _, (a, _) in asked.pre_tokenize_str(f"a{chr(c)}1{chr(c)}")}
        table[c] = LETTER if 1 not in cuts else NUMBER if 2 not in cuts else OTHER
    return zlib.compress(table.tobytes())


def cut(points: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie side by side; ends: where each text ends.

    The rules: contractions ('s 't 're 've 'm 'll 'd), runs of letters, of numbers and of other characters, each with one
    blank before it; of white space before anything else, the last character stands alone unless it is that blank.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    space = kinds == SPACES
    fresh = np.zeros(n + 1, bool)
    fresh[0] = True
    fresh[ends] = True  # a text begins
    first = fresh[:n].copy()
    run = first.copy()
    run[1:] |= kinds[1:] != kinds[:-1]  # a run of one class begins
    follows = np.zeros(n, bool)
    follows[1:] = (points[:-1] == 0x20) & ~fresh[1:n]  # a blank of the same text lies before
    first |= run & space
    first |= run & ~space & ~follows
    last = space.copy()
    last[-1] = False
    last[:-1] &= ~space[1:] & ~fresh[1:n]  # the last white space before other text
    first |= last
    quote = np.flatnonzero(run & (points == 0x27) & ~follows & first)
    if len(quote):
        fill = np.concatenate([points, np.zeros(2, points.dtype)])
        stop = ends[np.searchsorted(ends, quote, "right")]
        a = np.where(quote + 1 < stop, fill[quote + 1], 0)
        b = np.where(quote + 2 < stop, fill[quote + 2], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l")))
        for hit, size in ((quote[one], 2), (quote[two], 3)):
            first[hit + 1] = False
            after = hit + size
            after = after[after < n]
            first[after] = True
            # white space that follows is cut by its own rules already; a blank there still joins what comes after it
    return np.flatnonzero(first)


class Batch:
    """Pre-tokens of texts side by side: codes of the different ones, and the pre-tokens of each text between bounds."""

    def __init__(self, texts: list[str], table: np.ndarray):
        self.text = "".join(texts)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        self.starts = cut(points, table[points], ends)
        self.stops = np.append(self.starts[1:], len(points))
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, ends)])
        with np.errstate(over="ignore"):
            values = textnum.mix(points.astype(U) + U(0x9E3779B97F4A7C15)) if len(points) else np.zeros(0, U)
            sums = np.zeros(len(points) + 1, U)
            np.cumsum(values * textnum.powers(textnum._P, len(points)), out=sums[1:])
            hashes = (sums[self.stops] - sums[self.starts]) * textnum.powers(textnum._PINV, len(points) + 1)[self.starts]
            hashes = textnum.mix(hashes + (self.stops - self.starts).astype(U))
        self.codes, different = pd.factorize(hashes)
        at = np.zeros(len(different), np.int64)
        at[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        self.different = [self.text[a:b] for a, b in zip(self.starts[at].tolist(), self.stops[at].tolist(), strict=True)]


class Known(dict):
    """What an encoder gave for the pre-tokens met so far; emptied when full, so that memory stays bounded."""

    def __init__(self, encode: Callable[[str], object], most: int = 300_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, key: str) -> object:
        if len(self) >= self.most:
            self.clear()
        out = self.encode(key)
        if len(key) <= 256:
            self[key] = out
        return out


def batches(texts: list[str | None], table: np.ndarray, added: dict[str, int], size: int = CHUNK) -> Iterator[tuple[Batch, list[tuple[int, int | None]]]]:
    """Batches of about size characters. Beside each, for its pieces: the text that a piece is of, and the id of the added token that follows it."""
    pattern = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
    pieces, marks, total = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        parts = pattern.split(text) if pattern and any(a in text for a in added) else [text]
        for k in range(0, len(parts), 2):
            pieces.append(parts[k])
            marks.append((i, added[parts[k + 1]] if k + 1 < len(parts) else None))
            total += len(parts[k])
        if total >= size:
            yield Batch(pieces, table), marks
            pieces, marks, total = [], [], 0
    if pieces:
        yield Batch(pieces, table), marks


def token_ids(texts: list[str | None], table: np.ndarray, added: dict[str, int], known: Known) -> Iterator[np.ndarray]:
    """The ids of each text, in order. known: from a pre-token to its ids."""
    for batch, marks in batches(texts, table, added):
        each = [known[x] for x in batch.different]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for x in each for i in x), np.int64, int(counts.sum()))
        begin = np.cumsum(counts) - counts
        sizes = counts[batch.codes] if len(batch.codes) else np.zeros(0, np.int64)
        ids = flat[textnum.ranges(begin[batch.codes], sizes)] if len(sizes) else flat
        bounds = np.concatenate([[0], np.cumsum(sizes)])[batch.bounds]
        k = 0
        while k < len(marks):
            j = k
            while j + 1 < len(marks) and marks[j + 1][0] == marks[k][0]:
                j += 1
            if j == k and marks[k][1] is None:
                yield ids[bounds[k] : bounds[k + 1]]
            else:
                yield np.concatenate([x for p in range(k, j + 1) for x in (ids[bounds[p] : bounds[p + 1]], np.array([marks[p][1]] if marks[p][1] is not None else [], np.int64))])
            k = j + 1

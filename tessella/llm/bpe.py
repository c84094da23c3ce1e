"""BPE encoding and decoding.

Encoding of a pre-token: a doubly linked list of symbols and a priority queue of (merge rank, position); an entry that
no longer describes its two symbols is stale and skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import bytelevel, textnum
from tessella.llm.cluster import lean, ship


class Merger:
    """Encodes single pre-tokens by the merges of a tokenizer file.

    A queue entry is one number, rank * 2^32 + position: the rank names the two symbols that it was made for.
    """

    def __init__(self, path: str):
        spec = bytelevel.load(path)
        self.vocab = spec["vocab"]
        self.symbols = [spec["vocab"][bytes([b])] for b in range(256)]
        self.entries = {a << 32 | b: rank << 32 for (a, b), (rank, _) in spec["merges"].items()}
        self.left, self.right, self.merged = ([x[k] for x in sorted((rank, a, b, m) for (a, b), (rank, m) in spec["merges"].items())] for k in (1, 2, 3))

    def __call__(self, text: str) -> list[int]:
        entries, left, right, merged = self.entries, self.left, self.right, self.merged
        symbols = self.symbols
        symbol = [symbols[b] for b in text.encode()]
        n = len(symbol)
        if n < 2:
            return symbol
        queue = []
        last = symbol[0]
        for i in range(1, n):
            s = symbol[i]
            if (e := entries.get(last << 32 | s)) is not None:
                queue.append(e + i - 1)
            last = s
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            e = pop(queue)
            rank, i = e >> 32, e & 0xFFFFFFFF
            j = after[i]
            if symbol[i] != left[rank] or j >= n or symbol[j] != right[rank]:
                continue  # stale
            symbol[i] = m = merged[rank]
            symbol[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (e := entries.get(m << 32 | symbol[k])) is not None:
                    push(queue, e + i)
            h = before[i]
            if h >= 0 and (e := entries.get(symbol[h] << 32 | m)) is not None:
                push(queue, e + h)
        return [s for s in symbol if s >= 0]


class Vocabulary:
    """Decodes by concatenating vocabulary strings; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, path: str):
        spec = bytelevel.load(path)
        strings = {i: s for s, i in spec["vocab"].items()} | {i: s.encode() for s, i in spec["added"].items()}
        size = max(strings) + 1
        each = [strings.get(i, b"") for i in range(size)]
        self.data = np.frombuffer(b"".join(each), np.uint8)
        self.counts = np.fromiter(map(len, each), np.int64, size)
        self.begin = np.cumsum(self.counts) - self.counts

    def __call__(self, ids: np.ndarray) -> str:
        return self.data[textnum.ranges(self.begin[ids], self.counts[ids])].tobytes().decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", keep_ids: bool = False, digests: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and ids (array) and decoded (text) where keep_ids is set.

    Whole texts, special strings inside them as the library's default has it (one id each). Null and empty texts have no
    tokens and decode to the empty text. Rows stay apart, repeated ones too; columns of docs with the names of results are
    replaced. An empty table gives an empty result; very long texts are encoded whole. No shuffle: a row's result depends on that row alone.
    """
    ship(docs.sparkSession)
    table = bytelevel.classes(tokenizer)
    new = [pa.field("n_tokens", pa.int64())] + [pa.field(c, pa.string()) for c in ("ids_sha256", "decoded_sha256") if digests] + ([pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] if keep_ids else [])
    kept = [c for c in docs.columns if c not in {f.name for f in new}]
    names = [c for c in kept if keep_ids or c != text]

    def run(parts):
        kinds = np.frombuffer(zlib.decompress(table), np.uint8)
        added, vocabulary = bytelevel.load(tokenizer)["added"], Vocabulary(tokenizer)
        known = bytelevel.Known(Merger(tokenizer))
        digits = np.array([str(i) for i in range(len(vocabulary.counts))], object)
        for part in textnum.slices(parts, text):
            counts, shas, decoded_shas, lists, decoded = [], [], [], [], []
            for ids in bytelevel.token_ids(part.column(text).to_pylist(), kinds, added, known):
                counts.append(len(ids))
                back = vocabulary(ids)
                if digests:
                    shas.append(hashlib.sha256(",".join(digits[ids].tolist()).encode()).hexdigest())
                    decoded_shas.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    lists.append(ids)
                    decoded.append(back)
            columns = [part.column(c) for c in names] + [pa.array(counts, pa.int64())] + ([pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())] if digests else [])
            if keep_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(f.name for f in new)])

    types = dict(zip(docs.columns, (f.dataType.simpleString() for f in docs.schema), strict=True))
    spark_types = {"n_tokens": "bigint", "ids": "array<int>"}
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + [f"{f.name} {spark_types.get(f.name, 'string')}" for f in new])
    return docs.select(*kept).mapInArrow(lean(run), schema)

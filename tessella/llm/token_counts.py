"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is put to the proof: decoded to text, cut into pre-tokens and merged, does it come out as
the one token it is? The strings that pass are the shortcut. A text's pre-tokens among them count one each, unmerged;
only the others are merged, once for each different one.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import bytelevel, textnum
from tessella.llm.bpe import Merger
from tessella.llm.cluster import lean, ship


@functools.lru_cache(4)
def proved(path: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token."""
    table, merger, out = np.frombuffer(zlib.decompress(bytelevel.classes(path)), np.uint8), Merger(path), set()
    for string, i in bytelevel.load(path)["vocab"].items():
        try:
            text = string.decode()
        except UnicodeDecodeError:
            continue  # a part of a character never is a pre-token
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(bytelevel.cut(points, table[points], np.array([len(points)]))) == 1 and merger(text) == [i]:
            out.add(text)
    return frozenset(out)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts count 0. Special strings inside texts count one each, the library's default. Columns of docs with
    the names of results are replaced; rows stay apart, repeated ones too. An empty table gives an empty result; very long
    texts are counted whole. No shuffle.
    """
    ship(docs.sparkSession)
    table, whole = bytelevel.classes(tokenizer), proved(tokenizer)
    shortcut = docs.sparkSession.sparkContext.broadcast(whole)  # bounded by the vocabulary
    new = ["n_bytes", "n_tokens", "over_limit"]
    names = [c for c in docs.columns if c not in (*new, text)]

    def run(parts):
        kinds, added = np.frombuffer(zlib.decompress(table), np.uint8), bytelevel.load(tokenizer)["added"]
        merger, single = Merger(tokenizer), shortcut.value
        merged = bytelevel.Known(lambda x: len(merger(x)))
        for part in textnum.slices(parts, text):
            texts = part.column(text).to_pylist()
            counts, at = np.zeros(len(texts), np.int64), 0
            for batch, marks in bytelevel.batches(texts, kinds, added):
                each = np.fromiter((1 if x in single else merged[x] for x in batch.different), np.int64, len(batch.different))
                sums = textnum.segment_sums(each[batch.codes] if len(batch.codes) else np.zeros(0, np.int64), batch.bounds)
                np.add.at(counts, [i for i, _ in marks], sums + np.array([m is not None for _, m in marks], np.int64))
            n_bytes = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], [*names, *new])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*names, text).mapInArrow(lean(run), ", ".join([f"`{c}` {types[c]}" for c in names] + ["n_bytes bigint, n_tokens bigint, over_limit boolean"]))

"""Line dedup: lines that several documents share stay in one of them only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textnum
from tessella.llm.cluster import lean, ship, skew_join, written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def keys(column: pa.Array, least: int) -> tuple[np.ndarray, ...]:
    """Starts, ends and bounds of lines, whether a line's key is long enough, and two 64-bit hashes of the keys (0 for others)."""
    data, offsets = textnum.utf8(column)
    begin, stop, bounds = textnum.lines(data, offsets)
    starts, ends = textnum.spans(data, offsets)  # the key goes from the line's first word to its last
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    told = np.flatnonzero(last > first)
    a, b = starts[first[told]], ends[last[told] - 1]
    fits = points[b] - points[a] >= least
    told, a, b = told[fits], a[fits], b[fits]
    ok, out = np.zeros(len(begin), bool), []
    ok[told] = True
    lower = _LOWER[data]
    for which in (0, 1):
        h = np.zeros(len(begin), np.int64)
        h[told] = textnum.span_hashes(lower, a, b, which).view(np.int64)
        out.append(h)
    return begin, stop, bounds, ok, *out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10, documents: int = 2) -> DataFrame:
    """docs with the text's remaining lines, n_lines (before) and n_dropped.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z in lower case. A key of at least
    least_chars code points found in at least `documents` different documents (values of the key column) loses its lines
    in all of them but the smallest; the others stay, joined by \\n. A null text counts as one empty line and becomes
    the empty text. A document with a null id isn't counted and loses nothing; rows with the same id are one document.
    Ties can't arise: ids are compared. Columns of docs named n_lines or n_dropped are replaced; others stay. An empty
    table gives an empty result. Very long texts are single slices of a batch and never cut.

    Exploded lines shrink to distinct (document, 128-bit hash) rows, written once; groups are aggregated before the
    shuffle, rows of the most frequent lines aren't shuffled to meet them, and a document's own dropped keys come back
    to it as one array.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    kind = docs.schema[key].dataType

    def hashed(parts):
        for part in textnum.slices(parts, text):
            *_, bounds, ok, high, low = keys(part.column(text), least_chars)
            owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            rows = np.unique(np.rec.fromarrays([owner[ok], high[ok], low[ok]], names="o,h,l"))
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(rows["o"])), pa.array(rows["h"]), pa.array(rows["l"])], [key, "high", "low"])

    lines = written(docs.select(key, text).where(F.col(key).isNotNull()).mapInArrow(lean(hashed), f"`{key}` {kind.simpleString()}, high bigint, low bigint"), "lines")
    groups, n = lines.groupBy("high", "low"), F.count(F.lit(1)).alias("_n")
    if documents == 2:  # two different ids differ in their least and greatest
        shared = groups.agg(F.min(key).alias("_first"), F.max(key).alias("_last"), n).where("_first != _last")
    else:
        several = lines.distinct().groupBy("high", "low").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= documents)
        shared = groups.agg(F.min(key).alias("_first"), n).join(several, ["high", "low"], "left_semi")
    shared = written(shared.select("high", "low", "_first", "_n"), "shared")
    gone = skew_join(lines, shared, ["high", "low"], "_n").where(F.col(key) != F.col("_first")).groupBy(key).agg(F.collect_set(F.struct("high", "low")).alias("_gone"))

    def reassembled(parts):
        for part in textnum.slices(parts, text):
            column = part.column(text)
            begin, stop, bounds, ok, high, low = keys(column, least_chars)
            data, offsets = textnum.utf8(column)
            raw, gone_of = data.tobytes(), part.column("_gone").to_pylist()
            texts, n_dropped = [], []
            for i, dropped in enumerate(gone_of):
                a, b = int(bounds[i]), int(bounds[i + 1])
                if not dropped:
                    texts.append(raw[offsets[i] : offsets[i + 1]].decode())
                    n_dropped.append(0)
                    continue
                dropped = {(x["high"], x["low"]) for x in dropped}
                stays = [not (good and pair in dropped) for good, pair in zip(ok[a:b].tolist(), zip(high[a:b].tolist(), low[a:b].tolist(), strict=True), strict=True)]
                spans = zip(begin[a:b].tolist(), stop[a:b].tolist(), stays, strict=True)
                texts.append(b"\n".join(raw[s:e] for s, e, stay in spans if stay).decode())
                n_dropped.append(b - a - sum(stays))
            columns = [pa.array(texts, pa.string()) if c == text else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    joined = docs.select(*names).join(gone, key, "left").select(*names, "_gone")
    return joined.mapInArrow(lean(reassembled), ", ".join([f"`{c}` {types[c]}" for c in names] + ["n_lines bigint, n_dropped bigint"]))

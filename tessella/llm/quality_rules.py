"""Quality rules on repetition: how many characters of a text lie in duplicated word n-grams and duplicated lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import textnum
from tessella.llm.cluster import lean, ship
from tessella.llm.textnum import U

#: For n words: the largest part of a text's word characters that may lie in n-grams found twice or more. Longer
#: n-grams repeat more rarely by chance, so less of them is suffered.
COVERAGE = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: The largest part that may lie in lines equal to an earlier one.
LINE_COVERAGE = 0.30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more among those of the same owner."""
    with np.errstate(over="ignore"):
        codes, different = pd.factorize(hashes + owner.astype(U) * U(0xA24BAED4963EE407))
    return np.bincount(codes, minlength=len(different))[codes] > 1 if len(codes) else np.zeros(0, bool)


def measure(column: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    data, offsets = textnum.utf8(column)
    starts, ends, hashes, bounds = textnum.words(column)[1:]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    out = {"n_words": np.diff(bounds), "word_chars": textnum.segment_sums(chars, bounds), "n_symbols": textnum.segment_sums(SYMBOLS[data], offsets)}
    for n in sorted({5, *lengths}):
        windows = textnum.window_hashes(hashes, n)
        inside = owner[: len(windows)] == owner[n - 1 :] if len(windows) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        at = at[repeated(windows[at], owner[at])]
        edges = np.bincount(at, minlength=len(hashes) + n + 1) - np.bincount(at + n, minlength=len(hashes) + n + 1)
        covered = np.cumsum(edges)[: len(hashes)] > 0
        if n == 5:
            out["n_repeat_words"] = textnum.segment_sums(covered, bounds)
        out[f"chars_in_{n}"] = textnum.segment_sums(chars * covered, bounds)
    begin, stop, line_bounds = textnum.lines(data, offsets)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    told = np.flatnonzero(last > first)
    line_owner = np.repeat(np.arange(len(line_bounds) - 1), np.diff(line_bounds))
    again = np.zeros(len(begin), bool)
    if len(told):
        with np.errstate(over="ignore"):
            codes, different = pd.factorize(textnum.span_hashes(data, begin, stop)[told] + line_owner[told].astype(U) * U(0xA24BAED4963EE407))
        earliest = np.empty(len(different), np.int64)
        earliest[codes[::-1]] = np.arange(len(codes))[::-1]
        again[told] = earliest[codes] != np.arange(len(codes))
    sums = np.concatenate([[0], np.cumsum(chars)])
    out["n_dup_lines"] = textnum.segment_sums(again, line_bounds)
    out["chars_in_lines"] = textnum.segment_sums((sums[last] - sums[first]) * again, line_bounds)
    return out


def repetition_rules(docs: DataFrame, text: str = "text", coverage: dict[int, float] | None = None, line_coverage: float = LINE_COVERAGE) -> DataFrame:
    """docs with the base counts, the covered characters, base_failed and kept.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: counts over the whole text; chars_in_<n>: characters of
    words inside n-grams found twice or more, first ones included; chars_in_lines: characters of words in lines equal to
    an earlier one. base_failed: n_words < 10, or 100 * n_repeat_words > 20 * n_words. kept: not base_failed, and no
    coverage over its threshold. Null and empty texts have no words, fail and are not kept. Repeated rows are judged
    alike; columns of docs with the names of results are replaced. An empty table gives an empty result; very long texts
    are judged whole. No shuffle: a row's verdict depends on that row alone.
    """
    ship(docs.sparkSession)
    coverage = dict(coverage or COVERAGE)
    counted = [*BASE, *(f"chars_in_{n}" for n in coverage), "chars_in_lines"]
    names = [c for c in docs.columns if c not in {*counted, "base_failed", "kept"}]

    def run(parts):
        for part in textnum.slices(parts, text):
            m = measure(part.column(text), tuple(coverage))
            failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            kept = ~failed & (m["chars_in_lines"] <= line_coverage * m["word_chars"])
            for n, most in coverage.items():
                kept &= m[f"chars_in_{n}"] <= most * m["word_chars"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(m[c].astype(np.int64)) for c in counted), pa.array(failed), pa.array(kept)], [*names, *counted, "base_failed", "kept"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*names).mapInArrow(lean(run), ", ".join([f"`{c}` {types[c]}" for c in names] + [f"{c} bigint" for c in counted] + ["base_failed boolean, kept boolean"]))

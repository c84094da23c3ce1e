"""URL filters: all glob rules at once by a bit-parallel wildcard automaton.

A rule is a glob over the canonical URL, ".host" NUL "path": * stands for any characters, every other byte for itself.
The rules' bytes are laid side by side over the bits of several 64-bit words. One step of Shift-And a byte, for all rules
and for all URLs of a batch: D = ((D << 1 | starts) & masks[byte]) | (D & loops), where loops are the bits a star may hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textnum
from tessella.llm.cluster import lean, ship
from tessella.llm.textnum import U


@dataclass(frozen=True)
class Rule:
    """A rule for a host with all its subdomains and for paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> bytes:
        return b"*." + self.host.encode() + b"\0" + self.path.encode() + b"*"


class Automaton:
    def __init__(self, globs: list[bytes]):
        at, starts, loops, finals, masks = 0, [], [], [], []
        for glob in globs:
            body = glob.split(b"*")
            state = at  # this bit: nothing of the rule read yet
            starts.append(state)
            if not body[0]:
                loops.append(state)
            bit = state
            for k, literal in enumerate(body):
                for byte in literal:
                    bit += 1
                    masks.append((bit, byte))
                if k and k < len(body) - 1 or k == len(body) - 1 and k and not literal:
                    loops.append(bit)
                elif k < len(body) - 1:
                    loops.append(bit)
            finals.append(bit)
            at = bit + 1
        self.words = max(1, -(-at // 64))
        self.start, self.loop, self.mask = self._pack(starts), self._pack(loops), np.zeros((256, self.words), U)
        for bit, byte in masks:
            self.mask[byte, bit >> 6] |= U(1 << (bit & 63))
        self.final_word = np.array([f >> 6 for f in finals], np.int64)
        self.final_bit = np.array([f & 63 for f in finals], U)

    def _pack(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, U)
        for b in bits:
            out[b >> 6] |= U(1 << (b & 63))
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each rule."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")  # texts still running are a prefix
        begin, lengths = offsets[:-1][order], lengths[order]
        state = np.tile(self.start, (len(order), 1))
        for i in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -i, "left"))
            d = state[:live]
            moved = d << U(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> U(63)
            state[:live] = (moved & self.mask[data[begin[:live] + i]]) | (d & self.loop)
        hit = (state[:, self.final_word] >> self.final_bit) & U(1) if len(order) else np.zeros((0, len(self.final_bit)), U)
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (after the first ://, up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the end); empty where the url is null or has no ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    df = df.withColumn("_rest", rest)
    host = F.translate(F.regexp_extract("_rest", "^([^/?#]*)", 1), upper, lower)
    return df.withColumns({"host": host, "path": F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)}).drop("_rest")


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null; of equally long ones the first) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's. Null urls and those without :// have
    empty host and path, which no rule with a host fits. NUL characters of a url can't stand for the separator: they are
    read as U+FFFD by the automaton. Columns of pages with the names of results are replaced. Repeated rows are
    judged alike, very long urls whole; an empty table gives an empty result. No shuffle.
    """
    ship(pages.sparkSession)
    new = ["host", "path", "rule", "verdict"]
    names = [c for c in pages.columns if c not in new]
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    ranked = [rules[i] for i in order]

    def run(parts):
        automaton = Automaton([r.glob for r in ranked])
        verdicts = np.array([r.verdict for r in ranked] + [otherwise], object)
        texts = np.array([r.name for r in ranked] + [None], object)
        for part in textnum.slices(parts, "_canonical"):
            hit = automaton.matches(*textnum.utf8(part.column("_canonical")))
            best = np.where(hit.any(1), hit.argmax(1) if len(ranked) else 0, len(ranked))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*names, "host", "path"]), pa.array(texts[best], pa.string()), pa.array(verdicts[best], pa.string())], [*names, *new])

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    clean = lambda c: F.translate(c, "\0", "�")
    canonical = F.concat(F.lit("."), clean("host"), F.lit("\0"), clean("path"))
    found = with_host_and_path(pages, url).withColumn("_canonical", canonical).select(*names, "host", "path", "_canonical")
    return found.mapInArrow(lean(run), ", ".join([f"`{c}` {types[c]}" for c in names] + [f"{c} string" for c in new]))

"""Language ID: one interpolated Kneser-Ney character model for each language.

The models' n-grams lie in sorted arrays of 64-bit hashes, a row of log probabilities for all languages beside each; an
n-gram that no language has backs off through its context's weights. A text gets the language of the lowest cross-entropy
a character; texts whose lowest one is beyond what calibration texts of that language show are rejected.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textnum
from tessella.llm.cluster import lean, ship
from tessella.llm.textnum import U

ORDER = 4
UND = "und"
_K = U(0xC2B2AE3D27D4EB4F | 1)


@functools.cache
def letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


def points(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters in lower case with one blank for what lies between them, order - 1 blanks before each text; offsets, and numbers of letters."""
    joined = np.frombuffer("".join(lower := [(t or "").lower() for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lower])])
    letter = letters()[joined] if len(joined) else np.zeros(0, bool)
    stays = letter.copy()
    stays[1:] |= letter[:-1]  # the first of other characters becomes the blank
    begins = offsets[:-1][np.diff(offsets) > 0]
    stays[begins] = letter[begins]
    counts = textnum.segment_sums(stays, offsets)
    bounds = np.concatenate([[0], np.cumsum(counts + order - 1)])
    out = np.full(bounds[-1], 0x20, np.uint32)
    out[textnum.ranges(bounds[:-1] + order - 1, counts)] = np.where(letter, joined, 0x20)[stays]
    return out, bounds, textnum.segment_sums(letter, offsets)


def grams(chars: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n characters that end at each character; the first n - 1 have those of a start."""
    out = np.zeros(len(chars), U)
    wide = np.concatenate([np.full(n - 1, 0x20, np.uint32), chars]) if n > 1 else chars
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _K + wide[i : i + len(chars)]
        return textnum.mix(out + U(n) * U(0x9FB21C651E98DF25))


@dataclass
class Models:
    """tables[n]: sorted hashes of n-grams and their log probabilities; contexts[n]: hashes of the n - 1 characters before and their log back-off weights."""

    languages: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    unknown: np.ndarray | None = None
    limits: np.ndarray | None = None

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a character) of every text under every language, and numbers of letters."""
        chars, bounds, n_letters = points(texts)
        keep = np.ones(len(chars), bool)
        keep[textnum.ranges(bounds[:-1], np.full(len(texts), ORDER - 1))] = False
        at, logs = np.flatnonzero(keep), np.zeros((len(chars), len(self.languages)), np.float32)
        for n in range(ORDER, 0, -1):
            known, values = self.tables[n]
            wanted = grams(chars, n)[at]
            where = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[where] == wanted
            logs[at[hit]] += values[where[hit]]
            at = at[~hit]
            if n > 1 and len(at):
                known, weights = self.contexts[n]
                wanted = grams(chars, n - 1)[at - 1]
                where = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[where] == wanted
                logs[at[hit]] += weights[where[hit]]
        logs[at] += self.unknown
        sizes = np.maximum(np.diff(bounds) - ORDER + 1, 1)
        sums = np.zeros((len(chars) + 1, len(self.languages)))
        np.cumsum(logs, axis=0, dtype=np.float64, out=sums[1:])
        return -(sums[bounds[1:]] - sums[bounds[:-1]]) / sizes[:, None], n_letters


def fit(texts: list[str], labels: list[str]) -> Models:
    """Models of the texts' languages (without limits)."""
    languages = sorted(set(labels))
    chars_of = [points([t for t, x in zip(texts, labels, strict=True) if x == lang]) for lang in languages]
    out, L = Models(languages), len(languages)
    seen: list[dict[int, tuple]] = []
    for chars, bounds, _ in chars_of:
        real = np.ones(len(chars), bool)
        real[textnum.ranges(bounds[:-1], np.full(len(bounds) - 1, ORDER - 1))] = False
        at, own = np.flatnonzero(real), {}
        full, first, counts = np.unique(grams(chars, ORDER)[at], return_index=True, return_counts=True)
        place = at[first]
        for n in range(ORDER, 0, -1):
            own[n] = (full, counts, grams(chars, n - 1)[place - 1] if n > 1 else np.zeros(len(place), U), grams(chars, n - 1)[place] if n > 1 else np.zeros(len(place), U))
            if n > 1:  # how many different characters precede the shorter one
                full, first, counts = np.unique(grams(chars, n - 1)[place], return_index=True, return_counts=True)
                place = place[first]
        seen.append(own)
    alphabet = max(len(np.unique(np.concatenate([own[1][0] for own in seen]))), 1) + 1
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, ORDER + 1):
        keys, first = np.unique(np.concatenate([own[n][0] for own in seen]), return_index=True)
        context = np.concatenate([own[n][2] for own in seen])[first]
        suffix = np.concatenate([own[n][3] for own in seen])[first]
        contexts = np.unique(context)
        of = np.searchsorted(contexts, context)
        probability, weights = np.zeros((len(keys), L)), np.ones((len(contexts), L))
        base = np.full((len(keys), L), 1 / alphabet) if lower is None else lower[1][np.searchsorted(lower[0], suffix)]
        for i, own in enumerate(seen):
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, own[n][0])] = own[n][1]
            ones, twos = (own[n][1] == 1).sum(), (own[n][1] == 2).sum()
            discount = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))
            total = np.bincount(of, count, len(contexts))
            kinds = np.bincount(of, count > 0, len(contexts))
            weights[:, i] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1)
            probability[:, i] = np.maximum(count - discount, 0) / np.maximum(total[of], 1) + weights[of, i] * base[:, i]
        lower = keys, probability
        out.tables[n] = keys, np.log(probability).astype(np.float32)
        out.contexts[n] = contexts, np.log(weights).astype(np.float32)
    out.unknown = (out.contexts[1][1][0] + np.log(1 / alphabet)).astype(np.float32)
    return out


def calibrate(models: Models, texts: list[str], rate: float = 0.001, slack: float = 1.25, least: int = 40) -> None:
    """Sets each language's limit: slack times the cross-entropy that a part `rate` of its calibration texts of `least` letters or more exceed."""
    entropies, n_letters = models.scores(texts)
    models.limits = np.full(len(models.languages), np.inf)
    best = entropies.argmin(1) if len(texts) else np.zeros(0, int)
    for i in range(len(models.languages)):
        own = entropies[(best == i) & (n_letters >= least), i]
        if len(own) >= 10:
            models.limits[i] = slack * np.quantile(own, 1 - rate)


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a document is kept from learning: crc32 of its id as text, modulo folds. False for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most_documents: int = 400, most_chars: int = 100_000) -> Models | None:
    """Models from a bounded sample: about most_documents texts of each language, of at most most_chars characters each.

    The sample takes each labelled text of the table with the same chance within its language, by a hash of its id; a
    fifth of it calibrates. None where no labelled text has a letter. The bound holds for any size of the table.
    """
    able = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (F.length(text) <= most_chars))
    counts = {r[lang]: r["n"] for r in able.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(min(1.0, most_documents / n)))])
    luck = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    rows = able.select(text, lang, luck.alias("_luck"), F.element_at(share, F.col(lang)).alias("_share")).where("_luck < _share").collect()
    rows = sorted((r for r in rows if any(c.isalpha() for c in r[text])), key=lambda r: (r["_luck"] / r["_share"], r[lang], r[text]))
    if not rows:
        return None
    fitted, kept = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 50], [r for i, r in enumerate(rows) if i % 5 == 0]
    models = fit([r[text] for r in fitted], [r[lang] for r in fitted])
    calibrate(models, [r[text] for r in kept])
    return models


def identify(docs: DataFrame, models: Models | None, text: str = "text", sharpness: float = 12.0) -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected.

    lang_pred: the language of the lowest length-normalised cross-entropy (ties: the first in order of names), und where
    the text is null or has no letter (score 0, rejected). score: the share of that language among all when each counts
    exp(-sharpness * cross-entropy). rejected: und, or a cross-entropy over the language's calibrated limit in a text of
    40 letters or more. Without models everything is und. Repeated rows are judged alike. Columns of docs with
    the names of results are replaced. An empty table gives an empty result; very long texts are read whole. No shuffle; lang, ids and sources are never looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    names = [c for c in docs.columns if c not in new]
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample

    def run(parts):
        models = shared.value
        for part in textnum.slices(parts, text, 1 << 20):
            n = part.num_rows
            if models is None:
                columns = [pa.array([UND] * n), pa.array(np.zeros(n)), pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool))]
            else:
                entropies, n_letters = models.scores(part.column(text).to_pylist())
                best = entropies.argmin(1)
                low = entropies[np.arange(n), best]
                score = 1 / np.exp(-sharpness * (entropies - low[:, None])).sum(1)
                none = n_letters == 0
                rejected = none | (low > models.limits[best]) & (n_letters >= 40)
                columns = [pa.array(np.where(none, UND, np.array(models.languages, object)[best]), pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(np.where(none, np.nan, low), from_pandas=True), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, *new])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*names).mapInArrow(lean(run), ", ".join([f"`{c}` {types[c]}" for c in names] + ["lang_pred string, score double, cross_entropy double, rejected boolean"]))

"""The pipeline as a whole against a plain version of each stage, the language models included."""

import zlib
from collections import Counter, defaultdict
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_joins import brute
from test_texts import fails, line_brute
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import language_id
from tessella.llm.queries import tokenizer

ORDER = 4


def letters_of(text):
    """Lower-case letters, one blank for what follows them up to the next letter."""
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


class PlainModels:
    """Interpolated Kneser-Ney by dictionaries, straight from its definition."""

    def __init__(self, texts, labels):
        self.languages, self.counts, self.totals, self.discounts = sorted(set(labels)), {}, {}, {}
        for lang in self.languages:
            padded = [" " * (ORDER - 1) + letters_of(t) for t, x in zip(texts, labels, strict=True) if x == lang]
            counts = Counter(t[i - ORDER + 1 : i + 1] for t in padded for i in range(ORDER - 1, len(t)))
            for n in range(ORDER, 0, -1):
                ones, twos = (sum(v == m for v in counts.values()) for m in (1, 2))
                totals = defaultdict(lambda: [0, 0])
                for gram, v in counts.items():
                    totals[gram[:-1]][0] += v
                    totals[gram[:-1]][1] += 1
                self.counts[lang, n], self.totals[lang, n] = counts, dict(totals)
                self.discounts[lang, n] = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))
                counts = Counter(gram[1:] for gram in counts)
        self.alphabet = len({g for lang in self.languages for g in self.counts[lang, 1]}) + 1
        self.probability = cache(self.probability)

    def probability(self, lang, gram):
        if not gram:
            return 1 / self.alphabet
        n = len(gram)
        lower, (total, kinds) = self.probability(lang, gram[1:]), self.totals[lang, n].get(gram[:-1], (0, 0))
        if not total:
            return lower
        d = self.discounts[lang, n]
        return max(self.counts[lang, n].get(gram, 0) - d, 0) / total + d * kinds / total * lower

    def entropies(self, text):
        padded = " " * (ORDER - 1) + letters_of(text)
        size = max(len(padded) - ORDER + 1, 1)
        return [-sum(log(self.probability(lang, padded[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(padded))) / size for lang in self.languages]


def recognised(docs, luck):
    """Documents that the calibrated models accept."""
    rows = sorted((d for d in docs if d["lang"] and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2 and any(c.isalpha() for c in d["text"])), key=lambda d: luck[d["doc_id"]])
    fitted = [d for i, d in enumerate(rows) if i % 5 or len(rows) < 50]
    models = PlainModels([d["text"] for d in fitted], [d["lang"] for d in fitted])
    n_letters = lambda d: sum(c.isalpha() for c in d["text"].lower())
    own = defaultdict(list)
    for d in rows[::5]:
        found = models.entropies(d["text"])
        if n_letters(d) >= 40:
            own[int(np.argmin(found))].append(min(found))
    limits = {i: 1.25 * np.quantile(x, 0.999) for i, x in own.items() if len(x) >= 10}
    out = []
    for d in docs:
        if n_letters(d):
            found = models.entropies(d["text"])
            if n_letters(d) < 40 or min(found) <= limits.get(int(np.argmin(found)), np.inf):
                out.append(d)
    return out


def planted(rows):
    """A document for each stage to catch, made from the sample's own."""
    whole = [r for r in rows if r["text"] and "\n" not in r["text"] and 80 <= len(r["text"].split()) <= 2000 and fails(r["text"])[-1]]
    near = whole[0]["text"].split()
    near[len(near) // 2] = "changedword"
    text = {
        2000001: " ".join(map(str, range(30))),
        2000002: whole[1]["text"],
        2000003: " ".join(near),
        2000004: " ".join(f"xq{chr(97 + i)}zjw vkk{chr(122 - i)}q" for i in range(26)),
        2000005: "one of these lines is said again and again\n" * 40,
    }
    return [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": len(t)} for i, t in text.items()]


def write(path, rows):
    path.mkdir()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist(rows, schema), path / "documents.parquet")
    return str(path)


def test_pipeline_by_brute_force(spark, odd, tmp_path):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows += planted(rows) + [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": None} for i, t in odd]
    sf_dir = write(tmp_path / "tables", rows)
    ids = spark.createDataFrame([(r["doc_id"],) for r in rows], "doc_id bigint")
    luck = {r[0]: r[1] for r in ids.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30))).collect()}

    clean = [r for r in rows if fails(r["text"])[-1]]
    known = recognised(clean, luck)
    texts = {i: t for i, (t, _, _) in line_brute([(r["doc_id"], r["text"]) for r in known]).items()}
    texts = {i: t for i, t in texts.items() if t.strip(" ")}
    alone = {i: texts[i] for i, (_, root) in brute(sorted(texts.items()), 5, 80).items() if root == i}
    for before, after, lost in ((rows, clean, 2000005), (clean, known, 2000001), (known, texts, 2000002), (texts, alone, 2000003)):
        there = [{x if isinstance(x, int) else x["doc_id"] for x in side} for side in (before, after)]
        assert lost in there[0] and lost not in there[1]

    library = Tokenizer.from_file(tokenizer())
    library.no_truncation()
    library.no_padding()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(alone)
    for i, text in alone.items():
        whole = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine, at = sorted(pieces[i], key=lambda r: r["piece"]), 0
        assert [r["piece"] for r in mine] == list(range(len(mine))) and all(r["length"] == 1024 for r in mine[1:])
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    for x in places.values():
        ends = [0, *(offset + length for offset, length in sorted(x))]
        assert [offset for offset, _ in sorted(x)] == ends[:-1] and ends[-1] <= 1024
    assert len(places) <= sum(length for x in places.values() for _, length in x) / 1024 * 1.02 + 2

    fitted = language_id.fit([r["text"] for r in clean[:60] if r["lang"]], [r["lang"] for r in clean[:60] if r["lang"]])
    plain = PlainModels([r["text"] for r in clean[:60] if r["lang"]], [r["lang"] for r in clean[:60] if r["lang"]])
    for r in clean[60:90]:
        assert np.allclose(fitted.scores([r["text"]])[0][0], plain.entropies(r["text"]), rtol=1e-4)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    made = corpus_pipeline.run(spark, write(tmp_path / "empty", []))
    assert made.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(made.columns)


def test_language_models_by_brute_force():
    rows = [r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist() if r["text"]]
    learned = [r for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    texts, labels = [r["text"] for r in learned], [r["lang"] for r in learned]
    models, plain = language_id.fit(texts, labels), PlainModels(texts, labels)
    asked = [r["text"] for r in rows] + ["", "1 2 3", "日本語", "É" * 50, "a", " ".join(texts)[:100_000] * 3]
    found, n_letters = models.scores(asked)
    assert list(models.languages) == plain.languages and found.shape == (len(asked), len(plain.languages))
    for text, mine, n in zip(asked, found, n_letters, strict=True):
        want = np.array(plain.entropies(text))
        assert n == sum(c.isalpha() for c in text.lower())
        if n:
            assert np.abs(mine - want).max() < 1e-4, text[:80]
            first, second = np.sort(want)[:2] if len(want) > 1 else (0, 1)
            assert second - first < 2e-4 or mine.argmin() == want.argmin()

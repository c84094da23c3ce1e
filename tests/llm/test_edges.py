"""Nulls, repeated rows, a very long text, clashing columns and empty tables, for every operator on documents or pages."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, jaccard_join, language_id, line_dedup, packing, quality_rules, token_counts, url_filter
from tessella.llm.queries import RULES, tokenizer

LONG = "\n".join(" ".join(f"word{(i * 7919 + j) % 9973}" for j in range(12)) for i in range(25_000))  # 2.6 MB
ROWS = [(1, LONG), (2, None), (3, ""), (4, "the same short row of a few words"), (4, "the same short row of a few words"), (None, "a row without an id")]
CLASH = "n_words n_repeat_words kept base_failed n_lines n_dropped n_tokens n_bytes over_limit ids_sha256 decoded_sha256 lang_pred score rejected cross_entropy n_shingles component_id piece start length sequence_id offset host path rule verdict".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(2)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert {k: len(v) for k, v in out.items()} == Counter(i for i, _ in ROWS)
    assert all(x == out[4][0] for x in out[4])
    return {k: v[0] for k, v in out.items()}


def test_quality_and_language(spark, docs):
    got = by_id(quality_rules.repetition_rules(docs))
    assert got[1]["n_words"] == 300_000 and got[2]["n_words"] == got[3]["n_words"] == 0 and got[2]["base_failed"] and not got[3]["kept"]
    assert quality_rules.repetition_rules(docs.limit(0)).count() == 0
    models = language_id.fit(["the words of one language", "les mots d'une autre langue"] * 5, ["en", "fr"] * 5)
    language_id.calibrate(models, ["the words of one language"] * 20)
    got = by_id(language_id.identify(docs, models))
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[4]["lang_pred"] == "en" and got[1]["lang_pred"] == "en"
    assert language_id.identify(docs.limit(0), models).count() == 0


def test_lines(spark, docs):
    got = by_id(line_dedup.dedup_lines(docs))
    assert got[1]["text"] == LONG and got[1]["n_lines"] == 25_000 and got[2]["text"] == got[3]["text"] == "" and got[2]["n_lines"] == 1
    assert got[None]["text"] == "a row without an id" and got[4]["n_dropped"] == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_tokens(spark, docs, whole):
    ids = whole.encode(LONG, add_special_tokens=False).ids
    got = by_id(bpe.encode_decode(docs, tokenizer()))
    assert got[1]["n_tokens"] == len(ids) and got[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest() and got[2]["n_tokens"] == 0 and got[3]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    counted = by_id(token_counts.count_tokens(docs, tokenizer()))
    assert counted[1]["n_tokens"] == len(ids) and counted[1]["over_limit"] and counted[2]["n_bytes"] == 0 and counted[None]["n_tokens"] == got[None]["n_tokens"]
    assert bpe.encode_decode(docs.limit(0), tokenizer()).count() == token_counts.count_tokens(docs.limit(0), tokenizer()).count() == 0
    packed = packing.pack(docs, tokenizer(), 1024, 2).collect()
    sums = Counter()
    for r in packed:
        sums[r["doc_id"]] += r["length"]
    assert sums == Counter({1: len(ids) + 1, 2: 1, 3: 1, 4: 2 * (got[4]["n_tokens"] + 1), None: got[None]["n_tokens"] + 1})
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), tokenizer(), 1024, 2).count() == 0


def test_joins_and_urls(spark, docs):
    got = by_id(jaccard_join.similar(docs, k=4, percent=85))
    words = LONG.split()
    assert got[1]["n_shingles"] == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)}) and got[1]["component_id"] == 1
    assert got[2]["n_shingles"] == got[3]["n_shingles"] == 0 and got[2]["component_id"] == 2 and got[None]["component_id"] is None
    assert jaccard_join.similar(docs.limit(0), k=4, percent=85).count() == 0
    pages = docs.withColumn("url", F.when(F.col("text").isNotNull(), F.concat(F.lit("http://A.example.COM/en/7/"), F.regexp_replace("text", r"\s", "_"))))
    got = by_id(url_filter.judge_urls(pages, RULES))
    assert got[1]["host"] == "a.example.com" and len(got[1]["path"]) == len(LONG) + 6 and got[1]["verdict"] == "allow" and got[1]["rule"] == "example.com/en/7"
    assert got[2]["host"] == got[2]["path"] == "" and got[2]["rule"] is None
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0

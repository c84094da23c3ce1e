import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import language_id, line_dedup, quality_rules, textnum

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string"


def fails(text):
    words = WORD.findall(text or "")
    chars = sum(map(len, words))
    covered = {}
    for n in {5, *quality_rules.COVERAGE}:
        counts = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = {j for i in range(len(words) - n + 1) if counts[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        covered[n] = len(hit), sum(len(words[j]) for j in hit)
    seen, n_dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        own = WORD.findall(line)
        if own:
            if line in seen:
                n_dup, dup_chars = n_dup + 1, dup_chars + sum(map(len, own))
            seen.add(line)
    base = len(words) < 10 or 100 * covered[5][0] > 20 * len(words)
    kept = not base and dup_chars <= quality_rules.LINE_COVERAGE * chars and all(covered[n][1] <= m * chars for n, m in quality_rules.COVERAGE.items())
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), n_dup, covered[5][0], base, kept


def test_quality_rules_by_brute_force(spark, sample, odd):
    rows = [(i, t) for i, t, _ in sample] + odd
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", kept string")
    got = {r["doc_id"]: r for r in quality_rules.repetition_rules(df).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == fails(text), i
    assert quality_rules.repetition_rules(df.limit(0)).count() == 0


def test_hashes_of_long_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3 * textnum.BLOCK + 5, dtype=np.uint8)
    starts, ends = np.array([0, 10, 2 * textnum.BLOCK]), np.array([10, 2 * textnum.BLOCK, len(data)])
    one = textnum.span_hashes(data, starts, ends)
    shifted = np.concatenate([data[:0], np.zeros(7, np.uint8), data])
    assert (one == textnum.span_hashes(shifted, starts + 7, ends + 7)).all() and len(set(one.tolist())) == 3


def line_brute(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    owners = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owners.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(owners.get(key(x), ())) >= 2 and min(owners[key(x)]) != i)]
        out[i] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


@pytest.mark.parametrize("documents", [2, 3])
def test_line_dedup_by_brute_force(spark, sample, odd, documents):
    rows = [(i, t) for i, t, _ in sample] + odd + [(2, "\tÉCOLE Line Over Ten \r\nshort\n"), (3, "École line over ten"), (5, "ÉCOLE line over ten\n\nÉCOLE line over ten")]
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", n_lines int")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df, documents=documents).collect()}
    assert len(got) == len(rows)
    if documents == 2:
        assert got == line_brute(rows)
    else:
        assert all(got[i][2] <= x[2] for i, x in line_brute(rows).items())
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_null_ids_and_repeated_rows(spark):
    rows = [(None, "a line of ten or more"), (4, "a line of ten or more"), (4, "a line of ten or more"), (9, "A LINE of ten or more\nb")]
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(0, rows[0][1]), (4, rows[1][1]), (4, rows[2][1]), (9, "b")]


def test_language_models(spark, sample, odd):
    import pyarrow.parquet as pq

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    docs = spark.createDataFrame(rows + [(*r, None) for r in odd], SCHEMA + ", lang string").withColumn("held_out", language_id.held_out())
    models = language_id.learn(docs.where("not held_out"))
    got = language_id.identify(docs, models).collect()
    scored = [(r["lang_pred"] == r["lang"]) for r in got if r["held_out"] and r["lang"] and any(c.isalpha() for c in r["text"])]
    assert len(scored) > 150 and np.mean(scored) > 0.98
    by = {r["doc_id"]: r for r in got}
    for i, text in odd:
        none = not any(c.isalpha() for c in text or "")
        assert (by[i]["lang_pred"] == "und") == none and 0 <= by[i]["score"] <= 1 and (not none or by[i]["rejected"])
    labelled = [r for r in got if r["lang"]]
    assert np.mean([r["rejected"] for r in labelled]) < 0.02
    assert language_id.identify(docs.limit(0), models).count() == 0
    assert language_id.learn(docs.where("lang is null")) is None
    assert {r["lang_pred"] for r in language_id.identify(docs.limit(5), None).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    models = language_id.fit(["abra cadabra", "abba"], ["x", "x"])
    table, logs = models.tables[1]
    assert abs(np.exp(logs).sum() + np.exp(models.unknown).sum() - 1) < 1e-5
    low, _ = models.scores(["abra"])
    high, _ = models.scores(["zzzz"])
    assert low[0, 0] < high[0, 0]


def test_kept_text_digest(spark):
    from tessella.llm import queries

    r = queries.op4_line_dedup(spark, "/root/testdata/sf0.001").where("n_dropped = 0").first()
    assert len(r["kept_sha256"]) == 64 and hashlib.sha256(b"").hexdigest() != r["kept_sha256"]

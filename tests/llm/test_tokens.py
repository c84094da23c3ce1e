import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import bpe, bytelevel, packing, token_counts
from tessella.llm.queries import tokenizer

PATH = tokenizer()
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def expected(library, sample, odd):
    rows = [(i, t) for i, t, _ in sample] + odd
    return rows, {i: e.ids for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)}


def test_random_texts_like_the_library(library):
    import random

    rng = random.Random(5)
    alphabet = ["a", "s", "t", "r", "e", "v", "l", "d", "m", "'", " ", " ", "  ", "\n", "\t", "1", "!", "é", "中", "²", "𝒳", "🙂", "<|endoftext|>", "́", "\x1c", "\x85", "_", "Ᲊ", "'ll", "'re", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    kinds, added = np.frombuffer(zlib.decompress(bytelevel.classes(PATH)), np.uint8), bytelevel.load(PATH)["added"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for encode in (bpe.Merger(PATH), packing.encoder(PATH)):
        got = list(bytelevel.token_ids(texts, kinds, added, bytelevel.Known(encode)))
        assert [x.tolist() for x in got] == want
    vocabulary = bpe.Vocabulary(PATH)
    assert [vocabulary(np.array(x, np.int64)) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_cache_forgets_and_goes_on():
    known = bytelevel.Known(bpe.Merger(PATH), most=2)
    assert [known[x] for x in ("ab", "cd", "ef", "ab")] == [bpe.Merger(PATH)(x) for x in ("ab", "cd", "ef", "ab")]
    assert len(known) <= 2


def test_encoding_and_decoding(spark, library, expected):
    rows, ids = expected
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", n_tokens int")  # a clashing column
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, PATH, keep_ids=True).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert r["n_tokens"] == len(ids[i]) and r["ids"] == ids[i]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest()
        assert r["decoded"] == library.decode(ids[i], skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_counts(spark, expected):
    rows, ids = expected
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", over_limit string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, PATH).collect()}
    for i, text in rows:
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (len(ids[i]), len((text or "").encode()), len(ids[i]) > 1024)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0
    assert len(token_counts.proved(PATH)) > 49_000


def test_packing(spark, expected):
    rows, ids = expected
    rows = rows + [rows[3]]  # a repeated row
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", piece int").repartition(3)
    got = packing.pack(df, PATH).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, _ in rows:
        whole = np.array([*ids[i], 2], "<u4")
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        if i == rows[3][0]:
            mine = mine[::2]
        assert sum(r["length"] for r in mine) == len(whole)
        assert [r["piece"] for r in mine] == list(range(len(mine))) and all(r["length"] == 1024 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= sum(r["length"] for r in got) / 1024 * 1.02 + 2
    assert packing.pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("histogram", [{1: 1}, {1023: 5, 1: 5}, {600: 7, 500: 3, 424: 9}, {1024: 3}, {512: 9, 511: 4, 2: 100}, {}])
def test_configurations_use_every_length_once(histogram):
    used = defaultdict(int)
    for n, filled in packing.configurations(histogram, 1024):
        assert n > 0 and sum(filled) <= 1024
        for x in filled:
            used[x] += n
    assert dict(used) == histogram


def test_configurations_near_the_bound():
    rng = np.random.default_rng(3)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 1024, 20_000), return_counts=True), strict=True)}
    n = sum(k for k, _ in packing.configurations(histogram, 1024))
    assert n <= 1.005 * sum(k * v for k, v in histogram.items()) / 1024 + 1


@pytest.mark.parametrize("m", [1, 1000])
@pytest.mark.parametrize("histogram, optimum", [({522: 6, 276: 6, 266: 6, 230: 12}, 9), ({512: 2, 500: 2, 12: 2}, 2), ({400: 6, 350: 6, 270: 6}, 6), ({700: 4, 200: 4, 120: 4, 1024: 2}, 6), ({600: 3, 341: 9}, 5)])
def test_sparse_histograms_reach_the_optimum(histogram, optimum, m):
    histogram = {k: v * m for k, v in histogram.items()}
    configs, used = packing.configurations(histogram, 1024), defaultdict(int)
    for n, filled in configs:
        assert n > 0 and sum(filled) <= 1024
        for x in filled:
            used[x] += n
    assert dict(used) == histogram and sum(n for n, _ in configs) == optimum * m


@pytest.mark.parametrize("times", [1, 1000])
def test_weights_place_most_and_beat_best_fit(times):
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 1024, 30_000), rng.integers(328, 333, 6_000), rng.gamma(2, 60, 14_000).astype(int) % 1023 + 1])
    histogram = {int(k): int(v) * times for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    dealt, bound = packing.weighted(histogram, 1024, *packing.SCHEDULES[0], 0)
    used = defaultdict(int)
    for n, filled in dealt:
        assert n > 0 and sum(filled) <= 1024
        for x in filled:
            used[x] += n
    assert all(n <= histogram[k] for k, n in used.items()) and sum(used.values()) >= 0.95 * sum(histogram.values())
    total = sum(n for n, _ in packing.configurations(histogram, 1024))
    assert bound <= total <= 1.004 * bound and total < sum(n for n, _ in packing.best_fit(histogram, 1024))

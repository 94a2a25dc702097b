"""Collocations against plain counting, tile by tile, level by level."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import marlstone.llm.collocations as m
from marlstone.llm.collocations import NONE, Codes, collocations, mixed, pair_counts, shortened, split_words

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def plain(rows, least=100, longest=5, share=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    good = {p: c for p, c in f.items() if c >= least}
    inside = {}
    for p, c in good.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i : i + k])
                inside[q] = max(inside.get(q, 0), c)
    out = {}
    for p, a in good.items():
        lang, words = p[0], p[1:]
        if len(words) > 1 and not 100 * inside.get(p, 0) >= share * a:
            cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, b" ".join(words), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def got(df, **how):
    out = collocations(df, **how)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in out.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    return sorted(tuple(r) for r in out.collect())


def test_given_documents(spark):
    df = spark.read.parquet(f"{D}/documents.parquet")
    want = plain([(r.text, r.lang) for r in df.collect()])
    assert got(df) == want and len(want) > 3


def test_lower_bounds_shares_and_tops(spark):
    df = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.text, r.lang) for r in df.collect()]
    assert got(df, min_count=12, share=70) == plain(rows, 12, share=70)
    assert got(df, min_count=40, longest=3, top=7) == plain(rows, 40, longest=3, top=7)
    with pytest.raises(ValueError):
        collocations(df, longest=1)


@pytest.mark.parametrize("ranked", [0, 2, 40])
def test_units_without_a_rank_and_small_tiles(spark, monkeypatch, ranked):
    """Ranks, hashes and both at once give the same; a tile of few addresses is dense."""
    monkeypatch.setattr(m, "RANKED", ranked)
    df = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    rows = [(r.text, r.lang) for r in df.collect()]
    assert got(df, min_count=10) == plain(rows, 10)


def test_edges(spark):
    rows = [
        ("New  York\tnew york.New\nYork", "en"), ("a a a a", "en"), (None, "en"), ("", None), ("É e É e É E", None), ("É e", "und"), ("new york", "de"),
        ("x y z\x0bx y z\x0cx y z\rx y z", "en"), ("\x00 \x01 \x00 \x01", ""), ("p q " * 9, "fr"), (" . , ; ", "it"), ("longword" * 3000 + " tail ", "fr"),
    ]
    df = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows + rows[:3])] + [(None, "a b", "en"), (None, "a b", "en")], SCHEMA).selectExpr("*", "1 as a", "2 as h", "3 as code", "text as phrase")
    want = [(r.text, r.lang) for r in df.collect()]
    assert got(df, min_count=2) == plain(want, 2)
    assert got(df.limit(0)) == [] and got(df, min_count=1000) == []


def test_one_long_text_over_many_windows(spark, monkeypatch):
    monkeypatch.setattr(m, "WINDOW", 50)
    text = " ".join(f"w{k % 7} of{k % 3}" + (". " if k % 11 == 0 else "") for k in range(4000)) + "x" * 300
    assert got(spark.createDataFrame([(1, text, "en")], SCHEMA), min_count=20) == plain([(text, "en")], 20)
    words, texts, marks = zip(*split_words(pa.array([text, None, "b c!d"]).slice(0)))
    assert b" ".join(w for x in words for w in x.to_pylist()) == b" ".join(re.findall(rb"[^\x20\x09.,;:!?]+", text.encode())) + b" b c d"
    assert np.concatenate(texts)[-3:].tolist() == [2, 2, 2] and len(words) > 100


def test_scores_of_large_counts_are_exact(spark):
    rows = [(9_000_000_000_001, 16_000_000_000_003, [9_000_000_000_007, 9_000_000_000_001], [9_500_000_000_009, 9_000_000_000_001]), (100, 10**17 + 1, [10**16 + 3, 100], [10**9, 100])]
    df = spark.createDataFrame(rows, "a long, n long, firsts array<long>, lasts array<long>")
    for r in m._scores(df, 2).collect():
        assert r.score == 1000 * r.a * r.n // (r.firsts[0] * r.lasts[0]) and (r.l, r.r) == (r.firsts[0], r.lasts[0])


def test_pairs_of_ranks_and_hashes():
    chance = np.random.default_rng(1)
    codes = np.concatenate([chance.integers(0, 40, 200_000), chance.integers(0, 60_000, 50_000), -2 - chance.integers(0, 30, 5000), np.full(4000, NONE)])
    chance.shuffle(codes)
    a, b, n = pair_counts(codes)
    want = Counter((x, y) for x, y in zip(codes[:-1].tolist(), codes[1:].tolist()) if NONE not in (x, y))
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want and len(a) == len(want)
    assert all(len(x) == 0 for x in pair_counts(np.array([], np.int64)))


def test_codes_and_breaks():
    hashes = np.array([50, 7, 1 << 60, 9], np.int64)
    bits = {}
    for h in [*hashes.tolist(), 12345]:
        low = h & ((1 << m.BITMAP_BITS) - 1)
        bits[low >> 6] = bits.get(low >> 6, 0) | 1 << (low & 63)
    words = np.array(sorted(bits))
    codes = Codes(hashes, words, np.array([bits[w] for w in words], np.uint64).view(np.int64))
    assert codes(np.array([9, 50, 8, 12345, 1 << 60, 7])).tolist() == [3, 0, NONE, -12347, 2, 1]
    assert shortened(np.array([NONE, 1, NONE, 2, 3, NONE, NONE, 4, 5, 6, NONE, 7])).tolist() == [2, 3, NONE, 4, 5, 6, NONE]
    assert mixed(np.array([1, 2]), np.array([2, 1])).tolist() != mixed(np.array([2, 1]), np.array([1, 2])).tolist() and mixed(np.array([-5]), np.array([-7])) >= 0

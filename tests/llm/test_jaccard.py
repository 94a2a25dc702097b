"""Jaccard components against brute force."""

import random

import numpy as np
import pytest

from marlstone.llm import jaccard as J


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, m):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(40)] + ["É", "x"]
    rows = []
    for k in range(m):
        if rows and rnd.random() < 0.6:
            words = rnd.choice(rows)[1].split()
            for _ in range(rnd.randrange(0, 5)):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((k, " ".join(words)))
        else:
            rows.append((k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 3, 4, 6, 10, 30, 80, 200])))))
    return rows


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80)])
def test_components(spark, seed, n, percent):
    rows = corpus(seed, 160)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, component_id string, node long").repartition(4)
    got = sorted(map(tuple, J.jaccard_components(docs, n=n, percent=percent).collect()))
    assert got == brute(rows, n, percent)


def test_small_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(J, "MEETING", 4)
    monkeypatch.setattr(J, "MEMBERS", 2)
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    rows = corpus(3, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(docs).collect())) == brute(rows, 4, 85)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (None, "a b c d e f"), (8, "a b c d e f"), (9, "p q r s t"), (9, "x y z u v"), (10, "x y z u v"), (9, "p q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0) for r in J.jaccard_components(docs).collect())
    assert got == sorted(
        [(False, 0, 3, False, 0), (True, 8, 3, False, 0), (True, 1, 0, True, 1), (True, 2, 0, True, 2), (True, 3, 0, True, 3), (True, 4, 1, True, 4), (True, 5, 1, True, 4), (True, 6, 1, True, 6)]
        + [(True, 9, 2, True, 9)] * 3 + [(True, 10, 2, True, 9)]
    )
    kept = J.one_per_component(docs).collect()
    #: rows of one id and different texts are different documents here; a row with an id goes before one without
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 6, 8, 9, 9]
    assert J.jaccard_components(docs.where("false")).count() == 0


def test_an_id_with_two_texts_one_of_them_a_copy(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    near = b.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (9, a), (9, b), (10, near), (11, "quite another text of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in J.jaccard_components(docs).collect()}
    assert got == {(1, 1), (9, 1), (10, 1), (11, 11)}


def test_rows_without_an_id_are_documents_of_their_own(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    near = b.rsplit(" ", 1)[0] + " end"
    rows = [(None, a, 1), (None, b, 2), (None, near, 3), (None, a, 4), (None, c, 5), (3, d, 6), (4, a, 7), (None, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(4)
    kept = J.one_per_component(docs).collect()
    texts = [r.text for r in kept]
    assert sorted(t for t in texts if t and t not in (b, near)) == [a, c, d]
    assert sum(t in (b, near) for t in texts) == 1
    assert {r.text: r.doc_id for r in kept if r.text in (a, c)} == {a: 4, c: None}
    assert sorted(r.k for r in kept if not r.text) == [8, 9]


def test_rows_of_one_id_with_different_texts_all_stay(spark):
    rows = [(9, " ".join(f"{x}{k}" for k in range(9)), 77) for x in "abcdefgh"]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, _id int")
    for given in (docs, docs.repartition(5, "text")):
        kept = J.one_per_component(given).collect()
        assert sorted(r.text for r in kept) == sorted(r[1] for r in rows) and {r._id for r in kept} == {77}


@pytest.mark.parametrize("seed", range(40))
def test_similar_rows_share_a_part_and_pass_the_bounds(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(1, 900))
    row = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
    gone = int(rnd.integers(0, J.differing(len(row), 85) + 1))
    other = np.unique(np.concatenate([row[gone // 2 :], rnd.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)]))
    common = len(np.intersect1d(row, other))
    similar = 100 * common >= 85 * (len(row) + len(other) - common)
    assert J.overlap(row, other, 85) == similar
    if similar:
        assert len(np.intersect1d(J.parts(row, 85), J.parts(other, 85)))
        met = J.Meeting([1, 2], [1, 2], [len(row), len(other)], [J.sketch(row), J.sketch(other)])
        assert [i for i, _, _ in met.pairs(85)] and list(met.best(85))


def test_repeated_rows_with_maps(spark):
    """Of repeats one row stays, whichever further columns it has; maps neither order nor hash."""
    from marlstone.llm.jaccard import one_per_component

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, {"a": 1}, 5), (1, text, {"b": 2}, 4), (1, text, None, 4), (2, text + " eleven", {}, 1), (None, None, {"c": 3}, 0), (None, None, {"c": 3}, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, n int")
    for _ in range(2):
        kept = one_per_component(df, n=5, percent=80).collect()
        assert sorted((r.doc_id or 0, r.n) for r in kept)[0][0] == 0 and len(kept) == 2 and {r.doc_id for r in kept} == {None, 1}

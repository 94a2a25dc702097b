"""Targets against the iterative definition; thresholds against sorted sums."""

import hashlib

import pytest

from marlstone.llm.mixing import mix_sources, mixed_documents


def iterative(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("rows", [
    [(k, "w " * (k % 17), ["a", "B", None, "é", ""][k % 5]) for k in range(400)],
    [(k, "w " * 10, "big" if k % 10 else f"s{k % 30}") for k in range(300)] + [(5, "w w", "big"), (None, "w w w", "s0")],
    [(1, None, "a"), (2, "", None)],
])
def test_mix(spark, rows):
    docs = spark.createDataFrame([(i, t, s, 1.0) for i, t, s in rows], "doc_id long, text string, source string, target double").repartition(3)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = iterative(sizes)
    by_id = {}
    for i, t, s in rows:
        by_id.setdefault(i, []).append((len((t or "").split()), s))
    taken: dict = {}
    for r in got:
        size, s = next(x for x in by_id[r.doc_id] if x[0] == r["size"])
        if len(by_id[r.doc_id]) == 1:
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
            taken[s] = taken.get(s, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(docs.repartition(7)).collect()), key=str)
    largest = max([len((t or "").split()) for _, t, _ in rows])
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest + 3
    assert mixed_documents(docs).count() == sum(r.taken // r["size"] for r in got if r["size"])
    assert mixed_documents(docs).columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(docs).count() == 0 and mixed_documents(docs).count() == 0


def test_threshold_is_a_prefix_of_the_hash_order(spark):
    texts = {k: "w " * (1 + k % 7) for k in range(500)}
    docs = spark.createDataFrame([(k, t, f"s{k % 2}") for k, t in texts.items()], "doc_id long, text string, source string")
    rows = mix_sources(docs).collect()
    for s in (0, 1):
        mine = sorted((hashlib.md5(f"{r.doc_id} {texts[r.doc_id]}".encode()).hexdigest()[:15], r.taken // r["size"]) for r in rows if r.doc_id % 2 == s)
        times = [t for _, t in mine]
        assert times == sorted(times, reverse=True)


@pytest.mark.parametrize("one", [None, 7])
def test_different_texts_of_one_id_are_taken_apart(spark, one):
    rows = [(one if k % 3 else k, f"{k} " * (1 + k % 5), f"s{k % 3}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken: dict = {}
    for r in mix_sources(docs).collect():
        taken.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), words in taken.items():
        assert abs(sum(words) - target) <= 5


@pytest.mark.parametrize("one", [None, 3])
def test_a_block_of_repeats_is_cut(spark, one):
    """Half of a source is one repeated row: so many of its copies are taken as the target asks for."""
    rows = [(k, f"{k} " * 10, "a") for k in range(2000)] + [(one, "same " * 10, "a")] * 2000 + [(k, "z " * 7, "b") for k in range(5000, 5400)] + [(None, None, "b")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    for source, size in (("a", 40_000), ("b", 2_800)):
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5 and all(0 <= r.taken <= 2 * r["size"] for r in own)
    mixed = mixed_documents(docs.selectExpr("*", "map('k', doc_id) as m"))
    assert mixed.columns == ["doc_id", "text", "source", "m"] and mixed.count() == sum(r.taken // r["size"] for r in got if r["size"])


def test_one_row_that_stands_everywhere(spark):
    docs = spark.createDataFrame([(1, "one two three", "s")] * 25_000 + [(2, "x", "t")], "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert len(got) == 25_001 and abs(sum(r.taken for r in got if r["size"] == 3) - next(r.target for r in got if r["size"] == 3)) <= 3


def test_long_texts(spark):
    docs = spark.createDataFrame([(k, "word " * (1 if k else 400_000), "s") for k in range(50)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    assert got[0]["size"] == 400_000 and all(r.source_size == 400_049 for r in got.values())

"""Lexical search by shards against plain counting."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone.operators import lexical as L
from marlstone.operators import retrieval as R

SOUGHT = "query_id long, term string"


def made(seed):
    chance = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    texts = [[w for w in words if chance.random() < 1.5 / (1 + int(w[1:]))] * chance.randint(1, 2) for _ in range(400)]
    texts += [["w0", "w1", "rare"]] * 30 + [[]]
    queries = {q: set(chance.sample(words, chance.randint(1, 6))) for q in range(40)} | {100: {"w0", "unheard"}, 101: {"unheard"}, 102: {"rare", "w1"}}
    return {k: t for k, t in enumerate(texts)}, queries


def plainly(items, queries, k, every, fall, but=lambda q: None):
    n = sum(1 for t in items.values() if t)
    counts = {i: Counter(t) for i, t in items.items()}
    held = Counter(w for c in counts.values() for w in c)
    for q, terms in queries.items():
        scored = []
        for i, c in counts.items():
            met = [t for t in terms if t in c]
            if met and i != but(q):
                scored.append((-round(sum(math.log(1 + n / held[t]) * c[t] / (1 + c[t]) for t in met), 6), i, len(met)))
        strict = [x for x in scored if x[2] == len(terms)] if every else []
        found = strict or (scored if fall else [])
        yield from ((q, i, m, -s, not strict, r + 1) for r, (s, i, m) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("every,fall,k,shards", [(True, False, 50, 3), (True, True, 5, 2), (False, True, 10, 1), (True, True, 3, 7)])
def test_shards_find_what_counting_finds(spark, every, fall, k, shards):
    items, queries = made(k)
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], SOUGHT)
    rows = spark.createDataFrame([(i, t) for i, t in items.items()], "item_id long, words array<string>").repartition(4, "item_id")
    got = L.best_items(terms, rows, k, every, fall, but=F.col("query_id") * 3, shards=shards).collect()
    want = list(plainly(items, queries, k, every, fall, but=lambda q: q * 3))
    assert sorted((r.query_id, r.rank, r.item_id, r.matched, r.via_fallback) for r in got) == sorted((q, r, i, m, f) for q, i, m, _, f, r in want)
    scores = {(q, i): s for q, i, _, s, _, _ in want}
    assert all(abs(scores[r.query_id, r.item_id] - r.score) < 2e-6 for r in got)


@pytest.mark.parametrize("every", [True, False])
def test_postings_find_the_same_as_rows_of_all_matches(spark, every):
    items, queries = made(7)
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], SOUGHT)
    posted = spark.createDataFrame([(i, w, n) for i, t in items.items() for w, n in Counter(t).items()], "item_id long, term string, n long")
    whole = {}
    for r in R.lexical_search(terms, posted, every, k=None).collect():
        whole.setdefault(r.query_id, []).append((-r.score, r.item_id, r.matched))
    got = {}
    for r in R.lexical_search(terms, posted, every, k=20).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.item_id, r.matched))
    assert got == {q: sorted(rows)[:20] for q, rows in whole.items()}


@pytest.mark.parametrize("query", ["q_lexical_and", "q_lexical_fallback"])
def test_no_rows_are_made_for_what_meets_by_term(spark, query):
    """One join, of the terms asked with the number of their items; none with the items themselves."""
    plan = entry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1

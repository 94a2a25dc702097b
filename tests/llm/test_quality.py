"""Base features against plain Python; the vote model; edge cases; accuracy on labelled documents."""

import random
import re
from collections import Counter

import numpy as np

from marlstone.llm.quality import BAD, GOOD, RULES, expectation_maximisation, features, filter_quality, score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_features():
    rnd = random.Random(2)
    texts = ["", " \n", "a", "é ü x   y", "a b c d e a b c d e", "x\n\nx\n x\nx", "#*$ %&| <>"]
    texts += ["".join(rnd.choice(["a", "b", "é", " ", "\n", "#", "日"]) for _ in range(rnd.randrange(200))) for _ in range(200)]
    for t in texts:
        assert features(t.encode())[0] == plain(t), t


def test_votes_find_the_classes():
    rnd = np.random.default_rng(1)
    truth = rnd.random(4000) < 0.8
    right = rnd.random((4000, len(RULES))) < 0.85
    votes = np.where(right == truth[:, None], GOOD, BAD) * (rnd.random((4000, len(RULES))) < 0.7)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, accuracy = expectation_maximisation(patterns, counts)
    assert ((post[where.ravel()] >= 0.5) == truth).mean() > 0.95
    assert np.abs(accuracy - 0.85).max() < 0.05


def test_edges(spark):
    good = "The quick fox jumps over the lazy dog and then it runs on to the river. " * 1 + "A man saw it and was glad for the day of rest that he had with his family in the town."
    rows = [(1, None), (2, ""), (None, good), (4, good), (4, good), (5, "a b c"), (6, "spam " * 200), (7, good + " x" * 100_000)]
    docs = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "doc_id long, text string, kept boolean, _q_pattern long")
    got = score_quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert sum(r.kept for r in got) == 3
    kept = filter_quality(docs)
    assert kept.columns == docs.columns and [r._q_pattern for r in kept.collect()] == [1, 1, 1]
    assert score_quality(docs.where("false")).count() == 0


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = score_quality(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    clean = rows[(rows.quality == 1) & ~rows.base_failed]
    assert clean.kept.mean() > 0.99
    assert (~rows[rows.quality == 0].kept).mean() > 0.9

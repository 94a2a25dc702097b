"""Calls of providers, columns of candidates, floors of files."""

import time

import pytest

from marlstone.operators import ingest as I
from marlstone.operators import retrieval as R


def test_calls_run_side_by_side_and_are_tried_again(spark):
    rows = spark.createDataFrame([(f"t{k}",) for k in range(20)], "text string").coalesce(1)
    began, seen = time.time(), {}

    def provider(texts):
        seen[texts[0]] = seen.get(texts[0], 0) + 1
        if seen[texts[0]] == 1 and texts[0] in ("t0", "t6"):
            raise ConnectionError("busy")
        time.sleep(0.2)
        return [[float(t[1:])] for t in texts]

    got = I.embed(rows, provider, "p:1", batch=2, at_once=5, pause=0.05).collect()
    assert [(r.text, r.embedding, r.embedding_model) for r in got] == [(f"t{k}", [float(k)], "p:1") for k in range(20)] and time.time() - began < 20

    def never(texts):
        raise TimeoutError("down")

    with pytest.raises(Exception, match="down"):
        I.embed(rows, never, "p:1", attempts=2, pause=0.01).collect()


def test_pauses_double():
    waits, calls = [], []
    real, I.time.sleep = I.time.sleep, waits.append

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise ConnectionError
        return "done"

    try:
        assert I._tried(call, 4, 0.5) == "done" and waits == [0.5, 1.0, 2.0]
    finally:
        I.time.sleep = real


def test_candidates(spark):
    hits = spark.createDataFrame([(1, "c1", 1), (1, "gone", 2), (2, "c2", 1)], "query_id int, item_id string, rank int")
    chunks = spark.createDataFrame([("c1", "d1", "A › b", 0, "x", 7), ("c2", "d1", "A › c", 1, "y", 7)], "id string, document_id string, section_path string, ordinal int, text string, title int")
    docs = spark.createDataFrame([("d1", "T", "urn:1", "filing")], "id string, title string, source_uri string, doc_type string")
    out = R.candidates(hits, chunks, docs)
    assert out.columns == ["query_id", "rank", *R.CANDIDATE]
    assert sorted(map(tuple, out.collect())) == [(1, 1, "c1", "d1", "T", "urn:1", "filing", "A › b", 0, "x"), (2, 1, "c2", "d1", "T", "urn:1", "filing", "A › c", 1, "y")]


def test_floors(spark):
    files = spark.createDataFrame([("a", 200, "é" * 5), ("b", 200, "x" * 9), ("c", 202, "x" * 99), ("d", 200, "awsWaf" + "x" * 99), ("e", 200, "x")], "filename string, status int, content string")
    registry = spark.createDataFrame([(k, 10) for k in "abcd"], "filename string, min_bytes int")
    assert {r.filename: r.quality for r in I.fetch_quality(files, registry).collect()} == {"a": "present", "b": "too small", "c": "challenge", "d": "challenge", "e": "unregistered"}

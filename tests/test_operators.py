"""Operators on hand-made inputs, streams by replay."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.functions.statistics import clopper_pearson, exclusive_quantile, mcnemar_exact, paired_difference
from marlstone.operators import answers, contracts, ingest, ledger, retrieval, telemetry, text
from marlstone.sources.tables import rates
from marlstone.streaming import answers as streams


def one(df):
    return df.first()


@pytest.mark.parametrize("b,c,p", [(5, 0, 0.0625), (6, 0, 0.03125), (3, 20, 0.000488), (0, 0, 1.0), (700, 800, None)])
def test_mcnemar(spark, b, c, p):
    got = one(spark.range(1).select(mcnemar_exact(F.lit(b), F.lit(c)).alias("p"))).p
    n, k = b + c, min(b, c)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    assert got == pytest.approx(want, rel=1e-9)
    assert p is None or got == pytest.approx(p, abs=1e-6)


def test_intervals(spark):
    r = one(spark.createDataFrame([(2, 14)], "x long, n long").select(clopper_pearson()("x", "n").alias("i"))).i
    assert (round(r.low, 3), round(r.high, 3)) == (0.018, 0.428)
    d, low, high = paired_difference(*(F.lit(x) for x in (90, 20, 3, 7)))
    row = one(spark.range(1).select(d.alias("d"), low.alias("l"), high.alias("h")))
    assert row.l > 0 and row.l < row.d < row.h
    q = exclusive_quantile(spark.createDataFrame([(k,) for k in range(1, 27)], "v long"), "v", [], 0.95)
    assert one(q)["quantile"] == pytest.approx(25.65)


def test_vector_search(spark):
    corpus = spark.createDataFrame([(f"c{k:03}", [math.cos(0.004 * (k + 1)), math.sin(0.004 * (k + 1))], "a" if k % 2 else "b") for k in range(60)], "item_id string, embedding array<float>, kind string")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = [r.item_id for r in retrieval.vector_topk(asked, corpus, 3).orderBy("rank").collect()]
    assert got == ["c000", "c001", "c002"]
    assert [r.item_id for r in retrieval.vector_topk(asked, corpus, 2, {"kind": ["a"]}).orderBy("rank").collect()] == ["c001", "c003"]
    assert retrieval.vector_topk(asked, corpus, 2, {"kind": []}).count() == 0
    same = corpus.select(F.col("item_id").alias("query_id"), "embedding").where("query_id = 'c007'")
    assert [r.item_id for r in retrieval.vector_topk(same, corpus, 2, but_itself=True).orderBy("rank").collect()] == ["c006", "c008"]
    with pytest.raises(ValueError):
        retrieval.vector_topk(asked, corpus, 51)
    with pytest.raises(ValueError):
        retrieval.check_identity(corpus.withColumn("embedding_model", F.col("kind")), "a")


def test_section_labels(spark):
    rows = spark.createDataFrame([("Annex I", "Annex Ii"), ("Annex I", "Annex I"), ("Annex I", "Annex I › Part 1"), ("Article 1", "Article 10"), ("A", "A_b"), ("A", "B")], "label string, path string")
    got = rows.select(retrieval.matches_section(F.col("label"), F.col("path")).alias("m"), retrieval.straddles(F.col("label"), F.col("path")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False), (True, False), (False, True), (False, True), (False, False)]


CASES = [
    ("ANSWERED\ntext [1] and [1]", "answered", None, "text [1] and [1]"),
    ("ANSWERED\nx [99] [0] [abc] [] [1234567] [", "answered", None, "x   [abc] [] [1234567] ["),
    ("Hello\ntext", "error", None, "text"),
    ("ANSWERED", "error", None, ""),
    ("x" * 201 + "\ntext", "error", None, "x" * 201 + "\ntext"),
    ("ANSWERED\ntext\nINSUFFICIENT_EVIDENCE", "insufficient_evidence", "insufficient_evidence", "text"),
    ("bad\ntext\nANSWERED\n", "answered", "answered", "text\n"),
    ("ANSWERED\nINSUFFICIENT_EVIDENCE — the excerpts", "answered", None, "INSUFFICIENT_EVIDENCE — the excerpts"),
    ("ANSWERED\nINSUFFICIENT_EVIDENCE\nmore\nANSWERED", "answered", "answered", "more"),
]


def test_completions(spark):
    rows = spark.createDataFrame([(str(k), c[0]) for k, c in enumerate(CASES)], "request_id string, raw string")
    got = answers.parsed(rows).select("request_id", "verdict", "trailing", answers.clean_text(F.lit(5)).alias("text")).collect()
    for r in got:
        _, verdict, trailing, clean = CASES[int(r.request_id)]
        assert (r.verdict, r.trailing, r.text) == (verdict, trailing, clean)


def test_fragments_in_any_cut_give_the_completion(spark, tmp_path):
    rnd, raw = random.Random(1), "ANSWERED\nsome text [1]\nmore\nINSUFFICIENT_EVIDENCE"
    rows, start = [], datetime(2024, 1, 1)
    for k in range(12):
        cuts = sorted(rnd.sample(range(1, len(raw)), k))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        rows += [(f"r{k}", n, start + timedelta(seconds=n), p, "complete" if n == len(parts) - 1 else "text") for n, p in enumerate(parts)]
    rows.append(("open", 0, start, "ANSWERED\nhalf", "text"))
    rnd.shuffle(rows)
    schema = "request_id string, seq long, ts timestamp, text string, kind string"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = start + timedelta(hours=3)
    for k in range(2):
        spark.createDataFrame([(f"tick{k}", 0, late + timedelta(hours=k), "x", "complete")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.assemble(stream).writeStream.format("memory").queryName("assembled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.request_id: (r.raw, r.complete) for r in spark.table("assembled").collect()}
    assert all(got[f"r{k}"] == (raw, True) for k in range(12))
    assert got["open"] == ("ANSWERED\nhalf", False)


def test_streamed_metrics_equal_batch(spark, tmp_path):
    rows = [(f"r{k % 7}", f"/{k % 2}", datetime(2024, 1, 1) + timedelta(minutes=k), 503 if k % 5 == 0 else 200) for k in range(60)]
    spark.createDataFrame(rows, "request_id string, route string, ts timestamp, status long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id string, route string, ts timestamp, status long").parquet(str(tmp_path / "in"))
    query = streams.tumbling_metrics(stream).writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = streams.tumbling_metrics(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("metrics").collect())) == sorted(map(tuple, batch.collect()))
    seen = []
    done = streams.ingest(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "ck"))
    done.awaitTermination(60)
    assert sum(seen) == 60


def test_prices(spark):
    rows = [(1, "north:alpha", datetime(2024, 1, 15, 23, 59, 59), 1, 0), (2, "north:alpha", datetime(2024, 1, 16), 1, 0), (3, "south:gamma", datetime(2024, 1, 21), 1, 1), (4, "none", datetime(2024, 1, 1), 1, 1), (5, "south:gamma", datetime(2024, 1, 6), 2, 0), (6, "south:gamma", datetime(2024, 1, 6), 6, 0)]
    log = spark.createDataFrame(rows, "id long, identity string, created_at timestamp, prompt_tokens long, completion_tokens long")
    got = {r.id: r.cost_usd for r in ledger.priced(log, rates(spark)).collect()}
    assert got[1] == Decimal("0.000002") and got[2] == Decimal("0.000003") and got[3] is None and got[4] is None
    assert got[5] == Decimal("0.000000") and got[6] == Decimal("0.000002")
    assert {(r.id, r.reason) for r in ledger.unpriced(log, rates(spark)).collect()} == {(3, "no rate that day"), (4, "no rates")}
    days = spark.createDataFrame([("2024-02-10",), ("2023-02-10",), ("2024-04-01",)], "d string").select(F.to_date("d").alias("d"))
    assert [float(r[0]) for r in days.select(ledger.derived_daily_limit(F.lit(20), F.col("d"))).collect()] == [0.68, 0.71, 0.66]


def test_histogram_keeps_empty_buckets(spark):
    h = telemetry.latency_histogram(spark.createDataFrame([("r", 0.05), ("r", 0.06), ("r", 99.0)], "route string, s double"), "s", "route")
    assert [r.n for r in h.orderBy("bound").collect()] == [1, 2, 2, 2, 2, 2, 2, 2, 3]


def test_ingest_twice(spark):
    incoming = spark.createDataFrame([("u1", "h1"), ("u2", "h2"), ("u3", "h1")], "source_uri string, content_hash string")
    empty = incoming.where("false")
    first = {r.source_uri: r.verdict for r in ingest.verdicts(incoming, empty).collect()}
    assert first == {"u1": "new", "u2": "new", "u3": "unchanged"}
    stored = ingest.replace_by_uri(empty, incoming)
    assert {r.verdict for r in ingest.verdicts(incoming, stored).collect()} == {"unchanged"}
    changed = spark.createDataFrame([("u1", "h9")], incoming.schema)
    assert {(r.source_uri, r.content_hash) for r in ingest.replace_by_uri(stored, changed).collect()} == {("u1", "h9"), ("u2", "h2")}


def test_embedding_retries(spark):
    def provider(texts):
        if not hasattr(provider, "failed"):
            provider.failed = True
            raise TimeoutError
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("a",), ("bb",)], "text string").coalesce(1)
    assert [(r.text, r.embedding) for r in ingest.embed(rows, provider, "fake:len").collect()] == [("a", [1.0]), ("bb", [2.0])]


def test_text(spark):
    row = spark.createDataFrame([("bene-\nfits é-\nà x",)], "t string").select(text.dehyphenate(F.col("t")).alias("d"), text.collapse(text.nfkc(F.lit("ﬁne  x "))).alias("n"))
    assert tuple(one(row)) == ("benefits éà x", "fine x")
    lines = [(1, p, n, t) for p in range(3) for n, t in enumerate(["Header", f"body {p}", "7"])] + [(1, 3, 0, "")]
    got = text.strip_furniture(spark.createDataFrame(lines, "doc long, page long, line_no long, text string")).collect()
    assert sorted(r.text for r in got) == ["", "body 0", "body 1", "body 2"]


def test_violations(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (3, None, 1)], "id long, name string, n long")
    got = contracts.violations(rows, "id", {"n": F.col("n") <= 0, "name": F.col("name").isNull()}, ("name",)).collect()
    assert {tuple(r) for r in got} == {("2", "n"), ("3", "name"), ("a", "repeated name")}


def test_provisional_verdicts_and_their_correction(spark, tmp_path):
    start = datetime(2024, 1, 1)
    raws = {"same": "ANSWERED\nbody\nANSWERED", "over": "ANSWERED\nbody\nINSUFFICIENT_EVIDENCE\n", "none": "Hello\nbody", "one": "ANSWERED"}
    rows = []
    for name, raw in raws.items():
        parts = [raw[k : k + 4] for k in range(0, len(raw), 4)]
        rows += [(name, n, start + timedelta(seconds=n), p, "complete" if n == len(parts) - 1 else "text") for n, p in enumerate(parts)]
    rows.append(("open", 0, start, "INSUFFICIENT_EVIDENCE\nhalf", "text"))
    schema = "request_id string, seq long, ts timestamp, text string, kind string"
    random.Random(2).shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.verdict_events(stream).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("verdicts").collect()))
    assert got == [("none", "error", True), ("one", "error", True), ("open", "insufficient_evidence", True), ("over", "answered", True), ("over", "insufficient_evidence", False), ("same", "answered", True)]


def test_a_ceiling_trips_once(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=k), ("visitor", "eval")[k % 2], 1.0) for k in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "ts timestamp, source string, cost_usd double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, source string, cost_usd double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.spend_trips(stream, 5.0, late="3 days").writeStream.format("memory").queryName("trips").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.period_start.day, r.source, r.spent) for r in spark.table("trips").collect())
    assert got == [(1, "eval", 5.0), (1, "visitor", 5.0), (2, "eval", 5.0), (2, "visitor", 5.0)]


def test_completion_seam(spark):
    def provider(system, user, most):
        return f"{system}:{user}", len(user), min(most, 7), "end"

    rows = spark.createDataFrame([("s", "hello"), (None, None)], "system string, user string").coalesce(1)
    got = ingest.complete(rows, provider, "fake:echo").collect()
    assert [tuple(r.completion) for r in got] == [("s:hello", 5, 7, "end"), (":", 0, 7, "end")] and got[0].model == "fake:echo"

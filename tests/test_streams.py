"""Streams by replay of files: ceilings, silent series, sessions, alerts, repeated requests, committed ingest."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators.ledger import ceiling_trips
from marlstone.sources.files import complete_versions, read_corpus, replace_corpus, version_name
from marlstone.streaming import answers as S


def replayed(spark, tmp_path, schema, batches, made, name, mode="append"):
    """The rows of a stream over one file a batch, in that order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = made(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def at(text):
    return pd.Timestamp(text).to_pydatetime()


SPEND = "ts timestamp, source string, cost_usd double"


def test_months_end_where_the_calendar_does(spark, tmp_path):
    batches = [[(at("2024-01-31 23:00"), "a", 6.0)], [(at("2024-02-01 00:00"), "a", 6.0), (at("2024-02-01 01:00"), "b", 1.0)], [(at("2024-02-29 23:59"), "a", 5.0), (at("2024-02-29 23:59"), "a", 5.0)], [(at("2024-03-01 00:00"), "a", 9.0)]]
    rows = replayed(spark, tmp_path, SPEND, batches, lambda s: S.spend_trips(s, 10.0, "1 month", late="40 days"), "months")
    assert [(str(r.period_start), r.source, r.spent) for r in rows] == [("2024-02-01 00:00:00", "a", 11.0)]
    with pytest.raises(ValueError):
        S.spend_trips(spark.createDataFrame([], SPEND), 1.0, "2 months")


def test_streamed_ceilings_trip_where_the_batch_does(spark, tmp_path):
    rows = [(at("2024-01-30 08:00") + pd.Timedelta(hours=5 * k).to_pytimedelta(), "visitor" if k % 3 else "harness", 1.0 + k % 4) for k in range(40)]
    batches = [rows[k : k + 7] for k in range(0, 40, 7)]
    got = replayed(spark, tmp_path, SPEND, batches, lambda s: S.budget_trips(s, 7.0, 60.0, late="60 days"), "budgets")
    batch = ceiling_trips(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, created_at timestamp, source string, cost_usd double"), 7.0, 60.0)
    first = batch.where("tripped is not null").withColumn("start", F.when(F.col("tripped") == "daily", F.to_timestamp("_d")).otherwise(F.col("_m"))).groupBy("tripped", "start").agg(F.min("created_at").alias("at")).collect()
    #: a month that is over its ceiling trips no day any more, in both
    assert sorted((r.cause, r.period_start, r["at"]) for r in got) == sorted(map(tuple, first)) and {r.cause for r in got} == {"daily", "monthly"}


def test_series_that_fall_silent(spark, tmp_path):
    day = "2024-05-01 "
    batches = [[("a", at(day + "00:00")), ("b", at(day + "00:05"))], [("b", at(day + "00:50"))], [("b", at(day + "02:00"))], [("b", at(day + "02:01")), ("a", at(day + "02:02"))], [("b", at(day + "02:03"))]]
    rows = replayed(spark, tmp_path, "route string, ts timestamp", batches, lambda s: S.silent_series(s, "30 minutes", late="1 minute"), "silent")
    told = sorted((r.route, str(r.last_seen)[11:16]) for r in rows)
    #: a's pause, b's two pauses between events, and nothing of what may still go on
    assert told == [("a", "00:00"), ("b", "00:05"), ("b", "00:50")]


def test_sessions_alerts_and_repeats(spark, tmp_path):
    day = "2024-05-01 "
    events = [[("r1", at(day + "00:00"), 200), ("r1", at(day + "00:04"), 500), ("r2", at(day + "00:01"), 200)], [("r1", at(day + "00:20"), 200), ("r2", at(day + "00:02"), 200)]]
    schema = "request_id string, ts timestamp, status int"
    for name, made, mode in (("sessions", lambda s: S.idle_sessions(s, "10 minutes"), "complete"), ("alerts", S.sliding_alerts, "complete"), ("once", S.once_per_request, "append"), ("spent", lambda s: S.running_spend(s.withColumn("source", F.lit("x")).withColumn("cost_usd", F.lit(1.0))), "complete")):
        rows = replayed(spark, tmp_path / name, schema, events, made, name, mode)
        if name == "sessions":
            assert sorted((r.request_id, r.n) for r in rows) == [("r1", 1), ("r1", 2), ("r2", 2)]
        if name == "alerts":
            fired = sorted(r.window.start for r in rows if r.fires)
            assert (fired[0], fired[-1], len(fired)) == (at("2024-04-30 23:50"), at(day + "00:04"), 15)
        if name == "once":
            assert sorted(r.request_id for r in rows) == ["r1", "r2"]
        if name == "spent":
            assert [r.spent for r in rows] == [5.0]


DOCS = "source_uri string, content_hash string, body string"


def parsed(batch):
    documents = batch.select("source_uri", F.sha2("body", 256).alias("content_hash"), "body")
    return documents, batch.select("source_uri", F.explode(F.split("body", " ")).alias("text"))


def test_ingest_commits_once(spark, tmp_path):
    path, files, schema = str(tmp_path / "corpus"), str(tmp_path / "in"), "source_uri string, body string"
    assert read_corpus(spark, path) is None

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
        S.ingest_corpus(spark.readStream.schema(schema).parquet(files), parsed, path, str(tmp_path / "ck")).awaitTermination()
        documents, chunks = read_corpus(spark, path)
        return sorted((r.source_uri, r.body) for r in documents.collect()), sorted((r.source_uri, r.text) for r in chunks.collect())

    assert arrive(("u1", "one two"), ("u2", "three")) == ([("u1", "one two"), ("u2", "three")], [("u1", "one"), ("u1", "two"), ("u2", "three")])
    assert arrive(("u1", "four"), ("u3", "three")) == ([("u1", "four"), ("u2", "three")], [("u1", "four"), ("u2", "three")])
    assert complete_versions(spark, path) == [version_name(0), version_name(1)]


def test_a_crash_between_documents_and_chunks(spark, tmp_path):
    """What broke off is not read, and is written anew when the batch comes again; what is complete stays as it is."""
    path = str(tmp_path / "corpus")
    documents, chunks = parsed(spark.createDataFrame([("u1", "one two")], "source_uri string, body string"))
    replace_corpus(documents, chunks, path, version_name(0))
    documents.limit(0).write.parquet(f"{path}/{version_name(1)}/documents")
    assert complete_versions(spark, path) == [version_name(0)] and read_corpus(spark, path)[0].count() == 1
    again = parsed(spark.createDataFrame([("u1", "five"), ("u2", "six seven")], "source_uri string, body string"))
    replace_corpus(*again, path, version_name(1))
    assert [df.count() for df in read_corpus(spark, path)] == [2, 3]
    with pytest.raises(ValueError):
        replace_corpus(*again, path, version_name(1))

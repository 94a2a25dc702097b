"""What the findings of round 4 were about: labels of whole headings, texts of labels piece by piece, bounded sequences, shards."""

import glob
import hashlib
from collections import Counter
from unittest import mock

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import marlstone.llm.collocations as m
from marlstone.operators import lexical as L
from marlstone.operators import retrieval as R

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_boundary_labels_are_whole_headings(spark, tmp_path):
    headings = ["ANNEX XII Ergänzungsbestimmungen", "Übersicht ÜBER ÄNDERUNGEN.", "x", "É" * 4000]
    spark.createDataFrame([(1, "\n".join([*headings, "a line of more words than three"]), "de", "s", 9)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["q_boundary_segments"](spark, str(tmp_path)).select("block_no", "stop", "label").collect())
    assert got == sorted(con.sql(f"SELECT block_no, stop, label FROM ({entry.oracle_sql()['q_boundary_segments']})").fetchall())
    assert [x for _, _, x in got] == ["Annex xii ergänzungsbestimmungen", "Übersicht über änderungen.", "X", "É" + "é" * 3999]


def test_long_texts_leave_a_writer_row_by_row(spark, tmp_path):
    """Cases of one label share a long text: the task that has them holds it once, and no writer gathers a hundred such rows."""
    chunks = spark.range(300).select(F.lit("a › b").alias("section_path"), "id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.sha2(F.concat("id", F.lit(" "), i), 512)), "").alias("text"))
    cases = spark.createDataFrame([(k, "a › b", [k], "ü") for k in range(7)] + [(8, None, None, None), (9, "none", [], "x")], "case_id long, label string, more array<int>, note string")
    found = R.discordant_worksheet(cases, chunks, ["id"])
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("parquet.block.size", 1 << 20)
    try:
        found.write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("parquet.block.size")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/out/*.parquet")]
    assert max(f.row_group(k).num_rows for f in files for k in range(f.num_row_groups) if f.row_group(k).total_byte_size > 1 << 20) == 1
    got = {r.case_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = "\n".join("".join(hashlib.sha512(f"{k} {i}".encode()).hexdigest() for i in range(61)) for k in range(300))
    assert len(got) == 9 and all(got[k].gold_text == whole and got[k].more == [k] and got[k].note == "ü" for k in range(7)) and got[8].gold_text is got[9].gold_text is None and got[9].more == []


def test_texts_in_order_whatever_the_batches(spark):
    chunks = [(p, d, k, f"{p}{d}.{k}" if (d + k) % 5 else None) for p in ("a › b", "a › c", "e › f") for d in range(12) for k in range(9)]
    cases = spark.createDataFrame([(1, "a › b"), (2, "a"), (3, "e › f"), (4, "e"), (5, "a › b"), (6, "")], "case_id long, label string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.case_id: r.gold_text for r in R.discordant_worksheet(cases, spark.createDataFrame(chunks, "section_path string, d long, k long, text string").repartition(5), ["d", "k"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = lambda *of: "\n".join(t for _, _, t in sorted((d, k, t) for p, d, k, t in chunks if p in of and t))
    assert got == {1: want("a › b"), 2: want("a › b", "a › c"), 3: want("e › f"), 4: want("e › f"), 5: want("a › b"), 6: None}


def test_rows_of_sequences_end_at_breaks_and_lose_no_pair(monkeypatch):
    monkeypatch.setattr(m, "ROW", 50)
    chance = np.random.default_rng(4)
    codes = np.where(chance.random(5000) < 0.1, m.NONE, chance.integers(0, 9, 5000))
    codes[2000:2400] = 7
    rows = [r for b in m._rows(codes) for r in m._arrays(b)]
    assert len(rows) > 60 and sorted(map(len, rows))[-2] < 50 + 60 and max(map(len, rows)) >= 400
    assert np.concatenate(rows).tolist() == m.shortened(codes).tolist()
    for k in range(2, 6):
        runs = lambda x: Counter(tuple(w) for w in (x[i : i + k].tolist() for i in range(len(x) - k + 1)) if m.NONE not in w)
        assert sum((runs(r) for r in rows), Counter()) == runs(codes)
    assert [r for b in m._rows(np.full(300, 3)) for r in m._arrays(b)][0].tolist() == [3] * 300 and not list(m._rows(np.array([1, m.NONE, 2])))


def test_stored_sequences_have_small_row_groups(spark):
    """Spark's reader takes a row group of long rows at once, so one group a file grows with the input's splits."""
    rows = m._kept(spark.range(120).select(F.transform(F.sequence(F.lit(1), F.lit(m.ROW)), lambda i: F.xxhash64("id", i)).alias("codes")).coalesce(1))
    groups = [f.row_group(k).column(0) for f in (pq.ParquetFile(p.removeprefix("file:")).metadata for p in rows.inputFiles()) for k in range(f.num_row_groups)]
    assert sum(g.num_values for g in groups) == 120 * m.ROW and max(g.total_uncompressed_size for g in groups) < 3 * m.GROUP


@pytest.mark.parametrize("few", [0, 3, 4000])
def test_terms_of_some_items_are_looked_up_either_way(few):
    """A term's holders are searched for few items, postings read for many; scores are added in one pass."""
    chance = np.random.default_rng(few)
    words = [[f"w{w}" for w in chance.integers(0, 30, chance.integers(0, 12))] for _ in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(words, pa.list_(pa.string()))], ["item_id", "words"])
    with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 0)):
        shard = L.Shard([{c: x.column(c)[0] for c in x.schema.names} for x in L._blocks_of_items(1)([batch])])
    terms, ids = {w: k for k, w in enumerate(shard.words.to_pylist())}, shard.ids.to_pylist()
    codes, weights = np.array([terms[f"w{k}"] for k in (3, 7, 21)]), np.array([1.5, 0.25, 4.0])
    want = np.array([sum(w * n / (1 + n) for t, w in zip(("w3", "w7", "w21"), weights) if (n := words[i].count(t))) for i in ids])
    items = np.sort(chance.choice(len(ids), few, replace=False))
    assert np.allclose(shard._looked_up(items, codes, weights), want[items])
    shard._add(codes, weights)
    assert np.allclose(shard.scores, want)

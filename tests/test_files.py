"""Files in and out."""

from datetime import datetime

import pytest

from marlstone.operators.text import locate_headings
from marlstone.sources import files


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p id='eli-subdivision'>\xc3\xa9")
    (tmp_path / "b.htm").write_bytes(b"<ix:header>caf\xe9")
    (tmp_path / "c.pdf").write_bytes(b"%PDF\x81")
    (tmp_path / "d.txt").write_bytes(b"no loader")
    (tmp_path / "e.html").write_bytes(b"probe")
    registry = spark.createDataFrame([("e.html", "probe-candidate"), ("a.html", "admitted")], "filename string, status string")
    rows = files.decoded(files.scan_directory(spark, str(tmp_path), registry)).collect()
    assert [(r.filename, r.loader, r.encoding) for r in rows] == [("a.html", "regulation", "utf-8"), ("b.htm", "filing", "cp1252"), ("c.pdf", "pdf", None)]
    assert rows[0].text.endswith("é") and rows[1].text.endswith("café") and rows[2].text is None


def test_question_sets_logs_and_ledgers(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "a?"}\n\n{"id": "2", "question": "b?"}\n')
    assert [r.question for r in files.question_set(spark, str(tmp_path / "q.jsonl")).orderBy("id").collect()] == ["a?", "b?"]
    (tmp_path / "a.json").write_text('{"n": 1,\n "cases": [{"id": "x", "rank": 2}, {"id": "y", "rank": null}]}')
    cases = files.artifact_cases(spark, str(tmp_path / "a.json"), "n int, cases array<struct<id: string, rank: int>>", "cases").collect()
    assert [(r.id, r["rank"]) for r in cases] == [("x", 2), ("y", None)]
    lines = spark.createDataFrame([('{"level": "INFO", "msg": "a\\nb", "status": 200}',), ("not json",)], "value string")
    assert [(r.level, r.msg, r.status) for r in files.log_lines(lines).collect()] == [("INFO", "a\nb", 200), (None, "not json", None)]
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 23)), (2, datetime(2024, 1, 2))], "id long, created_at timestamp")
    for _ in range(2):
        files.append_ledger(rows, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).where("day = '2024-01-02'").count() == 2
    files.write_once(rows, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_once(rows, str(tmp_path / "once"))
    files.write_manifest(rows, "{}", str(tmp_path / "manifest"))
    files.replace_corpus(rows, rows, str(tmp_path / "corpus"), "v1")
    assert spark.read.text(str(tmp_path / "corpus/v1/complete")).first()[0] == "v1"


def test_headings_are_found_in_order(spark):
    text = ["Intro", "body", "2. Long", "Title", "Intro", "3 Scope", "end"]
    lines = spark.createDataFrame([(1, k // 3, k, t) for k, t in enumerate(text)], "doc long, page_no long, line_no long, text string")
    outline = spark.createDataFrame([(1, 0, "Long title", 0), (1, 1, "Intro", 0), (1, 2, "Scope", 0), (1, 3, "Missing", 0)], "doc long, entry_no long, title string, page_no long")
    got = sorted((r.entry_no, r.start, r.end) for r in locate_headings(outline, lines).collect())
    assert got == [(0, 2, 4), (1, 4, 5), (2, 5, 6)]

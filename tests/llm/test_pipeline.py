"""The pipeline's stages one by one and together: edge cases, clashing names, planted documents, and life without it."""

import os
import random
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline as P

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PASSAGE = " ".join(f"benchword{k}" for k in range(30))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, _q_pattern long, _hit_runs int, _row int, _src string"


def prose(k, sentences=8):
    rnd, out = random.Random(k), []
    for _ in range(sentences):
        words = [rnd.choice(("the", "of", "and", "in", "a", "to", "was")) if n % 2 else "".join(rnd.choices("aeioubdklmnrst", k=rnd.randrange(3, 9))) for n in range(rnd.randrange(8, 15))]
        out.append(" ".join(words).capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, prose(k), "en", ("web", "book", None)[k % 3]) for k in range(40)]
    rows += [(100, prose(3), "en", "web"), (101, prose(4) + " End.", "en", "book")]  # an exact copy and a near one
    rows += [(None, prose(200), "en", "web"), (None, prose(201), "en", "web"), (None, prose(201), "en", "web")]
    rows += [(300, None, None, None), (301, "", "", ""), (302, "spam " * 300, "en", "web"), (303, "!!! ### $$$", "en", "web")]
    rows += [(400, PASSAGE, "en", "web"), (401, prose(400, 120) + ' ' + PASSAGE + " " + prose(401), "en", "book"), (402, prose(500) + " x" * 5, "en", "web")]
    rows += [(500, prose(600), "en", "web"), (500, prose(700), "en", "web")]  # one id, two texts
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, 8, 9, 10, "clash") for r in rows], SCHEMA).repartition(3)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert {(r._id, r._q_pattern, r._hit_runs, r._row, r._src) for r in rows} == {(7, 8, 9, 10, "clash")}
        seen[name] = rows
    ids = {name: sorted(r.doc_id for r in rows if r.doc_id is not None) for name, rows in seen.items()}
    clean = set(range(40))
    assert clean <= set(ids["quality_rules"]) and not {300, 301, 302, 303} & set(ids["quality_rules"])
    near = seen["near_duplicates"]
    assert clean <= set(ids["near_duplicates"]) and not {100, 101} & set(ids["near_duplicates"])
    assert sorted(r.text for r in near if r.doc_id is None) == [prose(200), prose(201)]
    assert ids["near_duplicates"].count(500) == 2
    clear = {r.doc_id: r for r in seen["decontaminate"]}
    assert 400 not in clear and "benchword" not in clear[401].text and clear[401].n_chars == len(clear[401].text)
    assert clean <= set(ids["decontaminate"])
    mixed = seen["mix_to_weights"]
    assert {r.doc_id for r in mixed} <= set(clear) and max(ids["mix_to_weights"].count(k) for k in set(ids["mix_to_weights"])) <= 2


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_take_small_batches(spark):
    """Several MB of long texts in one partition reach a stage's workers in batches of 2 MB and a row."""
    key, row = "spark.sql.execution.arrow.maxBytesPerBatch", 50_000

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n_rows": [b.num_rows], "n_bytes": [b.nbytes]})

    before = spark.conf.get(key)
    spark.conf.set(key, 8 << 20)
    try:
        docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", f"repeat('x', {row}) AS text")
        stage = P._stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n_rows long, n_bytes long"))
        found = stage(spark, docs, "").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r.n_rows for r in found) == 200
    assert max(r.n_bytes for r in found) <= (2 << 20) + 2 * row


def test_the_rest_works_without_this_subpackage(tmp_path):
    """A copy without the folders of these operators still registers and imports everything else."""
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(f"{copy}/marlstone/llm")
    shutil.rmtree(f"{copy}/tests/llm")
    script = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(n == 'pipeline' or n.startswith('op') for n in q))"
    for also in (None, "corpus_pipeline.py"):
        if also:
            os.remove(f"{copy}/{also}")
        out = subprocess.run([sys.executable, "-c", script], cwd=copy, env={**os.environ, "PYTHONPATH": copy}, capture_output=True, text=True, timeout=120)
        n, sql, own = map(int, out.stdout.split())
        assert n > 130 and sql > 125 and own == 0

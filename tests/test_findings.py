"""What a reviewer's findings were about: odd letters and references, closed forms, texts of labels."""

import math

import duckdb

import __spark_entry__ as entry
from marlstone.functions.statistics import _beta_tail, clopper_pearson, removals_survived
from marlstone.operators import retrieval as R
from marlstone.operators import sections as S
from pyspark.sql import functions as F


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables of (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df, rel = entry.queries()[name](spark, str(folder)), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    return sorted(map(tuple, df.select(columns).collect()), key=str), sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=str)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_boundary_labels_have_one_capital(spark, tmp_path):
    words = ["ßtraße.", "ŉa", "ὐa", "ǆx", "AİΣ", "école Ü", "a line of more words than three"]
    got, want = against_sql(spark, tmp_path, "q_boundary_segments", documents=(DOCUMENTS, [(1, "\n".join(words), "de", "s", 9)]))
    assert got == want and len(got) == 6 and ("ẞtraße" in {r[2] for r in got})


def test_references_without_a_semicolon(spark, tmp_path):
    html = "<title>a &amp;&amp</title><p>&copy 1 &middot; &amp;copy; &quot</p><p>&quo</p>"
    got, want = against_sql(spark, tmp_path, "q_html_blocks", pages=("page_id long, url string, html string", [(1, "u", html)]))
    assert got == want == [(0, 1, "a &&"), (1, 1, '© 1 · &copy; "'), (2, 1, "&quo")]


def exact_p(b, c):
    return 1.0 if b + c == 0 else min(1.0, 2 * sum(math.comb(b + c, j) for j in range(min(b, c) + 1)) / 2 ** (b + c))


def test_removals_survived(spark):
    rows = [(b, c) for b in range(0, 25, 2) for c in range(50)]
    got = spark.createDataFrame(rows, "b long, c long").select("b", "c", removals_survived(F.col("b"), F.col("c")).alias("s")).collect()
    for r in got:
        assert r.s == max((x for x in range(r.c + 1) if r.c - x > r.b and round(exact_p(r.b, r.c - x), 9) < 0.05), default=None)
    #: steps that grow with the product of both would not end
    least = 200_000 - spark.createDataFrame([(100_000, 200_000)], "b long, c long").select(removals_survived(F.col("b"), F.col("c")).alias("s")).first().s
    below, at = (2 * (1 - _beta_tail(100_001, 100_000 + c, 0.5)) for c in (least - 1, least))
    assert at < 0.05 <= below


def test_intervals_of_large_counts(spark):
    """A bound is where the tail is alpha / 2; by the sum over all terms this took minutes."""
    rows = spark.createDataFrame([(150_000, 1_000_000), (1, 2_000_000), (1_999_999, 2_000_000)], "x long, n long").select(clopper_pearson()("x", "n").alias("i")).collect()
    assert abs(rows[0].i.low - 0.149300732) < 1e-6 and abs(rows[0].i.high - 0.150701343) < 1e-6
    assert abs(rows[1].i.low * 2_000_000 - 0.0253178) < 1e-4 and abs((1 - rows[2].i.high) * 2_000_000 - 0.0253178) < 1e-4


def test_a_label_is_put_together_once(spark):
    """Cases of one label share its text: the rows that are gathered do not grow with the cases."""
    chunks = spark.createDataFrame([("a › b", k, f"t{k}") for k in range(40)] + [("a › c", 1, "c")], "section_path string, k long, text string")
    cases = spark.createDataFrame([(k, "a › b") for k in range(30)] + [(98, "a"), (99, "none"), (100, None)], "case_id long, label string")
    found = R.discordant_worksheet(cases, chunks, ["k"])
    got = {r.case_id: r.gold_text for r in found.collect()}
    whole = "\n".join(f"t{k}" for k in range(40))
    assert {got[k] for k in range(30)} == {whole} and got[99] is None and got[100] is None and got[98].count("\n") == 40 and len(got) == 33


def test_blocks_of_vectors_stay_small(spark):
    q = spark.range(3).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    c = spark.range(2000).select(F.col("id").alias("item_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        got = R.vector_topk(q, c, 1, but_itself=True)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= R.PAIRS_BYTES
        assert {(r.query_id, r.item_id) for r in got.collect()} == {(0, 1), (1, 2), (2, 3)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_pages_are_scanned_once_and_dealt_once(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string")
    blocks = S.html_blocks(S.without_subtrees(S.page_nodes(pages)))
    for made in (blocks, S.filing_sections(blocks), S.filing_dropped_tables(blocks), S.regulation_sections(S.page_nodes(pages)), S.annex_sections(S.page_nodes(pages))):
        plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


def test_plain_tags_and_raw_content():
    html = "<P>a<script>if (a<b) </p> x</script><title>t</title><td>c</TD></p>"
    assert [(n[4], n[13]) for n in S.scanned(html)] == [("p", None), (None, "a"), ("script", None), (None, "if (a<b) </p> x"), ("title", None), (None, "t"), ("td", None), (None, "c")]

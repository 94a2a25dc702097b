"""Rules of registries, cases and provenance on hand-made rows."""

from pyspark.sql import functions as F

from marlstone.operators import contracts as C
from marlstone.operators.ledger import worst_cost

REGISTRY = "id string, status string, rung int, loader string, filename string, url string, min_bytes long, title string, doc_label string, doc_type string, source_uri string"


def broken(df):
    return sorted(((r.key or "", r.rule) for r in df.collect()))


def test_registries(spark):
    good = ("a", "ingested", 0, "nist_pdf", "a.pdf", "u", 10, "T", "L", "standard", "s:a")
    change = lambda **new: tuple({**dict(zip(C.REGISTRY_FIELDS, good)), **new}[c] for c in C.REGISTRY_FIELDS)
    row = lambda r: dict(zip(C.REGISTRY_FIELDS, r))
    rows = [good, change(id="b", filename="b", source_uri="s:b", loader="word"), change(id="c", filename="c", source_uri="s:c", doc_type=None, min_bytes=0), change(id="d", source_uri="s:d", status="new"), change(id="e", filename="e", source_uri="s:b"), change(id="e", filename="f", source_uri="s:f")]
    fields = [c.split()[0] for c in REGISTRY.split(", ")]
    df = spark.createDataFrame([tuple(row(r)[c] for c in fields) for r in rows], REGISTRY)
    assert broken(C.registry_violations(df)) == sorted([("b", "unknown loader"), ("c", "doc_type missing"), ("c", "min_bytes not positive"), ("d", "unknown status"), ("a,d", "duplicate filename"), ("b,e", "duplicate source_uri"), ("e", "duplicate id")])
    assert broken(C.registry_violations(df.where("false"))) == [("", "no documents")]


def test_cases(spark):
    schema = "id string, shape string, document string, question string, expected_section_prefix string, also_contains string, label_reason string"
    rows = [
        ("1", "natural-language", "A", "What flies?", "A › x", None, "why"), ("2", "cross-section", "A", "Both?", "A › x", "A › y", "why"), ("3", "natural-language", "A", "See ARTICLE 5?", "A › x", None, "why"),
        ("4", "cross-section", "A", "One?", "A › x", None, " "), ("5", "cross-section", "A", "Same?", "A › x", "A › x", "why"), ("6", "citation-anchored", "A", "Article 6?", "B › x", "B › y", "why"), ("7", "natural-language", "C", None, "C › x", None, "why"), ("1", "natural-language", "A", "Again?", "A › z", None, "why"),
    ]
    roots = spark.createDataFrame([("A", "A › "), ("B", "B › ")], "document string, root string")
    df = spark.createDataFrame(rows, schema)
    assert broken(C.case_violations(df, roots)) == sorted([
        ("3", "plain words that cite"), ("4", "label_reason blank"), ("4", "second path missing"), ("5", "both paths the same"), ("6", "path of another document"), ("6", "second path of another document"), ("6", "second path of one section"),
        ("7", "question blank"), ("7", "unknown document"), ("1", "repeated id"),
    ])
    others = spark.createDataFrame([("2", "x"), ("z", "  what FLIES? ")], "id string, question string")
    assert sorted(map(tuple, C.leaked_cases(df, others).collect())) == [("1", "question"), ("2", "id")]


def test_provenance(spark):
    rows = [("1", "d", 1, 2, 5, 9), ("2", None, 1, 2, 5, 9), ("3", "d", 7, 10, 5, 9), ("4", "d", 7, 8, 5, 9), ("5", " ", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, source_document string, authored_at int, edited_at int, retrieved_at int, results_at int").withColumn("set", F.lit("s"))
    assert {r.id: (r.reason, r.before_retrieval) for r in C.provenance(df).collect()} == {"1": (None, True), "2": ("no source document", True), "3": ("edited after results", False), "4": (None, False), "5": ("no source document", False)}
    assert [tuple(r) for r in C.provenance_report(df, "set").collect()] == [("s", 5, 1, 2, 0.5)]


def test_formats(spark):
    sections = spark.createDataFrame([(1, ["a"]), (1, ["a", "b"]), (2, ["a"]), (3, ["a", "b", "c"])], "doc int, heading_path array<string>")
    chunks = spark.createDataFrame([(1,), (1,), (1,), (2,)], "doc int")
    got = {r.doc: tuple(r)[1:] for r in C.format_probe(sections, chunks, spark.createDataFrame([(1, 2), (2, 0)], "doc int, estimated_chunks int")).collect()}
    assert got == {1: (2, 3, 2, True, 0.5), 2: (1, 1, 1, False, None), 3: (1, 0, 3, True, None)}


def test_the_most_a_prompt_can_cost(spark):
    price = lambda x: F.lit(x).cast("decimal(18,6)")
    df = spark.createDataFrame([("é" * 10,), (None,)], "prompt string").select(worst_cost(F.col("prompt"), "ab", price(3), price(15), 100).alias("c"))
    assert [float(r.c) for r in df.collect()] == [round(((2 + 20 + 64) * 3 + 100 * 15) / 1e6, 6), 0.0]

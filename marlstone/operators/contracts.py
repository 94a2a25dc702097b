"""Rule tables: every violation is a row (key, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column], unique: tuple[str, ...] = ()) -> DataFrame:
    """One row a row and rule that it breaks; values of `unique` columns must not repeat. Row rules take one pass."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules.items()))) if rules else F.array().cast("array<string>")
    out = rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))
    for c in unique:
        repeated = rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(f"_n > 1 and {c} is not null").select(F.col(c).cast("string").alias("key"), F.lit(f"repeated {c}").alias("rule"))
        out = out.union(repeated)
    return out


def reconcile(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns whose values differ by key, null-safe; keys that one side lacks differ in every column."""
    a, b = (t.select(key, *(F.col(c).cast("string").alias(f"_{s}_{c}") for c in columns)) for t, s in ((left, "a"), (right, "b")))
    differs = F.array_compact(F.array(*(F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), c) for c in columns)))
    return a.join(b, key, "full").select(key, F.explode(differs).alias("column"))


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


#: What a registry's fields may say, and the fields that every document of it has.
LOADERS = ("nist_pdf", "eurlex_html", "edgar_10k")
DOC_TYPES = ("standard", "regulation", "filing")
STATUSES = ("ingested", "probe-candidate")
REGISTRY_FIELDS = ("id", "status", "rung", "loader", "filename", "url", "min_bytes", "title", "doc_label", "doc_type", "source_uri")
#: What a question that cites looks like.
CITATION_MARKS = ("article ", "annex ", "item 1", "item 5", "item 7", "item 9", "recital ")


def registry_violations(registry: DataFrame) -> DataFrame:
    """(key, rule) of a registry of documents: fields that are missing, values that no loader, kind or state has, sizes of
    nothing, and ids, file names and uris that stand twice, each named by the documents that share them. A registry
    without documents breaks a rule of its own, under no key."""
    missing = {f"{c} missing": F.col(c).isNull() for c in REGISTRY_FIELDS}
    unknown = {f"unknown {c}": ~F.col(c).isin(*some) for c, some in (("loader", LOADERS), ("doc_type", DOC_TYPES), ("status", STATUSES))}
    rows = violations(registry, "id", missing | unknown | {"min_bytes not positive": F.col("min_bytes") <= 0})
    for c in ("id", "filename", "source_uri"):
        shared = registry.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ",").alias("key")).where("_n > 1")
        rows = rows.unionByName(shared.select("key", F.lit(f"duplicate {c}").alias("rule")))
    none = registry.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(None).cast("string").alias("key"), F.lit("no documents").alias("rule"))
    return rows.unionByName(none)


def case_violations(cases: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rule) of a set of cases (id, shape, document, question, expected_section_prefix, also_contains, label_reason),
    with the root of each document's paths (document, root).

    A case says what it asks and why its label is right; its paths are rooted in its own document; only a question across
    sections names two paths, and different ones; a question in plain words doesn't cite; ids stand once."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rows = cases.join(roots.select(F.col("document").alias("_document"), F.col("root").alias("_root")), F.col("document") == F.col("_document"), "left")
    rooted = lambda c: F.col("_root").isNotNull() & ~F.col(c).startswith(F.col("_root"))
    across, asked = F.col("shape") == "cross-section", F.lower("question")
    rules = {f"{c} blank": blank(c) for c in ("question", "label_reason", "expected_section_prefix")} | {
        "unknown document": F.col("_root").isNull(),
        "path of another document": rooted("expected_section_prefix"),
        "second path of another document": rooted("also_contains"),
        "second path missing": across & F.col("also_contains").isNull(),
        "both paths the same": across & (F.col("also_contains") == F.col("expected_section_prefix")),
        "second path of one section": ~across & F.col("also_contains").isNotNull(),
        "plain words that cite": (F.col("shape") == "natural-language") & reduce(Column.__or__, (F.contains(asked, F.lit(m)) for m in CITATION_MARKS)),
    }
    return violations(rows, "id", rules, ("id",))


def leaked_cases(cases: DataFrame, others: DataFrame) -> DataFrame:
    """(id, reason): cases whose id, or whose question but for case and outer blanks, stands in another set."""
    plain = F.lower(F.trim("question"))
    by_id = cases.join(others.select("id").distinct(), "id", "left_semi").select("id", F.lit("id").alias("reason"))
    by_text = cases.select("id", plain.alias("_q")).join(others.select(plain.alias("_q")).distinct(), "_q", "left_semi").select("id", F.lit("question").alias("reason"))
    return by_id.union(by_text).distinct()


def provenance(cases: DataFrame) -> DataFrame:
    """Cases (id, source_document, authored_at, edited_at, retrieved_at, results_at) with `reason`, why a case is rejected
    (null for those that count), and `before_retrieval`, whether it was written before anything was retrieved for it."""
    reason = F.when(F.coalesce(F.trim("source_document"), F.lit("")) == "", "no source document").when(F.col("edited_at") > F.col("results_at"), "edited after results")
    return cases.withColumn("reason", reason).withColumn("before_retrieval", F.coalesce(F.col("authored_at") < F.col("retrieved_at"), F.lit(False)))


def provenance_report(cases: DataFrame, by: str) -> DataFrame:
    """Of each group: cases, those rejected by reason, and the share of the rest that was written before retrieval."""
    n = lambda c: F.count(F.when(c, 1))
    rows = provenance(cases).groupBy(by)
    return rows.agg(F.count("*").alias("n"), n(F.col("reason") == "edited after results").alias("edited_after"), n(F.col("reason") == "no source document").alias("without_source"), F.avg(F.when(F.col("reason").isNull(), F.col("before_retrieval").cast("int"))).alias("authored_before"))


def format_probe(sections: DataFrame, chunks: DataFrame, estimates: DataFrame) -> DataFrame:
    """What a candidate document's format gives: sections (doc, heading_path), chunks (doc) and estimates (doc,
    estimated_chunks) to doc, sections, chunks, deepest (parts of the longest path), hierarchy_ok (two at least) and
    deviation, the share by which the chunks differ from the estimate; null without one."""
    deep = sections.groupBy("doc").agg(F.count("*").alias("sections"), F.max(F.size("heading_path")).alias("deepest"))
    rows = deep.join(chunks.groupBy("doc").agg(F.count("*").alias("chunks")), "doc", "left").join(estimates, "doc", "left")
    n = F.coalesce("chunks", F.lit(0))
    off = F.when(F.col("estimated_chunks") > 0, n / F.col("estimated_chunks") - 1)
    return rows.select("doc", "sections", n.alias("chunks"), "deepest", (F.col("deepest") >= 2).alias("hierarchy_ok"), off.alias("deviation"))

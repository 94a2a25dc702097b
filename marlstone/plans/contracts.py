"""Queries of data contracts and backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import contracts as C
from marlstone.plans.base import query
from marlstone.sources.tables import QUERY_LOG_SQL, query_log, table

#: a registry of documents, made of suppliers
REGISTRY_SQL = """registry AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE 'file-' || (s_suppkey % 95) || '.html' END AS filename,
    CASE WHEN s_suppkey % 13 = 0 THEN 'loose' WHEN s_suppkey % 5 = 0 THEN 'probe-candidate' ELSE 'admitted' END AS status, s_nationkey % 3 AS rung, CASE WHEN s_suppkey % 29 = 0 THEN 0 ELSE 1000 END AS min_bytes FROM supplier)"""


def registry(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 17 != 0, F.concat(F.lit("file-"), (k % 95).cast("string"), F.lit(".html"))).alias("filename"),
        F.when(k % 13 == 0, "loose").when(k % 5 == 0, "probe-candidate").otherwise("admitted").alias("status"), (F.col("s_nationkey") % 3).cast("long").alias("rung"), F.when(k % 29 == 0, 0).otherwise(1000).alias("min_bytes"),
    )


FULL_REGISTRY_SQL = REGISTRY_SQL + """, full_registry AS (SELECT id, filename, min_bytes, rung, CASE status WHEN 'admitted' THEN 'ingested' ELSE status END AS status, ['nist_pdf', 'eurlex_html', 'edgar_10k', 'word'][id % 4 + 1] AS loader,
        CASE WHEN id % 31 <> 0 THEN ['standard', 'regulation', 'filing'][id % 3 + 1] ELSE 'letter' END AS doc_type, 'https://x/' || id AS url, CASE WHEN id % 37 <> 0 THEN 'T' || id END AS title, 'L' || id AS doc_label, 'urn:' || id % 83 AS source_uri FROM registry)"""


@query("q_registry_violations", f"""WITH {FULL_REGISTRY_SQL},
    b AS (SELECT id::VARCHAR AS key, unnest(list_filter([CASE WHEN filename IS NULL THEN 'filename missing' END, CASE WHEN title IS NULL THEN 'title missing' END, CASE WHEN loader = 'word' THEN 'unknown loader' END, CASE WHEN doc_type = 'letter' THEN 'unknown doc_type' END,
        CASE WHEN status NOT IN ('ingested', 'probe-candidate') THEN 'unknown status' END, CASE WHEN min_bytes <= 0 THEN 'min_bytes not positive' END], lambda x: x IS NOT NULL)) AS rule FROM full_registry)
    SELECT * FROM b UNION ALL SELECT string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR), 'duplicate filename' FROM full_registry WHERE filename IS NOT NULL GROUP BY filename HAVING count(*) > 1
    UNION ALL SELECT string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR), 'duplicate source_uri' FROM full_registry GROUP BY source_uri HAVING count(*) > 1""")
def q_registry_violations(spark, d):
    k = F.col("id")
    one_of = lambda *some: F.element_at(F.array(*map(F.lit, some)), (k % len(some) + 1).cast("int"))
    rows = registry(spark, d).withColumns({
        "status": F.when(F.col("status") == "admitted", "ingested").otherwise(F.col("status")), "loader": one_of("nist_pdf", "eurlex_html", "edgar_10k", "word"), "doc_type": F.when(k % 31 != 0, one_of("standard", "regulation", "filing")).otherwise("letter"),
        "url": F.concat(F.lit("https://x/"), k.cast("string")), "title": F.when(k % 37 != 0, F.concat(F.lit("T"), k.cast("string"))), "doc_label": F.concat(F.lit("L"), k.cast("string")), "source_uri": F.concat(F.lit("urn:"), (k % 83).cast("string")),
    })
    return C.registry_violations(rows)


@query("q_probe_exclusion", f"WITH {REGISTRY_SQL} SELECT page_id FROM pages WHERE 'file-' || (page_id % 95) || '.html' NOT IN (SELECT filename FROM registry WHERE status = 'probe-candidate' AND filename IS NOT NULL)")
def q_probe_exclusion(spark, d):
    name = F.concat(F.lit("file-"), (F.col("page_id") % 95).cast("string"), F.lit(".html"))
    probe = registry(spark, d).where("status = 'probe-candidate'").select("filename")
    return table(spark, d, "pages").withColumn("filename", name).join(probe, "filename", "left_anti").select("page_id")


@query("q_registry_rung", f"WITH {REGISTRY_SQL} SELECT id, status FROM registry WHERE rung = 0")
def q_registry_rung(spark, d):
    return registry(spark, d).where("rung = 0").select("id", "status")


@query("q_registry_reconcile", """WITH a AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier WHERE s_suppkey % 10 <> 0), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'other' ELSE s_name END AS name, CASE WHEN s_suppkey % 11 <> 0 THEN s_nationkey::VARCHAR END AS nation FROM supplier WHERE s_suppkey % 9 <> 0),
    j AS (SELECT coalesce(a.id, b.id) AS id, a.name AS n1, b.name AS n2, a.nation AS m1, b.nation AS m2 FROM a FULL JOIN b ON a.id = b.id)
    SELECT id, 'name' AS "column" FROM j WHERE n1 IS DISTINCT FROM n2 UNION ALL SELECT id, 'nation' FROM j WHERE m1 IS DISTINCT FROM m2""")
def q_registry_reconcile(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    b = s.where("id % 9 <> 0").select("id", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 11 != 0, F.col("nation")).alias("nation"))
    return C.reconcile(s.where("id % 10 <> 0"), b, "id", ["name", "nation"])


@query("q_doc_type_backfill", "SELECT page_id, CASE WHEN url LIKE '%example.org%' THEN 'standard' WHEN url LIKE 'https://m.%' THEN 'filing' WHEN url LIKE '%/fr/%' THEN 'regulation' ELSE 'unknown' END AS doc_type FROM pages")
def q_doc_type_backfill(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(u.contains("example.org"), "standard").when(u.like("https://m.%"), "filing").when(u.contains("/fr/"), "regulation").otherwise("unknown").alias("doc_type"))


@query("q_identity_qualify", "SELECT event_id, CASE WHEN contains(x, ':') THEN x ELSE 'north:' || x END AS qualified, replace(CASE WHEN contains(x, ':') THEN x ELSE 'north:' || x END, 'north:', '') AS bare FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'south:' || event_type END AS x FROM events)")
def q_identity_qualify(spark, d):
    x = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit("south:"), "event_type"))
    qualified = F.when(x.contains(":"), x).otherwise(F.concat(F.lit("north:"), x))
    return table(spark, d, "events").select("event_id", qualified.alias("qualified"), F.regexp_replace(qualified, "^north:", "").alias("bare"))


@query("q_sentinel_backfill", "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, 'unknown') AS verdict, coalesce(CASE WHEN event_id % 5 <> 0 THEN 'eval' END, 'visitor') AS source, CASE WHEN event_id % 7 <> 0 THEN event_type END AS provisional FROM events")
def q_sentinel_backfill(spark, d):
    """Sentinels for missing values; a missing provisional verdict stays missing."""
    some = lambda m, v: F.when(F.col("event_id") % m != 0, v)
    rows = table(spark, d, "events").select("event_id", some(3, F.col("event_type")).alias("verdict"), some(5, F.lit("eval")).alias("source"), some(7, F.col("event_type")).alias("provisional"))
    return rows.fillna({"verdict": "unknown", "source": "visitor"})


@query("q_message_leak", "SELECT conv_id, turn FROM (SELECT *, text || CASE WHEN conv_id % 9 = 0 THEN ' costs 1.25' WHEN conv_id % 9 = 1 THEN ' $' ELSE '' END AS m FROM conversations) WHERE contains(m, '$') OR regexp_matches(m, '\\d+\\.\\d{2}')")
def q_message_leak(spark, d):
    m = F.concat("text", F.when(F.col("conv_id") % 9 == 0, " costs 1.25").when(F.col("conv_id") % 9 == 1, " $").otherwise(""))
    return table(spark, d, "conversations").where(m.contains("$") | m.rlike(r"\d+\.\d{2}")).select("conv_id", "turn")


#: cases made of documents: what they ask, where the answer stands, when they were written
CASES_SQL = """cases AS (SELECT 'c' || (doc_id - CASE WHEN doc_id % 71 = 0 THEN 1 ELSE 0 END) AS id, source AS document, ['natural-language', 'cross-section', 'citation-anchored'][doc_id % 3 + 1] AS shape,
        CASE WHEN doc_id % 17 = 0 THEN '  ' WHEN doc_id % 23 = 0 THEN 'What does Article ' || doc_id || ' say?' ELSE text END AS question, CASE WHEN doc_id % 19 <> 0 THEN lang END AS label_reason,
        CASE WHEN doc_id % 13 = 0 THEN 'elsewhere' ELSE source END || ' › Part ' || doc_id % 4 AS expected_section_prefix, CASE WHEN doc_id % 3 = 1 AND doc_id % 4 <> 2 OR doc_id % 29 = 0 THEN source || ' › Part ' || doc_id % 8 END AS also_contains,
        CASE WHEN doc_id % 11 <> 0 THEN source END AS source_document, n_chars AS authored_at, n_chars + doc_id % 40 AS edited_at, 900 + doc_id % 300 AS retrieved_at, n_chars + 30 AS results_at FROM documents)"""


def cases(spark, d):
    k, when = F.col("doc_id"), F.when
    part = lambda m: F.concat(F.lit(" › Part "), (k % m).cast("string"))
    return table(spark, d, "documents").select(
        F.concat(F.lit("c"), (k - when(k % 71 == 0, 1).otherwise(0)).cast("string")).alias("id"), F.col("source").alias("document"), F.element_at(F.array(*map(F.lit, ("natural-language", "cross-section", "citation-anchored"))), (k % 3 + 1).cast("int")).alias("shape"),
        when(k % 17 == 0, "  ").when(k % 23 == 0, F.concat(F.lit("What does Article "), k.cast("string"), F.lit(" say?"))).otherwise(F.col("text")).alias("question"), when(k % 19 != 0, F.col("lang")).alias("label_reason"),
        F.concat(when(k % 13 == 0, "elsewhere").otherwise(F.col("source")), part(4)).alias("expected_section_prefix"), when(((k % 3 == 1) & (k % 4 != 2)) | (k % 29 == 0), F.concat("source", part(8))).alias("also_contains"),
        when(k % 11 != 0, F.col("source")).alias("source_document"), F.col("n_chars").alias("authored_at"), (F.col("n_chars") + k % 40).alias("edited_at"), (900 + k % 300).alias("retrieved_at"), (F.col("n_chars") + 30).alias("results_at"),
    )


@query("q_case_violations", f"""WITH {CASES_SQL}, r AS (SELECT DISTINCT source AS document, source || ' › ' AS root FROM documents WHERE source IS NOT NULL), j AS (SELECT cases.*, root, shape = 'cross-section' AS across FROM cases LEFT JOIN r USING (document)),
    b AS (SELECT id AS key, unnest(list_filter([CASE WHEN trim(coalesce(question, '')) = '' THEN 'question blank' END, CASE WHEN trim(coalesce(label_reason, '')) = '' THEN 'label_reason blank' END, CASE WHEN trim(coalesce(expected_section_prefix, '')) = '' THEN 'expected_section_prefix blank' END,
        CASE WHEN root IS NULL THEN 'unknown document' END, CASE WHEN NOT starts_with(expected_section_prefix, root) THEN 'path of another document' END, CASE WHEN NOT starts_with(also_contains, root) THEN 'second path of another document' END,
        CASE WHEN across AND also_contains IS NULL THEN 'second path missing' END, CASE WHEN across AND also_contains = expected_section_prefix THEN 'both paths the same' END, CASE WHEN NOT across AND also_contains IS NOT NULL THEN 'second path of one section' END,
        CASE WHEN shape = 'natural-language' AND regexp_matches(lower(question), 'article |annex |item 1|item 5|item 7|item 9|recital ') THEN 'plain words that cite' END], lambda x: x IS NOT NULL)) AS rule FROM j)
    SELECT * FROM b UNION ALL SELECT id, 'repeated id' FROM cases GROUP BY id HAVING count(*) > 1""")
def q_case_violations(spark, d):
    roots = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("document"), F.concat("source", F.lit(" › ")).alias("root")).distinct()
    return C.case_violations(cases(spark, d), roots)


@query("q_leaked_cases", f"""WITH {CASES_SQL}, o AS (SELECT 'c' || (doc_id * 7) AS id, '  ' || translate(text, 'aeiou', 'AEIOU') || ' ' AS question FROM documents WHERE doc_id % 5 = 0)
    SELECT DISTINCT id, 'id' AS reason FROM cases WHERE id IN (SELECT id FROM o) UNION ALL SELECT DISTINCT id, 'question' FROM cases WHERE lower(trim(question, ' ')) IN (SELECT lower(trim(question, ' ')) FROM o WHERE question IS NOT NULL)""")
def q_leaked_cases(spark, d):
    """Every fifth document's text, with capital vowels, as another set."""
    others = table(spark, d, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("c"), (F.col("doc_id") * 7).cast("string")).alias("id"), F.concat(F.lit("  "), F.translate("text", "aeiou", "AEIOU"), F.lit(" ")).alias("question"))
    return C.leaked_cases(cases(spark, d), others)


PROVENANCE_SQL = CASES_SQL + """, p AS (SELECT *, CASE WHEN coalesce(source_document, '') = '' THEN 'no source document' WHEN edited_at > results_at THEN 'edited after results' END AS reason, authored_at < retrieved_at AS before_retrieval FROM cases)"""


@query("q_case_provenance", f"""WITH {PROVENANCE_SQL} SELECT document, count(*) AS n, count(*) FILTER (reason = 'edited after results') AS edited_after, count(*) FILTER (reason = 'no source document') AS without_source, avg(before_retrieval::INT) FILTER (reason IS NULL) AS authored_before FROM p GROUP BY document""")
def q_case_provenance(spark, d):
    return C.provenance_report(cases(spark, d), "document")


@query("q_rejected_cases", f"WITH {PROVENANCE_SQL} SELECT id, reason, before_retrieval FROM p WHERE reason IS NOT NULL")
def q_rejected_cases(spark, d):
    return C.provenance(cases(spark, d)).where("reason is not null").select("id", "reason", "before_retrieval")


#: measured figures, made of line items: n, value, its interval, what it decides
FIGURES_SQL = "figures AS (SELECT o_orderkey AS id, o_orderkey % 50 AS n, o_orderkey % 53 AS decided, (o_orderkey % 101) / 100 AS value, (o_orderkey % 89) / 100 AS low, (o_orderkey % 97) / 90 AS high, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'claim' END AS claim FROM orders)"


def figures(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), (k % 50).alias("n"), (k % 53).alias("decided"), ((k % 101) / 100).alias("value"), ((k % 89) / 100).alias("low"), ((k % 97) / 90).alias("high"), F.when(k % 31 == 0, "").otherwise("claim").alias("claim"))


@query("q_figure_violations", f"""WITH {FIGURES_SQL} SELECT id::VARCHAR AS key, 'no claim' AS rule FROM figures WHERE claim = '' UNION ALL SELECT id::VARCHAR, 'decided above n' FROM figures WHERE decided > n UNION ALL SELECT id::VARCHAR, 'value outside' FROM figures WHERE NOT value BETWEEN low AND high""")
def q_figure_violations(spark, d):
    return C.violations(figures(spark, d), "id", {"no claim": F.col("claim") == "", "decided above n": F.col("decided") > F.col("n"), "value outside": ~F.col("value").between(F.col("low"), F.col("high"))})


@query("q_prereg_deviations", """WITH a AS (SELECT p_partkey AS id, unnest(['test', 'sides', 'alpha']) AS field, unnest([p_brand, p_size::VARCHAR, p_type]) AS planned, unnest([CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_brand END, p_size::VARCHAR, CASE WHEN p_partkey % 15 = 0 THEN 'y' ELSE p_type END]) AS used FROM part)
    SELECT id, field FROM a WHERE planned <> used AND NOT (field = 'alpha' AND id % 30 = 0)""")
def q_prereg_deviations(spark, d):
    """Fields that differ from the registered ones without a recorded deviation."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    rows = p.select(k.alias("id"), F.col("p_brand").alias("test_a"), F.col("p_size").cast("string").alias("sides_a"), F.col("p_type").alias("alpha_a"), F.when(k % 6 == 0, "x").otherwise(F.col("p_brand")).alias("test_b"), F.col("p_size").cast("string").alias("sides_b"), F.when(k % 15 == 0, "y").otherwise(F.col("p_type")).alias("alpha_b"))
    long = rows.select("id", F.expr("stack(3, 'test', test_a, test_b, 'sides', sides_a, sides_b, 'alpha', alpha_a, alpha_b) as (field, planned, used)"))
    recorded = p.where(k % 30 == 0).select(k.alias("id"), F.lit("alpha").alias("field"))
    return long.where("planned <> used").join(recorded, ["id", "field"], "left_anti").select("id", "field")


@query("q_artifact_consistency", "WITH o AS (SELECT l_orderkey, sum(l_quantity) AS parts, count(DISTINCT l_returnflag) AS levers FROM lineitem GROUP BY 1) SELECT l_orderkey AS id, parts <> round(o_totalprice / 5000) AS sum_differs, levers > 1 AS levers_differ FROM o JOIN orders ON o_orderkey = l_orderkey")
def q_artifact_consistency(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("parts"), F.countDistinct("l_returnflag").alias("levers"))
    j = o.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("id"), (F.col("parts") != F.round(F.col("o_totalprice") / 5000)).alias("sum_differs"), (F.col("levers") > 1).alias("levers_differ"))

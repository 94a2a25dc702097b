"""Queries of answer post-processing. Completions are made of the assistant's turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import answers as A
from marlstone.plans.base import query
from marlstone.sources.tables import CHUNKS_SQL, QUERY_LOG_SQL, chunks, query_log, table

RAW_SQL = """raw AS (
    SELECT conv_id || ':' || turn AS request_id, conv_id, turn,
           CASE conv_id % 5 WHEN 0 THEN 'ANSWERED' WHEN 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN 2 THEN ' ANSWERED ' WHEN 3 THEN 'Well' ELSE 'ANSWERED' END
           || CASE WHEN conv_id % 11 = 10 THEN '' ELSE chr(10) || text || ' [' || (turn % 9) || '] and [1][' || conv_id % 13 || ']' ||
              CASE turn % 4 WHEN 1 THEN chr(10) || 'INSUFFICIENT_EVIDENCE' WHEN 3 THEN chr(10) || 'ANSWERED' || chr(10) || 'more [abc]' ELSE '' END END AS raw
    FROM conversations WHERE role = 'assistant')"""
PARSED_SQL = f"""{RAW_SQL},
    s AS (SELECT *, contains(raw, chr(10)) AS br, string_split(raw, chr(10))[1] AS first FROM raw),
    h AS (SELECT *, coalesce(CASE WHEN br AND length(first) <= 200 THEN CASE trim(first, ' ') WHEN 'ANSWERED' THEN 'answered' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'insufficient_evidence' END END, 'error') AS provisional,
                 CASE WHEN br AND length(first) > 200 THEN string_split(raw, chr(10)) WHEN br THEN string_split(raw, chr(10))[2:] ELSE [''] END AS lines FROM s),
    t AS (SELECT *, list_filter(lines, lambda x: trim(x, ' ') IN ('ANSWERED', 'INSUFFICIENT_EVIDENCE')) AS tokens, list_filter(lines, lambda x: trim(x, ' ') NOT IN ('ANSWERED', 'INSUFFICIENT_EVIDENCE')) AS kept FROM h),
    parsed AS (SELECT *, CASE trim(tokens[-1], ' ') WHEN 'ANSWERED' THEN 'answered' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'insufficient_evidence' END AS "trailing",
                      array_to_string(kept, chr(10)) AS body FROM t)"""
MARKERS_SQL = f"""{PARSED_SQL},
    markers AS (SELECT request_id, conv_id, unnest(range(len(m))) AS place, unnest(m)::BIGINT AS marker FROM (SELECT request_id, conv_id, regexp_extract_all(body, '\\[(\\d{{1,6}})\\]', 1) AS m FROM parsed))"""
#: five chunks are retrieved for even conversations, three for odd ones and none for every seventh
RETRIEVED_SQL = "SELECT request_id, unnest(range(1, CASE WHEN conv_id % 7 = 0 THEN 1 WHEN conv_id % 2 = 0 THEN 6 ELSE 4 END)) AS rank, conv_id FROM raw"
N_SQL = "CASE WHEN conv_id % 7 = 0 THEN 0 WHEN conv_id % 2 = 0 THEN 5 ELSE 3 END"


def raw(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    text = lambda x: F.col(x).cast("string")
    header = F.element_at(F.array(*map(F.lit, ("ANSWERED", "INSUFFICIENT_EVIDENCE", " ANSWERED ", "Well", "ANSWERED"))), (F.col("conv_id") % 5 + 1).cast("int"))
    tail = F.when(F.col("turn") % 4 == 1, "\nINSUFFICIENT_EVIDENCE").when(F.col("turn") % 4 == 3, "\nANSWERED\nmore [abc]").otherwise("")
    body = F.concat(F.lit("\n"), "text", F.lit(" ["), (F.col("turn") % 9).cast("string"), F.lit("] and [1]["), (F.col("conv_id") % 13).cast("string"), F.lit("]"), tail)
    return c.select(F.concat(text("conv_id"), F.lit(":"), text("turn")).alias("request_id"), "conv_id", "turn", F.concat(header, F.when(F.col("conv_id") % 11 == 10, "").otherwise(body)).alias("raw"))


def n_retrieved():
    return F.when(F.col("conv_id") % 7 == 0, 0).when(F.col("conv_id") % 2 == 0, 5).otherwise(3)


def retrieved(spark, d):
    return (
        raw(spark, d).where(n_retrieved() > 0).select("request_id", "conv_id", F.explode(F.sequence(F.lit(1), n_retrieved())).alias("rank")).select(
            "request_id", F.col("rank").cast("long").alias("rank"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("rank").cast("string")).alias("chunk_id"), F.when(F.col("rank") % 2 == 1, "standard").alias("doc_type"))
    )


@query("q_header_verdict", f"WITH {PARSED_SQL} SELECT request_id, provisional, br AS has_text FROM parsed")
def q_header_verdict(spark, d):
    return A.parsed(raw(spark, d)).select("request_id", "provisional", (F.instr("raw", "\n") > 0).alias("has_text"))


@query("q_trailing_verdict", f"""WITH {PARSED_SQL} SELECT request_id, "trailing", len(tokens)::BIGINT AS n FROM parsed""")
def q_trailing_verdict(spark, d):
    return A.parsed(raw(spark, d)).select("request_id", "trailing", F.size("_tokens").cast("long").alias("n"))


@query("q_verdict_reconcile", f"""WITH {PARSED_SQL} SELECT request_id, coalesce("trailing", provisional) AS verdict, "trailing" IS NOT NULL AND "trailing" <> provisional AS reconciled FROM parsed""")
def q_verdict_reconcile(spark, d):
    return A.parsed(raw(spark, d)).select("request_id", "verdict", "reconciled")


@query("q_markers", f"WITH {MARKERS_SQL} SELECT request_id, place, marker FROM markers")
def q_markers(spark, d):
    return A.markers(A.parsed(raw(spark, d)))


@query("q_citations", f"""WITH {MARKERS_SQL}, r AS ({RETRIEVED_SQL}), f AS (SELECT m.request_id, m.conv_id, marker, min(place) AS p FROM markers m JOIN r ON r.request_id = m.request_id AND r.rank = m.marker GROUP BY ALL)
    SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY p) AS position, marker, conv_id || '-' || marker AS chunk_id, CASE WHEN marker % 2 = 1 THEN 'standard' ELSE '' END AS doc_type FROM f""")
def q_citations(spark, d):
    return A.citations(A.markers(A.parsed(raw(spark, d))), retrieved(spark, d))


@query("q_cited_paths", f"""WITH {MARKERS_SQL}, r AS ({RETRIEVED_SQL}) SELECT m.request_id, array_to_string(list_sort(list(DISTINCT marker)), ',') AS cited FROM markers m JOIN r ON r.request_id = m.request_id AND r.rank = m.marker GROUP BY 1""")
def q_cited_paths(spark, d):
    """Markers in range, distinct and sorted."""
    hit = A.markers(A.parsed(raw(spark, d))).join(retrieved(spark, d).select("request_id", F.col("rank").alias("marker")), ["request_id", "marker"])
    return hit.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("marker")), lambda x: x.cast("string")), ",").alias("cited"))


@query("q_clean_answer", f"""WITH {PARSED_SQL} SELECT request_id, list_reduce(list_filter(list_distinct(regexp_extract_all(body, '\\[(\\d{{1,6}})\\]', 1)), lambda m: NOT m::BIGINT BETWEEN 1 AND {N_SQL}), lambda t, m: replace(t, '[' || m || ']', ''), body) AS text FROM parsed""")
def q_clean_answer(spark, d):
    return A.parsed(raw(spark, d)).select("request_id", A.clean_text(n_retrieved()).alias("text"))


@query("q_stop_precedence", f"""WITH {PARSED_SQL} SELECT request_id, CASE WHEN conv_id % 17 = 0 THEN 'provider_refused' WHEN conv_id % 17 = 1 THEN 'truncated' WHEN conv_id % 3 = 0 AND coalesce("trailing", provisional) = 'answered' THEN 'truncated' ELSE coalesce("trailing", provisional) END AS verdict FROM parsed""")
def q_stop_precedence(spark, d):
    stop = F.when(F.col("conv_id") % 17 == 0, "refusal").when(F.col("conv_id") % 17 == 1, "max_tokens").otherwise("end_turn")
    return A.parsed(raw(spark, d)).select("request_id", A.stop_verdict(stop, F.col("conv_id") % 3 != 0, F.col("verdict")).alias("verdict"))


@query("q_no_evidence", f"""WITH {PARSED_SQL} SELECT request_id, CASE WHEN {N_SQL} = 0 THEN 'insufficient_evidence' ELSE coalesce("trailing", provisional) END AS verdict, CASE WHEN {N_SQL} = 0 THEN 0 ELSE length(raw) END::BIGINT AS tokens, CASE WHEN {N_SQL} = 0 THEN 0 ELSE length(raw) * 15 END::BIGINT AS micro FROM parsed""")
def q_no_evidence(spark, d):
    """A question for which nothing was retrieved costs no tokens and no money."""
    n = retrieved(spark, d).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    rows = A.parsed(raw(spark, d)).join(n, "request_id", "left")
    none = F.col("n").isNull()
    zero = lambda c: F.when(none, 0).otherwise(c).cast("long")
    return rows.select("request_id", F.when(none, "insufficient_evidence").otherwise(F.col("verdict")).alias("verdict"), zero(F.length("raw")).alias("tokens"), zero(F.length("raw") * 15).alias("micro"))


@query("q_render_context", f"""WITH {CHUNKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM chunks)
    SELECT doc_id, string_agg('[' || i || '] ' || section_path || chr(10) || text, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || 'Question: what about ' || doc_id || '?' AS prompt FROM n WHERE i <= 8 GROUP BY doc_id""")
def q_render_context(spark, d):
    return prompts(spark, d)


def prompts(spark, d):
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = chunks(spark, d).withColumn("i", i).where("i <= 8").withColumn("part", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), "section_path", F.lit("\n"), "text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"])
    return rows.groupBy("doc_id").agg(F.concat(F.array_join(parts, "\n\n"), F.lit("\n\nQuestion: what about "), F.col("doc_id").cast("string"), F.lit("?")).alias("prompt"))


@query("q_latest_per_question", f"WITH {QUERY_LOG_SQL} SELECT question, id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY created_at DESC, id DESC) AS i FROM query_log) WHERE i = 1")
def q_latest_per_question(spark, d):
    last = F.max_by(F.struct("id", "verdict"), F.struct("created_at", "id"))
    return query_log(spark, d).groupBy("question").agg(last.alias("l")).select("question", "l.id", "l.verdict")


@query("q_ordered_lookup", f"""WITH {QUERY_LOG_SQL}, ids AS (SELECT id, unnest(range(3)) AS pos, unnest([id % 500, (id * 7) % 500, (id * 13) % 500]) AS doc_id FROM query_log)
    SELECT id, string_agg(source, ',' ORDER BY pos) AS sources FROM ids JOIN documents USING (doc_id) GROUP BY id""")
def q_ordered_lookup(spark, d):
    ids = query_log(spark, d).select("id", F.posexplode(F.array(F.col("id") % 500, (F.col("id") * 7) % 500, (F.col("id") * 13) % 500)).alias("pos", "doc_id"))
    rows = ids.join(table(spark, d, "documents").select("doc_id", F.col("source").alias("path")), "doc_id")
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]), ",").alias("sources"))

"""Queries of text normalisation, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import chunks as C
from marlstone.operators import text as X
from marlstone.plans.base import query
from marlstone.sources.tables import CHUNKS_SQL, chunks, table

WS = r"[\s\x{A0}]+"
WRAPPED = "replace(text, ' de', 'd-' || chr(10) || 'e')"
#: blocks: the lines of documents, numbered; headings: lines of up to three words
BLOCKS_SQL = """blocks AS (SELECT doc_id AS doc, source, unnest(range(len(w))) AS block_no, unnest(w) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS w FROM documents))"""
HEADING_SQL = "len(regexp_extract_all(text, '[^ ]+')) BETWEEN 1 AND 3"


def blocks(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return rows.withColumn("block_no", F.col("block_no").cast("long"))


def heading():
    return F.regexp_count("text", F.lit("[^ ]+")).between(1, 3)


@query("q_dehyphenate", f"SELECT doc_id, regexp_replace({WRAPPED}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS text FROM documents")
def q_dehyphenate(spark, d):
    wrapped = F.replace(F.col("text"), F.lit(" de"), F.lit("d-\ne"))
    return table(spark, d, "documents").select("doc_id", X.dehyphenate(wrapped).alias("text"))


@query("q_normalize_text")
def q_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.collapse(X.nfkc(F.col("text"))).alias("text"))


@query("q_normalize_lines", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{A0}]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS text FROM documents")
def q_normalize_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_lines(F.col("text")).alias("text"))


@query("q_page_furniture", f"""WITH {BLOCKS_SQL},
    p AS (SELECT source AS s, doc AS page, min_by(text, block_no) FILTER (text <> '') AS first, max_by(text, block_no) FILTER (text <> '') AS last FROM blocks GROUP BY ALL),
    c AS (SELECT s, count(*) AS pages FROM p GROUP BY s),
    e AS (SELECT s, 'f' AS k, first AS text, page FROM p UNION ALL SELECT s, 'l', last, page FROM p),
    n AS (SELECT s, k, text, count(*) AS n, min(page) AS since FROM e WHERE text IS NOT NULL GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY s, k ORDER BY n DESC, since) AS i FROM n),
    gone AS (SELECT DISTINCT m.s, text FROM m JOIN c ON c.s = m.s WHERE i = 1 AND 2 * n > pages)
    SELECT source, count(*) AS n_lines FROM blocks b WHERE NOT regexp_full_match(text, '\\s*\\d{{1,3}}\\s*') AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.s = b.source AND g.text = b.text) GROUP BY source""")
def q_page_furniture(spark, d):
    """Documents of a source as the pages of one."""
    lines = blocks(spark, d).select(F.col("source").alias("doc"), F.col("doc").alias("page"), F.col("block_no").alias("line_no"), "text")
    return X.strip_furniture(lines).groupBy(F.col("doc").alias("source")).agg(F.count(F.lit(1)).alias("n_lines"))


CELLS_SQL = "cells AS (SELECT l_orderkey AS table_no, l_linenumber AS row_no, unnest([1, 2, 3]) AS col_no, unnest([l_returnflag, l_quantity::BIGINT::VARCHAR, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE l_partkey::VARCHAR END]) AS text, l_suppkey AS doc FROM lineitem)"


def cells(spark, d):
    row = F.array("l_returnflag", F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.col("l_partkey").cast("string")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_no"), F.col("l_linenumber").cast("long").alias("row_no"), F.col("l_suppkey").alias("doc"), F.posexplode(row).alias("col_no", "text"))


def digit_ratios(spark, d):
    full = F.when(F.trim("text") != "", 1)
    digits = F.when((F.trim("text") != "") & F.col("text").rlike(r"^[\d.,$%() -]+$"), 1)
    return cells(spark, d).groupBy("table_no").agg(F.count(digits).alias("k"), F.count(full).alias("n_cells")).select("table_no", F.round(F.col("k") / F.when(F.col("n_cells") > 0, F.col("n_cells")), 4).alias("ratio"), "n_cells")


RATIO_SQL = f"{CELLS_SQL}, ratios AS (SELECT table_no, round(count(*) FILTER (text <> '' AND regexp_full_match(text, '[\\d.,$%() -]+')) / nullif(count(*) FILTER (text <> ''), 0)::DOUBLE, 4) AS ratio, count(*) FILTER (text <> '') AS n_cells FROM cells GROUP BY 1)"


@query("q_table_digit_ratio", f"WITH {RATIO_SQL} SELECT * FROM ratios")
def q_table_digit_ratio(spark, d):
    return digit_ratios(spark, d)


@query("q_dropped_tables", f"WITH {RATIO_SQL} SELECT table_no, row_number() OVER (PARTITION BY table_no % 50 ORDER BY table_no) - 1 AS index, ratio, n_cells, 'numeric' AS reason FROM ratios QUALIFY ratio >= 0.65")
def q_dropped_tables(spark, d):
    """Tables by document in order; the index counts kept tables too."""
    index = F.row_number().over(Window.partitionBy(F.col("table_no") % 50).orderBy("table_no")) - 1
    return digit_ratios(spark, d).withColumn("index", index.cast("long")).where("ratio >= 0.65").select("table_no", "index", "ratio", "n_cells", F.lit("numeric").alias("reason"))


@query("q_table_linearize", f"WITH {CELLS_SQL}, r AS (SELECT table_no, row_no, string_agg(text, ' | ' ORDER BY col_no, text) FILTER (text <> '') AS line FROM cells GROUP BY ALL) SELECT table_no, string_agg(line, chr(10) ORDER BY row_no) AS text FROM r GROUP BY 1")
def q_table_linearize(spark, d):
    def ordered(by, what, sep):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]), sep)

    rows = cells(spark, d).where("text <> ''").groupBy("table_no", "row_no").agg(ordered("col_no", "text", " | ").alias("line"))
    return rows.groupBy("table_no").agg(ordered("row_no", "line", "\n").alias("text"))


@query("q_heading_last_wins", """WITH b AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS block_no, 'item ' || (l_linenumber + 1) || CASE WHEN l_returnflag = 'A' THEN 'A' ELSE '' END || '. Text' AS text FROM lineitem)
    SELECT doc, upper(regexp_extract(text, '(?i)^Item\\s+(\\d+[A-C]?)\\.', 1)) AS key, max(block_no) AS block_no FROM b GROUP BY ALL""")
def q_heading_last_wins(spark, d):
    item = F.concat(F.lit("item "), (F.col("l_linenumber") + 1).cast("string"), F.when(F.col("l_returnflag") == "A", "A").otherwise(""), F.lit(". Text"))
    return X.last_headings(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_no"), item.alias("text")))


@query("q_section_assembly", f"""WITH {BLOCKS_SQL}, r AS (SELECT *, {HEADING_SQL} AS h FROM blocks),
    s AS (SELECT *, (count(*) FILTER (h) OVER w) AS section, last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER w AS heading FROM r WINDOW w AS (PARTITION BY doc ORDER BY block_no ROWS UNBOUNDED PRECEDING))
    SELECT doc, section, heading, string_agg(text, chr(10) ORDER BY block_no) AS body FROM s WHERE section > 0 AND NOT h GROUP BY ALL""")
def q_section_assembly(spark, d):
    return X.assemble_sections(blocks(spark, d), heading())


@query("q_asof_context", f"""WITH {BLOCKS_SQL}, r AS (SELECT *, CASE WHEN length(text) % 7 = 0 THEN left(text, 20) END AS c, CASE WHEN length(text) % 5 = 0 THEN left(text, 10) END AS s FROM blocks),
    n AS (SELECT *, count(c) OVER (PARTITION BY doc ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS g FROM r)
    SELECT doc, block_no, last_value(c IGNORE NULLS) OVER (PARTITION BY doc ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS chapter, last_value(s IGNORE NULLS) OVER (PARTITION BY doc, g ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS in_section FROM n""")
def q_asof_context(spark, d):
    n = F.length("text")
    return X.asof_context(blocks(spark, d), F.when(n % 7 == 0, F.substring("text", 1, 20)), F.when(n % 5 == 0, F.substring("text", 1, 10))).select("doc", "block_no", "chapter", "in_section")


@query("q_boundary_segments", f"""WITH {BLOCKS_SQL}, r AS (SELECT *, {HEADING_SQL} AS h FROM blocks), b AS (SELECT doc, block_no, text, lead(block_no) OVER (PARTITION BY doc ORDER BY block_no) AS stop FROM r WHERE h)
    SELECT doc, block_no, stop, upper(left(text, 1)) || lower(substr(text, 2)) AS label FROM b""")
def q_boundary_segments(spark, d):
    """Each boundary heading, its whole text as the label, and where the next one stops it."""
    stop = F.lead("block_no").over(Window.partitionBy("doc").orderBy("block_no"))
    label = F.concat(X.capital(F.substring("text", 1, 1)), X.small(F.substr("text", F.lit(2))))
    return blocks(spark, d).where(heading()).select("doc", "block_no", stop.alias("stop"), label.alias("label"))


# chunks

CONFIG = '{"target": 200}'


@query("q_content_hash", f"SELECT doc_id, sha256(text || chr(0) || '{CONFIG}') AS content_hash FROM documents")
def q_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat("text", F.lit("\0"), F.lit(CONFIG)), 256).alias("content_hash"))


@query("q_token_count", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))::BIGINT AS tokens FROM documents")
def q_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


UNITS_SQL = r"""units AS (SELECT doc, block_no, unnest(range(len(u))) AS k, unnest(u) AS text FROM (SELECT doc, block_no, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS u FROM blocks))"""


@query("q_sentence_units", f"WITH {BLOCKS_SQL}, {UNITS_SQL} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY block_no, k) - 1 AS unit_no, text FROM units")
def q_sentence_units(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(X.sentences(F.col("text"))).alias("unit_no", "text"))
    return rows.withColumn("unit_no", F.col("unit_no").cast("long"))


@query("q_oversize_split", "SELECT doc_id, i AS part, array_to_string(w[i * 64 + 1 : i * 64 + 64], ' ') AS text FROM (SELECT doc_id, w, unnest(range((len(w) + 63) // 64)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n]+') AS w FROM documents))")
def q_oversize_split(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    parts = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size("w") - 1) / 64))).alias("part"))
    return parts.select("doc_id", "part", F.array_join(F.slice("w", (F.col("part") * 64 + 1).cast("int"), F.lit(64)), " ").alias("text"))


@query("q_common_ancestor", """WITH p AS (SELECT doc_id, [source, lang, 'Part ' || doc_id % 3] AS a, [source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'x' END, 'Part ' || doc_id % 4] AS b FROM documents),
    n AS (SELECT *, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 ELSE 3 END AS n FROM p)
    SELECT doc_id, CASE WHEN n = 3 THEN array_to_string(a, ' › ') ELSE array_to_string(list_concat(a[1:n], [a[-1] || ' – ' || b[-1]]), ' › ') END AS path FROM n""")
def q_common_ancestor(spark, d):
    part = lambda m: F.concat(F.lit("Part "), (F.col("doc_id") % m).cast("string"))
    a, b = F.array("source", "lang", part(3)), F.array(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("x"), part(4))
    return table(spark, d, "documents").select("doc_id", X.common_path(a, b).alias("path"))


@query("q_chunk_ordinals", f"WITH {CHUNKS_SQL} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ordinal FROM chunks")
def q_chunk_ordinals(spark, d):
    return chunks(spark, d).select("doc_id", "line_no", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("long").alias("ordinal"))


@query("q_chunk_invariants", f"""WITH {CHUNKS_SQL}, t AS (SELECT doc_id, line_no, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS n FROM chunks)
    SELECT doc_id, count(*) AS chunks, max(n)::BIGINT AS largest, median(n)::DOUBLE AS middle, avg((n < 10)::INT) AS undersized, max(n) > 800 OR avg((n < 10)::INT) > 0.02 AS violates FROM t GROUP BY 1""")
def q_chunk_invariants(spark, d):
    t = chunks(spark, d).withColumn("n", X.token_count(F.col("text")))
    small = F.avg(F.when(F.col("n") < 10, 1.0).otherwise(0.0))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("n").alias("largest"), F.median("n").alias("middle"), small.alias("undersized"), ((F.max("n") > 800) | (small > 0.02)).alias("violates"))


def outline_sections(spark, d):
    """Documents as sections of four lines, three of them in a chapter."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("section_no", F.floor(F.col("line_no") / 4))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    chapter = F.concat(F.lit("Chapter "), (F.floor(F.col("section_no") / 3) + 1).cast("string"))
    section = F.concat(F.lit("Section "), (F.col("section_no") + 1).cast("string"))
    return rows.groupBy("doc", "source", "section_no").agg(text.alias("text")).select("doc", "section_no", F.array("source", chapter, section).alias("heading_path"), "text")


@query("q_pack_chunks")
def q_pack_chunks(spark, d):
    return C.pack_chunks(outline_sections(spark, d))


@query("q_chunk_violations")
def q_chunk_violations(spark, d):
    """What each document's chunks break of the rules: at most 2 % below the least, the median in the band, the rest strictly."""
    found = C.chunk_violations(q_pack_chunks(spark, d))
    return found.withColumn("violates", F.expr("too_large > 0 or without_path > 0 or gaps or out_of_band or too_many_small"))

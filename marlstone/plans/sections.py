"""Queries of sections from pages and outlines. Lines of documents become the parts of regulations and filings, as the given
pages have none: Spark writes them as markup and reads it again, SQL works on the lines themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import sections as S
from marlstone.operators import text as X
from marlstone.operators.contracts import format_probe
from marlstone.plans.base import query
from marlstone.plans.text import BLOCKS_SQL, HEADING_SQL, blocks, heading
from marlstone.sources.tables import CHUNKS_SQL, chunks, table

LINES_SQL = BLOCKS_SQL + r""", lines AS (SELECT doc, source, block_no AS i, trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g'), ' ') AS t FROM blocks)"""


@query("q_html_blocks", r"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', '', 'g') AS h FROM pages),
    cut AS (SELECT page_id, string_split(regexp_replace(h, '(?i)</?(p|div|li|h1|article|nav|footer|ul|title|body|head|html|meta|!doctype)\b[^>]*>', chr(1), 'g'), chr(1)) AS parts FROM bare),
    rows AS (SELECT page_id, unnest(range(len(parts))) AS i, trim(regexp_replace(regexp_replace(unnest(parts), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM cut)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS block_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS text FROM rows WHERE t <> ''""")
def q_html_blocks(spark, d):
    """The text blocks of each page, without scripts and styles."""
    nodes = S.without_subtrees(S.page_nodes(table(spark, d, "pages")))
    return S.html_blocks(nodes).select(F.col("page").alias("page_id"), "block_no", "text")


def _markup(spark, d, part):
    """Each document's lines as a page; `part(line, number, source)` is the markup of one."""
    plain = lambda x: F.replace(F.replace(F.replace(X.collapse(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.transform(F.split("text", "\n"), lambda x, i: part(plain(x), i, F.coalesce("source", F.lit(""))))
    return S.page_nodes(table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<body>"), F.array_join(parts, "\n"), F.lit("</body>")).alias("html")))


def _wrapped(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("q_regulation_sections", f"""WITH {LINES_SQL},
    c AS (SELECT *, CASE WHEN i % 6 = 0 THEN 'CHAPTER ' || i || coalesce(' — ' || nullif(lead(t) OVER (PARTITION BY doc ORDER BY i), ''), '') END AS ch, CASE WHEN i % 6 = 3 THEN 'SECTION ' || i END AS se FROM lines),
    n AS (SELECT *, last_value(ch IGNORE NULLS) OVER w AS chapter, count(ch) OVER w AS g FROM c WINDOW w AS (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, last_value(se IGNORE NULLS) OVER (PARTITION BY doc, g ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM n)
    SELECT doc, CASE WHEN i % 6 = 5 THEN 'rct' ELSE 'art' END AS kind, i::VARCHAR AS number, t AS text,
           CASE WHEN i % 6 = 5 THEN 'Preamble › Recital (' || i || ')' ELSE concat_ws(' › ', chapter, sec, 'Article ' || i || ' — ' || source) END AS path
    FROM m WHERE i % 6 IN (2, 4, 5) AND t <> ''""")
def q_regulation_sections(spark, d):
    def part(x, i, source):
        number, k = i.cast("string"), i % 6
        article = _wrapped('<div class="eli-subdivision" id="art_', number, '"><p class="oj-ti-art">Article ', number, '</p><p class="oj-sti-art">', source, '</p><p class="oj-normal">', x, "</p></div>")
        return (
            F.when(k == 0, _wrapped('<p class="oj-ti-section-1">CHAPTER ', number, "</p>")).when(k == 1, _wrapped('<p class="oj-ti-section-2">', x, "</p>"))
            .when(k == 3, _wrapped('<p class="oj-ti-section-1">SECTION ', number, "</p>")).when(k == 5, _wrapped('<div class="eli-subdivision" id="rct_', number, '"><p>', x, "</p></div>")).otherwise(article)
        )

    found = S.regulation_sections(_markup(spark, d, part))
    return found.select(F.col("page").alias("doc"), "kind", "number", "text", F.array_join("heading_path", " › ").alias("path"))


@query("q_annex_sections", f"""WITH {LINES_SQL},
    m AS (SELECT *, last_value(CASE WHEN i % 5 = 0 THEN i WHEN i % 10 = 3 THEN -1 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING) AS held FROM lines)
    SELECT doc, held // 5 AS annex, 'Annex I' || repeat('i', (held // 5) % 3) || ' — ANNEX I' || repeat('I', (held // 5) % 3) AS label, string_agg(t, chr(10) ORDER BY i) AS text FROM m WHERE i % 5 <> 0 AND held >= 0 AND t <> '' GROUP BY ALL""")
def q_annex_sections(spark, d):
    """Annexes between headings; every second one ends at a panel of footnotes."""
    def part(x, i, source):
        head = _wrapped('<p class="oj-doc-ti">ANNEX ', F.repeat(F.lit("I"), (1 + F.floor(i / 5) % 3).cast("int")), "</p>")
        return F.when(i % 5 == 0, head).when(i % 10 == 3, _wrapped('<div id="fnp_1"><p>', x, "</p></div>")).otherwise(_wrapped("<p>", x, "</p>"))

    found = S.annex_sections(_markup(spark, d, part))
    return found.select(F.col("page").alias("doc"), F.col("annex_no").alias("annex"), F.col("heading_path")[0].alias("label"), "text")


FILING_SQL = LINES_SQL + r""", cut AS (SELECT *, i % 4 = 0 AS head, i % 4 = 1 AND length(t) BETWEEN 5 AND 90 AS sub, CASE WHEN i % 4 = 3 AND t <> '' THEN list_transform(string_split(t, ' '), lambda x, j: CASE WHEN j % 2 = 1 THEN length(x)::VARCHAR ELSE x END) END AS cells FROM lines),
    f AS (SELECT *, round(len(list_filter(cells, lambda x: regexp_full_match(x, '[\d,.\s$%()—–-]*\d[\d,.\s$%()—–-]*')))::DOUBLE / len(cells), 4) AS ratio,
                 len(list_filter(cells, lambda x: regexp_full_match(x, '[\d,.\s$%()—–-]*\d[\d,.\s$%()—–-]*')))::DOUBLE / len(cells) >= 0.65 AS gone,
                 last_value(CASE WHEN head THEN 'Item ' || (i // 4 + 1) || '. Part' END IGNORE NULLS) OVER w AS item, count(*) FILTER (head OR sub) OVER w AS section FROM cut WINDOW w AS (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT *, last_value(CASE WHEN sub THEN t END IGNORE NULLS) OVER (PARTITION BY doc, item ORDER BY i ROWS UNBOUNDED PRECEDING) AS under FROM f)"""


def _filing(spark, d):
    def part(x, i, source):
        cells = F.transform(F.split(x, " "), lambda w, j: _wrapped("<td>", F.when(j % 2 == 0, F.length(_unescaped(w)).cast("string")).otherwise(w), "</td>"))
        bold = lambda w: _wrapped('<div><span style="font-weight:700">', w, "</span></div>")
        item = _wrapped("Item ", (F.floor(i / 4) + 1).cast("string"), ". Part")
        made = F.when(i % 4 == 0, bold(item)).when(i % 4 == 1, bold(x)).when(i % 4 == 2, _wrapped("<p>", x, "</p>"))
        return _wrapped(F.when(i == 0, "<ix:header>hidden</ix:header><p>Item 1. Part</p>").otherwise(""), made.otherwise(_wrapped("<table><tr>", F.array_join(cells, ""), "</tr></table>")))

    return S.html_blocks(S.without_subtrees(_markup(spark, d, part)))


def _unescaped(w):
    return F.replace(F.replace(F.replace(w, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


@query("q_filing_sections", f"""WITH {FILING_SQL}, b AS (SELECT doc, section, concat_ws(' › ', item, under) AS path, string_agg(CASE WHEN cells IS NULL THEN t ELSE array_to_string(cells, ' | ') END, chr(10) ORDER BY i) AS text
        FROM g WHERE NOT head AND NOT sub AND t <> '' AND NOT coalesce(gone, false) GROUP BY ALL)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY section) - 1 AS section_no, path, text FROM b""")
def q_filing_sections(spark, d):
    return S.filing_sections(_filing(spark, d)).select(F.col("page").alias("doc"), "section_no", F.array_join("heading_path", " › ").alias("path"), "text")


@query("q_filing_tables", f"WITH {FILING_SQL} SELECT doc, item, i // 4 AS table_no, ratio AS digit_ratio, len(cells)::BIGINT AS n_cells, 'numeric_table_threshold' AS reason FROM g WHERE gone")
def q_filing_tables(spark, d):
    """The tables that are left out of filings."""
    return S.filing_dropped_tables(_filing(spark, d)).withColumnRenamed("page", "doc")


# outlines

OUTLINE_SQL = "outline AS (SELECT o_custkey AS doc, o_orderkey AS entry_no, 'T' || o_orderkey AS title, 1 + (o_orderkey // 3) % 3 AS depth FROM orders)"


@query("q_outline_paths", f"""WITH {OUTLINE_SQL},
    a AS (SELECT e.doc, e.entry_no, u.depth AS ud, max(u.entry_no) AS un FROM outline e JOIN outline u ON u.doc = e.doc AND u.entry_no <= e.entry_no AND (u.entry_no = e.entry_no OR u.depth < e.depth) GROUP BY ALL),
    k AS (SELECT *, max(un) OVER (PARTITION BY doc, entry_no ORDER BY ud DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM a)
    SELECT doc, entry_no, string_agg('T' || un, ' › ' ORDER BY ud) AS path FROM k WHERE s IS NULL OR un > s GROUP BY ALL""")
def q_outline_paths(spark, d):
    o = table(spark, d, "orders")
    return S.outline_paths(o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("entry_no"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("title"), (1 + F.floor(F.col("o_orderkey") / 3) % 3).alias("depth")))


def _headings(rows):
    """Heading lines as located entries."""
    return rows.where(heading()).select("doc", F.col("block_no").alias("entry_no"), F.col("block_no").alias("start"), (F.col("block_no") + 1).alias("end"), F.col("text").alias("title"))


@query("q_line_spans", f"""WITH {BLOCKS_SQL}, h AS (SELECT doc, block_no AS start, lead(block_no) OVER (PARTITION BY doc ORDER BY block_no) AS stop FROM blocks WHERE {HEADING_SQL})
    SELECT h.doc, h.start, count(b.block_no) AS n FROM h LEFT JOIN blocks b ON b.doc = h.doc AND b.block_no > h.start AND (h.stop IS NULL OR b.block_no < h.stop) GROUP BY ALL""")
def q_line_spans(spark, d):
    rows = blocks(spark, d)
    heads = _headings(rows)
    held = S.span_lines(heads, rows.select("doc", F.col("block_no").alias("line_no"), "text"))
    counts = held.groupBy("doc", F.col("entry_no").alias("start")).agg(F.count("*").alias("n"))
    return heads.select("doc", "start").join(counts, ["doc", "start"], "left").select("doc", "start", F.coalesce("n", F.lit(0)).alias("n"))


@query("q_outline_sections", f"""WITH {LINES_SQL}, h AS (SELECT doc, block_no AS entry_no, text AS title, length(text) % 3 AS depth FROM blocks WHERE {HEADING_SQL}),
    first AS (SELECT doc, min(entry_no) FILTER (title = 'The.') AS since FROM h GROUP BY doc),
    e AS MATERIALIZED (SELECT h.* FROM h JOIN first USING (doc) WHERE since IS NULL OR entry_no >= since),
    a AS (SELECT e.doc, e.entry_no, u.depth AS ud, max(u.entry_no) AS un FROM e JOIN e u ON u.doc = e.doc AND u.entry_no <= e.entry_no AND (u.entry_no = e.entry_no OR u.depth < e.depth) GROUP BY ALL),
    k AS (SELECT *, max(un) OVER (PARTITION BY doc, entry_no ORDER BY ud DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM a),
    p AS (SELECT k.doc, k.entry_no, string_agg(t.title, ' › ' ORDER BY ud) AS path FROM k JOIN e t ON t.doc = k.doc AND t.entry_no = k.un WHERE s IS NULL OR un > s GROUP BY ALL),
    b AS (SELECT l.doc, l.i, l.t, last_value(e.entry_no IGNORE NULLS) OVER (PARTITION BY l.doc ORDER BY l.i ROWS UNBOUNDED PRECEDING) AS entry_no, e.entry_no IS NOT NULL AS is_head FROM lines l LEFT JOIN e ON e.doc = l.doc AND e.entry_no = l.i)
    SELECT doc, entry_no, path, text FROM (SELECT doc, entry_no, trim(regexp_replace(string_agg(t, ' ' ORDER BY i), ' +', ' ', 'g'), ' ') AS text FROM b WHERE NOT is_head AND entry_no IS NOT NULL GROUP BY ALL) JOIN p USING (doc, entry_no) WHERE text <> ''""")
def q_outline_sections(spark, d):
    """Located headings with their paths and the text under them; front matter before the entry `The.` goes."""
    rows = blocks(spark, d)
    heads = _headings(rows)
    outline = heads.select("doc", "entry_no", "title", (F.length("title") % 3).alias("depth"))
    return S.outline_sections(outline, heads.drop("title"), rows.select("doc", F.col("block_no").alias("line_no"), "text"), first_title="The.")


@query("q_format_probe", f"""WITH {BLOCKS_SQL}, {CHUNKS_SQL}, h AS (SELECT doc, block_no AS entry_no, length(text) % 3 AS depth FROM blocks WHERE {HEADING_SQL}),
    a AS (SELECT e.doc, e.entry_no, u.depth AS ud, max(u.entry_no) AS un FROM h e JOIN h u ON u.doc = e.doc AND u.entry_no <= e.entry_no AND (u.entry_no = e.entry_no OR u.depth < e.depth) GROUP BY ALL),
    k AS (SELECT *, max(un) OVER (PARTITION BY doc, entry_no ORDER BY ud DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM a),
    p AS (SELECT doc, entry_no, count(*) AS parts FROM k WHERE s IS NULL OR un > s GROUP BY ALL), c AS (SELECT doc_id AS doc, count(*) AS chunks FROM chunks GROUP BY 1),
    f AS (SELECT p.doc, count(*) AS sections, coalesce(max(chunks), 0) AS chunks, max(parts) AS deepest FROM p LEFT JOIN c ON c.doc = p.doc GROUP BY p.doc)
    SELECT doc, sections, chunks, deepest, deepest >= 2 AS hierarchy_ok, CASE WHEN doc % 5 <> 0 THEN chunks / (1 + doc % 7)::DOUBLE - 1 END AS deviation FROM f""")
def q_format_probe(spark, d):
    """Headings as sections with their paths, chunks, and an estimate for four documents in five."""
    heads = _headings(blocks(spark, d))
    paths = S.outline_paths(heads.select("doc", "entry_no", "title", (F.length("title") % 3).alias("depth")))
    estimates = table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("doc"), (1 + F.col("doc_id") % 7).alias("estimated_chunks"))
    found = format_probe(paths.select("doc", F.split("path", " › ").alias("heading_path")), chunks(spark, d).select(F.col("doc_id").alias("doc")), estimates)
    return found.withColumn("deepest", F.col("deepest").cast("long"))

"""Queries of ingest. Stored documents are those of even id; every document comes in, some under another uri or changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import ingest as I
from marlstone.operators.text import token_count
from marlstone.plans.base import query
from marlstone.sources.tables import CHUNKS_SQL, chunks, table

STORED_SQL = "stored AS (SELECT doc_id AS id, 'uri:' || doc_id AS source_uri, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 0)"
INCOMING_SQL = "incoming AS (SELECT doc_id AS id, 'uri:' || CASE WHEN doc_id % 10 = 0 THEN doc_id + 100000 ELSE doc_id END AS source_uri, sha256(text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END) AS content_hash FROM documents)"
VERDICTS_SQL = f"""{STORED_SQL}, {INCOMING_SQL},
    v AS (SELECT *, CASE WHEN content_hash IN (SELECT content_hash FROM stored) OR row_number() OVER (PARTITION BY content_hash ORDER BY source_uri) > 1 THEN 'unchanged'
                         WHEN source_uri IN (SELECT source_uri FROM stored) THEN 'replace' ELSE 'new' END AS verdict FROM incoming)"""


def stored(spark, d):
    t = table(spark, d, "documents").where("doc_id % 2 = 0")
    return t.select(F.col("doc_id").alias("id"), F.concat(F.lit("uri:"), F.col("doc_id").cast("string")).alias("source_uri"), F.sha2("text", 256).alias("content_hash"))


def incoming(spark, d):
    other = F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 100000).otherwise(F.col("doc_id"))
    changed = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "!").otherwise(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("uri:"), other.cast("string")).alias("source_uri"), F.sha2(changed, 256).alias("content_hash"))


@query("q_ingest_verdicts", f"WITH {VERDICTS_SQL} SELECT id, verdict FROM v")
def q_ingest_verdicts(spark, d):
    return I.verdicts(incoming(spark, d), stored(spark, d)).select("id", "verdict")


@query("q_ingest_unchanged", f"WITH {STORED_SQL}, {INCOMING_SQL} SELECT id FROM incoming WHERE content_hash IN (SELECT content_hash FROM stored)")
def q_ingest_unchanged(spark, d):
    return incoming(spark, d).join(stored(spark, d).select("content_hash"), "content_hash", "left_semi").select("id")


@query("q_replace_by_uri", f"WITH {VERDICTS_SQL} SELECT source_uri, content_hash FROM stored WHERE source_uri NOT IN (SELECT source_uri FROM v WHERE verdict <> 'unchanged') UNION ALL SELECT source_uri, content_hash FROM v WHERE verdict <> 'unchanged'")
def q_replace_by_uri(spark, d):
    return I.replace_by_uri(stored(spark, d), incoming(spark, d)).select("source_uri", "content_hash")


MANIFEST_SQL = f"""{VERDICTS_SQL}, {CHUNKS_SQL}, m AS (SELECT v.id, verdict, CASE WHEN verdict = 'unchanged' THEN 0 ELSE count(c.text) END AS chunks,
    CASE WHEN verdict = 'unchanged' THEN 0 ELSE coalesce(sum(length(c.text)), 0) END::BIGINT AS characters,
    CASE WHEN verdict = 'unchanged' THEN 0 ELSE count(DISTINCT c.section_path) END AS sections,
    CASE WHEN verdict = 'unchanged' THEN 0 ELSE coalesce(sum(len(regexp_extract_all(c.text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))), 0) END::BIGINT AS tokens FROM v LEFT JOIN chunks c ON c.doc_id = v.id GROUP BY v.id, verdict)"""


def manifest(spark, d):
    sizes = chunks(spark, d).groupBy(F.col("doc_id").alias("id")).agg(F.count("text").alias("c"), F.sum(F.length("text")).alias("l"), F.countDistinct("section_path").alias("s"), F.sum(token_count(F.col("text"))).alias("t"))
    rows = I.verdicts(incoming(spark, d), stored(spark, d)).join(sizes, "id", "left")
    made = lambda c: F.when(F.col("verdict") == "unchanged", 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return rows.select("id", "verdict", made("c").alias("chunks"), made("l").alias("characters"), made("s").alias("sections"), made("t").alias("tokens"))


@query("q_ingest_manifest", f"WITH {MANIFEST_SQL} SELECT *, round(tokens / 1e6 * 0.02, 6) AS cost FROM m")
def q_ingest_manifest(spark, d):
    return manifest(spark, d).withColumn("cost", I.embedding_cost(F.col("tokens")))


@query("q_ingest_dry_run", f"WITH {VERDICTS_SQL} SELECT id, CASE verdict WHEN 'unchanged' THEN verdict ELSE 'dry-run' END AS verdict FROM v")
def q_ingest_dry_run(spark, d):
    return I.verdicts(incoming(spark, d), stored(spark, d), dry_run=True).select("id", "verdict")


PARTS_SQL = """parts AS (SELECT doc_id, unnest(range(len(w))) AS ordinal, sha256(unnest(w)) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))"""


@query("q_replace_chunks", f"""WITH {VERDICTS_SQL}, {PARTS_SQL}, fresh AS (SELECT source_uri FROM v WHERE verdict <> 'unchanged')
    SELECT s.source_uri, ordinal, part, 'stored' AS version FROM stored s JOIN parts ON doc_id = s.id WHERE s.source_uri NOT IN (SELECT source_uri FROM fresh)
    UNION ALL SELECT i.source_uri, ordinal, part, 'incoming' FROM incoming i JOIN parts ON doc_id = i.id WHERE i.source_uri IN (SELECT source_uri FROM fresh)""")
def q_replace_chunks(spark, d):
    """Lines stand for chunks: those of replaced documents go, those of new and changed ones come."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    lines = lines.select("id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2("line", 256).alias("part"))
    of = lambda docs, version: docs.select("id", "source_uri").join(lines, "id").select("source_uri", "ordinal", "part", F.lit(version).alias("version"))
    return I.replace_chunks(of(stored(spark, d), "stored"), of(incoming(spark, d), "incoming"), stored(spark, d), incoming(spark, d))


@query("q_ingest_totals", f"WITH {MANIFEST_SQL} SELECT count(*) AS documents, sum(chunks)::BIGINT AS chunks, sum(characters)::BIGINT AS characters, count(*) FILTER (verdict = 'new') AS new, sum(chunks) > 5000 AS refused FROM m")
def q_ingest_totals(spark, d):
    return manifest(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("characters").alias("characters"), F.count(F.when(F.col("verdict") == "new", 1)).alias("new"), (F.sum("chunks") > 5000).alias("refused"))


@query("q_integrity", """WITH c AS (SELECT vec_id % 450 AS document_id, vec_id // 2 AS ordinal, CASE WHEN vec_id % 40 <> 0 THEN 'x' END AS text, CASE WHEN vec_id % 90 = 0 THEN embedding[1:8] ELSE embedding END AS e FROM embeddings),
    d AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id < 400)
    SELECT 'hash not unique' AS rule, count(*) AS n FROM (SELECT h FROM d GROUP BY h HAVING count(*) > 1) UNION ALL SELECT 'ordinal not unique', count(*) FROM (SELECT 1 FROM c GROUP BY document_id, ordinal HAVING count(*) > 1)
    UNION ALL SELECT 'no document', count(*) FROM c WHERE document_id NOT IN (SELECT id FROM d) UNION ALL SELECT 'vector length', count(*) FROM c WHERE len(e) <> 64 UNION ALL SELECT 'text missing', count(*) FROM c WHERE text IS NULL""")
def q_integrity(spark, d):
    v = F.col("vec_id")
    c = table(spark, d, "embeddings").select((v % 450).alias("document_id"), F.floor(v / 2).alias("ordinal"), F.when(v % 40 != 0, "x").alias("text"), F.when(v % 90 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"))
    docs = table(spark, d, "documents").where("doc_id < 400").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return I.integrity(docs, c, 64)


@query("q_chunks_per_document", f"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1")
def q_chunks_per_document(spark, d):
    return chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("q_corpus_health", f"WITH {CHUNKS_SQL} SELECT doc_type, count(*) AS n, count(DISTINCT source) AS identities, CASE WHEN count(*) = 0 THEN 'unavailable' WHEN count(DISTINCT source) > 1 THEN 'degraded' ELSE 'ok' END AS status FROM chunks GROUP BY 1")
def q_corpus_health(spark, d):
    n, k = F.count(F.lit(1)), F.countDistinct("source")
    return chunks(spark, d).groupBy("doc_type").agg(n.alias("n"), k.alias("identities"), F.when(n == 0, "unavailable").when(k > 1, "degraded").otherwise("ok").alias("status"))


@query("q_hash_embedding", "SELECT doc_id, list_transform(range(0, 8), lambda k: ('0x' || substr(sha256(text), (k * 2 + 1)::INT, 2))::INT / 255) AS embedding FROM documents")
def q_hash_embedding(spark, d):
    return table(spark, d, "documents").select("doc_id", I.hash_embedding(F.col("text"), 8).alias("embedding"))


@query("q_embedding_cache", "SELECT DISTINCT text, lang AS identity FROM documents EXCEPT SELECT text, lang FROM documents WHERE doc_id % 3 = 0")
def q_embedding_cache(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("identity"))
    return I.embedding_misses(t, t.where("doc_id % 3 = 0").select("text", "identity"))


@query("q_route_pages", "SELECT page_id, CASE WHEN contains(substr(html, 1, 65536), 'eli-subdivision') THEN 'regulation' WHEN contains(substr(html, 1, 65536), 'ix:') OR contains(lower(substr(html, 1, 65536)), 'xbrl') THEN 'filing' ELSE 'page' END AS loader FROM pages")
def q_route_pages(spark, d):
    return table(spark, d, "pages").select("page_id", I.route(F.col("html"), F.lit("x.html")).alias("loader"))


@query("q_fetch_quality", """WITH floors AS (SELECT 'file-' || s_suppkey AS filename, 800 + 60 * (s_suppkey % 40) AS min_bytes FROM supplier),
    files AS (SELECT page_id, 'file-' || page_id % 120 AS filename, CASE WHEN page_id % 20 = 3 THEN 202 ELSE 200 END AS status, html FROM pages)
    SELECT page_id, CASE WHEN min_bytes IS NULL THEN 'unregistered' WHEN status = 202 OR contains(substr(html, 1, 4096), 'awsWaf') THEN 'challenge' WHEN octet_length(encode(html)) < min_bytes THEN 'too small' ELSE 'present' END AS quality FROM files LEFT JOIN floors USING (filename)""")
def q_fetch_quality(spark, d):
    """Each file against the floor that is registered for its name."""
    name = lambda n: F.concat(F.lit("file-"), n.cast("string"))
    floors = table(spark, d, "supplier").select(name(F.col("s_suppkey")).alias("filename"), (800 + 60 * (F.col("s_suppkey") % 40)).alias("min_bytes"))
    files = table(spark, d, "pages").select("page_id", name(F.col("page_id") % 120).alias("filename"), F.when(F.col("page_id") % 20 == 3, 202).otherwise(200).alias("status"), F.col("html").alias("content"))
    return I.fetch_quality(files, floors).select("page_id", "quality")


@query("q_snapshot_diff", "WITH a AS (SELECT url AS path, max(sha256(html)) AS s FROM pages WHERE page_id % 5 <> 0 GROUP BY 1), b AS (SELECT url AS path, max(sha256(html || CASE WHEN page_id % 7 = 0 THEN 'x' ELSE '' END)) AS s FROM pages WHERE page_id % 5 <> 1 GROUP BY 1) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.s IS NULL THEN 'created' WHEN b.s IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.s IS DISTINCT FROM b.s")
def q_snapshot_diff(spark, d):
    p = table(spark, d, "pages")
    changed = F.concat("html", F.when(F.col("page_id") % 7 == 0, "x").otherwise(""))
    side = lambda rest, text: p.where(f"page_id % 5 <> {rest}").groupBy(F.col("url").alias("path")).agg(F.max(F.sha2(text, 256)).alias("sha256"))
    return I.snapshot_diff(side(0, F.col("html")), side(1, changed))


@query("q_contract_drift", "(SELECT p_brand AS code, p_size AS v, 'missing' AS side FROM part WHERE p_partkey % 9 <> 0 EXCEPT ALL SELECT p_brand, p_size, 'missing' FROM part WHERE p_partkey % 8 <> 0) UNION ALL (SELECT p_brand, p_size, 'extra' FROM part WHERE p_partkey % 8 <> 0 EXCEPT ALL SELECT p_brand, p_size, 'extra' FROM part WHERE p_partkey % 9 <> 0)")
def q_contract_drift(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("code"), F.col("p_size").alias("v"))
    a, b = (p.where(f"p_partkey % {m} <> 0").select("code", "v") for m in (9, 8))
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("extra")))

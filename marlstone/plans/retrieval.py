"""Queries over vectors, sections and lexical postings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import lexical as L
from marlstone.operators import retrieval as R
from marlstone.plans.base import query
from marlstone.sources.tables import CHUNKS_SQL, chunks, table


def vectors(spark, d, dims=None):
    """Queries (every 100th vector), and the corpus (all vectors), as (id, embedding, label)."""
    e = table(spark, d, "embeddings")
    v = F.slice("embedding", 1, dims) if dims else F.col("embedding")
    rows = e.select(F.col("vec_id").alias("id"), v.alias("embedding"), F.col("label").cast("long").alias("label"))
    return rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "item_id")


def topk(spark, d, k=8, dims=None, filters=None):
    q, c = vectors(spark, d, dims)
    return R.vector_topk(q, c, k, filters, but_itself=True)


def topk_sql(name: str, k: int = 8, dims: int | None = None, where: str = "true") -> str:
    v = f"embedding[1:{dims}]" if dims else "embedding"
    return f"""
    {name}_v AS (SELECT vec_id, label::BIGINT AS label, list_transform({v}, lambda x: x::DOUBLE) AS e FROM embeddings),
    {name} AS (
        SELECT query_id, item_id, rank, similarity, 1 / (60 + rank)::DOUBLE AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank
              FROM (SELECT q.vec_id AS query_id, c.vec_id AS item_id,
                           round(list_dot_product(c.e, q.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS similarity
                    FROM {name}_v q, {name}_v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND ({where})))
        WHERE rank <= {k})"""


HITS_SQL = f"""
    {topk_sql('a')}, {topk_sql('b', dims=16)},
    labels_v AS (SELECT vec_id, label::BIGINT AS label FROM embeddings),
    arms AS (SELECT 'full' AS arm, * FROM a UNION ALL SELECT 'short' AS arm, * FROM b),
    asked AS (SELECT vec_id AS query_id, label, arm FROM labels_v, (VALUES ('full'), ('short')) v(arm) WHERE vec_id % 100 = 0),
    hits AS (
        SELECT asked.arm, asked.query_id, asked.label,
               min(arms.rank) FILTER (WHERE item.label = asked.label) AS hit_rank
        FROM asked LEFT JOIN arms ON arms.arm = asked.arm AND arms.query_id = asked.query_id LEFT JOIN labels_v item ON item.vec_id = arms.item_id
        GROUP BY ALL)"""


def hits(spark, d):
    """First rank of an item with the query's label, by arm; null where none is among the first eight."""
    q, c = vectors(spark, d)
    arms = topk(spark, d).withColumn("arm", F.lit("full")).unionByName(topk(spark, d, dims=16).withColumn("arm", F.lit("short")))
    asked = q.select("query_id", "label").crossJoin(spark.createDataFrame([("full",), ("short",)], "arm string"))
    found = arms.join(c.select("item_id", F.col("label").alias("item_label")), "item_id")
    joined = asked.join(found, ["arm", "query_id"], "left")
    return joined.groupBy("arm", "query_id", "label").agg(F.min(F.when(F.col("item_label") == F.col("label"), F.col("rank"))).alias("hit_rank"))


@query("q_flagship_recall", f"""WITH {HITS_SQL}
    SELECT count(*) AS n, avg((hit_rank <= 1 AND hit_rank IS NOT NULL)::INT) AS recall_1, avg((coalesce(hit_rank, 99) <= 3)::INT) AS recall_3,
           avg((coalesce(hit_rank, 99) <= 8)::INT) AS recall_8, round(avg(coalesce(1.0 / hit_rank, 0)), 9) AS mrr FROM hits WHERE arm = 'full'""")
def q_flagship_recall(spark, d):
    at = lambda k: F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")
    return hits(spark, d).where("arm = 'full'").agg(F.count(F.lit(1)).alias("n"), at(1), at(3), at(8), F.round(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), 9).alias("mrr"))


@query("q_vector_topk", f"WITH {topk_sql('a')} SELECT * FROM a")
def q_vector_topk(spark, d):
    return topk(spark, d)


@query("q_candidates", f"""WITH {topk_sql('a')}, {CHUNKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ordinal FROM chunks)
    SELECT query_id, rank, similarity, score, doc_id * 1000000 + ordinal AS chunk_id, doc_id AS document_id, 'Document ' || doc_id AS document_title, 'urn:' || source || ':' || doc_id AS source_uri, doc_type, section_path, ordinal, text
    FROM a JOIN n ON n.doc_id = a.item_id AND ordinal = query_id % 3""")
def q_candidates(spark, d):
    """Each hit as a chunk of the document of its number, with all that a search returns of it."""
    ordinal = (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("long")
    rows = chunks(spark, d).withColumn("ordinal", ordinal)
    parts = rows.select((F.col("doc_id") * 1_000_000 + F.col("ordinal")).alias("id"), F.col("doc_id").alias("document_id"), "section_path", "ordinal", "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("urn:"), "source", F.lit(":"), F.col("doc_id").cast("string")).alias("source_uri"), F.col("lang").alias("doc_type"))
    hits = topk(spark, d).withColumn("item_id", F.col("item_id") * 1_000_000 + F.col("query_id") % 3)
    return R.candidates(hits, parts, docs)


@query("q_filtered_topk", f"WITH {topk_sql('a', where='c.label IN (1, 3)')} SELECT * FROM a")
def q_filtered_topk(spark, d):
    return topk(spark, d, filters={"label": [1, 3]})


@query("q_rerank_window", f"""WITH {topk_sql('a', k=32)}
    SELECT query_id, item_id, rank, new_rank FROM (
        SELECT a.*, row_number() OVER (PARTITION BY query_id ORDER BY item_id % 7 DESC, rank) AS new_rank FROM a) WHERE new_rank <= 8""")
def q_rerank_window(spark, d):
    return R.rerank(topk(spark, d, 32), F.col("item_id") % 7, 8).select("query_id", "item_id", "rank", "new_rank")


@query("q_embedder_identities", "SELECT 'table:' || label AS identity, count(*) AS n FROM embeddings GROUP BY 1")
def q_embedder_identities(spark, d):
    return R.embedder_identities(table(spark, d, "embeddings").select(F.concat(F.lit("table:"), F.col("label")).alias("embedding_model")))


@query("q_distinct_section_rate", f"""WITH {topk_sql('a')}
    SELECT v.vec_id AS query_id, coalesce(count(DISTINCT i.label) / nullif(count(a.item_id), 0)::DOUBLE, 0) AS rate
    FROM embeddings v LEFT JOIN a ON a.query_id = v.vec_id LEFT JOIN embeddings i ON i.vec_id = a.item_id WHERE v.vec_id % 100 = 0 GROUP BY 1""")
def q_distinct_section_rate(spark, d):
    """Labels stand for sections."""
    asked, corpus = vectors(spark, d)
    return R.distinct_section_rate(topk(spark, d).join(corpus.select("item_id", F.col("label").alias("section")), "item_id"), asked)


@query("q_rrf_fuse", f"""WITH {topk_sql('a')}, {topk_sql('b', dims=16)}
    SELECT query_id, item_id, score, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, item_id) AS rank
    FROM (SELECT query_id, item_id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score, min(rank) AS best_rank
          FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)""")
def q_rrf_fuse(spark, d):
    return R.fuse(topk(spark, d), topk(spark, d, dims=16))


FUSED_SQL = """{n} AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, item_id) AS rank
        FROM (SELECT query_id, item_id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score, min(rank) AS best_rank FROM (SELECT query_id, item_id, rank FROM a UNION ALL SELECT query_id, item_id, rank FROM b WHERE {w}) GROUP BY ALL)),
    {n}h AS (SELECT q.vec_id AS query_id, min(f.rank) FILTER (WHERE i.label = q.label AND f.rank <= 8) IS NOT NULL AS hit
           FROM labels_v q LEFT JOIN {n} f ON f.query_id = q.vec_id LEFT JOIN labels_v i ON i.vec_id = f.item_id WHERE q.vec_id % 100 = 0 GROUP BY 1)"""


@query("q_fusion_gate", f"""WITH {HITS_SQL}, {FUSED_SQL.format(n='f', w='true')}, {FUSED_SQL.format(n='g', w='query_id % 300 <> 0')},
    x AS (SELECT query_id, h.hit_rank IS NOT NULL AS plain, fh.hit AS fused, gh.hit AS gated FROM hits h JOIN fh USING (query_id) JOIN gh USING (query_id) WHERE h.arm = 'full')
    SELECT count(*) AS n, avg(plain::INT) AS recall_plain, avg(fused::INT) AS recall_fused, avg(gated::INT) AS recall_gated, count(*) FILTER (gated AND NOT fused) AS recovered,
           count(*) FILTER (fused AND NOT gated) AS given_up, count(*) FILTER (plain AND NOT gated) AS newly_broken FROM x""")
def q_fusion_gate(spark, d):
    """Fusion with a second list, with and without its fallback candidates (here those of every third query asked)."""
    q, c = vectors(spark, d)
    dense, second = topk(spark, d), topk(spark, d, dims=16).withColumn("via_fallback", F.col("query_id") % 300 == 0)
    labels = c.select("item_id", F.col("label").alias("item_label"))

    def hit(fused, name):
        best = q.select("query_id", "label").join(fused.where("rank <= 8").join(labels, "item_id"), "query_id", "left")
        return best.groupBy("query_id").agg(F.coalesce(F.max(F.col("item_label") == F.col("label")), F.lit(False)).alias(name))

    rows = hit(dense, "plain").join(hit(R.fuse(dense, second), "fused"), "query_id").join(hit(R.fuse(dense, R.ungated(second)), "gated"), "query_id")
    rate, n = (lambda c: F.avg(F.col(c).cast("int")).alias(f"recall_{c}")), (lambda c, name: F.count_if(F.expr(c)).alias(name))
    return rows.agg(F.count(F.lit(1)).alias("n"), rate("plain"), rate("fused"), rate("gated"), n("gated and not fused", "recovered"), n("fused and not gated", "given_up"), n("plain and not gated", "newly_broken"))


# sections

LABELS_SQL = "gold AS (SELECT DISTINCT source || ' › ' || lang || ' › Part 1' AS label FROM documents)"
PATHS_SQL = "paths AS (SELECT DISTINCT source || ' › ' || lang || ' › Part ' || (doc_id % 12) AS path, source FROM documents)"


def labelled_paths(spark, d):
    docs = table(spark, d, "documents")
    gold = docs.select(F.concat_ws(" › ", "source", "lang", F.lit("Part 1")).alias("label"), F.col("source").alias("root")).distinct()
    paths = docs.select(F.concat_ws(" › ", "source", "lang", F.concat(F.lit("Part "), F.col("doc_id") % 12)).alias("path"), F.col("source").alias("root")).distinct()
    return gold.join(paths, "root").drop("root")


@query("q_section_match", f"WITH {LABELS_SQL}, {PATHS_SQL} SELECT label, path FROM gold JOIN paths ON starts_with(path, label) AND NOT regexp_matches(substr(path, length(label) + 1, 1), '[\\p{{L}}\\p{{N}}_]')")
def q_section_match(spark, d):
    docs = table(spark, d, "documents")
    gold = docs.select(F.concat_ws(" › ", "source", "lang", F.lit("Part 1")).alias("label")).distinct()
    paths = docs.select(F.concat_ws(" › ", "source", "lang", F.concat(F.lit("Part "), F.col("doc_id") % 12)).alias("path")).distinct()
    return R.match_labels(gold, paths, path="path")


@query("q_section_straddle", f"WITH {LABELS_SQL}, {PATHS_SQL} SELECT label, path FROM gold JOIN paths ON starts_with(path, label) AND regexp_matches(substr(path, length(label) + 1, 1), '[\\p{{L}}\\p{{N}}_]')")
def q_section_straddle(spark, d):
    return labelled_paths(spark, d).where(R.straddles(F.col("label"), F.col("path")))


@query("q_exact_anchor", f"WITH {LABELS_SQL}, {PATHS_SQL} SELECT DISTINCT label FROM gold JOIN paths ON path = label OR starts_with(path, label || ' › ')")
def q_exact_anchor(spark, d):
    return labelled_paths(spark, d).where(R.is_exact_anchor(F.col("label"), F.col("path"))).select("label").distinct()


# lexical search: the first lines of documents ask, all chunks answer

TERMS_SQL = f"""{CHUNKS_SQL},
    tok AS (SELECT doc_id * 1000000000 + line_no AS item_id, doc_id, line_no, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM chunks),
    postings AS (SELECT item_id, term, count(*) AS n FROM tok GROUP BY ALL),
    asked AS (SELECT doc_id AS query_id, term FROM tok WHERE line_no = 0 AND doc_id % 100 = 0 GROUP BY ALL)"""
SCORED_SQL = """
    df AS (SELECT term, count(DISTINCT item_id) AS df FROM postings GROUP BY term),
    total AS (SELECT count(DISTINCT item_id) AS items FROM postings),
    need AS (SELECT query_id, count(*) AS need FROM asked GROUP BY 1),
    scored AS (SELECT query_id, item_id, count(*) AS matched, round(sum(ln(1 + items / df) * n / (1 + n)), 6) AS score
               FROM asked JOIN postings USING (term) JOIN df USING (term), total GROUP BY ALL)"""


def postings(spark, d):
    tok = chunks(spark, d).select("doc_id", "line_no", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    tok = tok.withColumn("item_id", F.col("doc_id") * 1_000_000_000 + F.col("line_no"))
    asked = tok.where("line_no = 0 and doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "term").distinct()
    return asked, tok.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def lines_as_items(spark, d):
    """What the queries ask, and the lines of one item with their words in one row, dealt by item once."""
    lines = chunks(spark, d).select("doc_id", "line_no", F.lower("text").alias("text"))
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    asked = lines.where("line_no = 0 and doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(words("text")).alias("term"))
    dealt = lines.select((F.col("doc_id") * 1_000_000_000 + F.col("line_no")).alias("item_id"), "text").repartition(L.SHARDS, "item_id")
    whole = dealt.groupBy("item_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    return asked, whole.select("item_id", words("text").alias("words"))


@query("q_lexical_and", f"""WITH {TERMS_SQL}, {SCORED_SQL}
    SELECT * FROM (SELECT scored.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored JOIN need USING (query_id) WHERE matched = need) WHERE rank <= 50""")
def q_lexical_and(spark, d):
    return L.best_items(*lines_as_items(spark, d), k=50).drop("via_fallback")


@query("q_lexical_fallback", f"""WITH {TERMS_SQL}, {SCORED_SQL},
    strict AS (SELECT scored.* FROM scored JOIN need USING (query_id) WHERE matched = need AND item_id <> query_id * 1000000000),
    loose AS (SELECT * FROM scored WHERE item_id <> query_id * 1000000000 AND query_id NOT IN (SELECT query_id FROM strict))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
        FROM (SELECT *, false AS via_fallback FROM strict UNION ALL SELECT *, true FROM loose)) WHERE rank <= 10""")
def q_lexical_fallback(spark, d):
    return L.best_items(*lines_as_items(spark, d), k=10, fall_back=True, but=F.col("query_id") * 1_000_000_000)


@query("q_lexeme_pruning", f"WITH {TERMS_SQL} SELECT query_id, term FROM asked WHERE term NOT IN (SELECT term FROM postings GROUP BY term HAVING count(DISTINCT item_id) > 0.25 * (SELECT count(DISTINCT item_id) FROM postings))")
def q_lexeme_pruning(spark, d):
    asked, posted = postings(spark, d)
    return R.prune_terms(asked, posted).select("query_id", "term")


@query("q_blank_queries", "SELECT conv_id, turn, trim(coalesce(text, ''), ' ') = '' AS rejected FROM conversations WHERE role = 'user'")
def q_blank_queries(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("rejected"))

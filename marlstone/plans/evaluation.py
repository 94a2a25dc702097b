"""Queries of retrieval and refusal evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.statistics import clopper_pearson, mcnemar_exact, paired_difference, removals_survived, unpaired_difference, wilson
from marlstone.operators import evaluation as E
from marlstone.operators import retrieval as R
from marlstone.plans.base import query
from marlstone.plans.retrieval import HITS_SQL, hits, topk, topk_sql, vectors
from marlstone.sources.tables import CHUNKS_SQL, chunks, table

BLOCK = "(query_id // 200)"
Z = 1.959963984540054


@query("q_first_hit_rank", f"WITH {HITS_SQL} SELECT arm, query_id, label, hit_rank FROM hits")
def q_first_hit_rank(spark, d):
    return hits(spark, d)


@query("q_recall_at_k", f"""WITH {HITS_SQL} SELECT arm, avg((coalesce(hit_rank, 99) <= 1)::INT) AS r1, avg((coalesce(hit_rank, 99) <= 3)::INT) AS r3,
    avg((coalesce(hit_rank, 99) <= 8)::INT) AS r8 FROM hits GROUP BY arm""")
def q_recall_at_k(spark, d):
    return hits(spark, d).groupBy("arm").agg(*(E.recall("hit_rank", k).alias(f"r{k}") for k in (1, 3, 8)))


@query("q_mrr", f"WITH {HITS_SQL} SELECT arm, round(avg(coalesce(1.0 / hit_rank, 0)), 9) AS mrr FROM hits GROUP BY arm")
def q_mrr(spark, d):
    return hits(spark, d).groupBy("arm").agg(E.mean_reciprocal_rank("hit_rank").alias("mrr"))


@query("q_recall_grouping_sets", f"""WITH {HITS_SQL} SELECT arm, style, count(*) AS n, round(avg((coalesce(hit_rank, 99) <= 3)::INT), 4) AS r3
    FROM (SELECT *, label % 3 AS style FROM hits) GROUP BY GROUPING SETS ((arm, style), (arm))""")
def q_recall_grouping_sets(spark, d):
    rows = hits(spark, d).withColumn("style", F.col("label") % 3)
    return rows.groupingSets([["arm", "style"], ["arm"]], "arm", "style").agg(F.count(F.lit(1)).alias("n"), F.round(E.recall("hit_rank", 3), 4).alias("r3"))


PAIRS_SQL = f"""{HITS_SQL}, paired AS (
    SELECT x.query_id, x.label, x.hit_rank IS NOT NULL AS a, y.hit_rank IS NOT NULL AS b, x.hit_rank AS ra, y.hit_rank AS rb
    FROM hits x JOIN hits y USING (query_id) WHERE x.arm = 'full' AND y.arm = 'short')"""
TABLE_SQL = """count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only,
    count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a <> b) AS n_discordant"""


@query("q_paired_table", f"WITH {PAIRS_SQL} SELECT {TABLE_SQL} FROM paired")
def q_paired_table(spark, d):
    return E.paired_outcomes(hits(spark, d), "full", "short")


def mcnemar_sql(b: str, c: str) -> str:
    return f"""CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1),
        lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2))))) END"""


#: Discordant counts to test, from the corpus: chunks by source in even and odd documents
COUNTS_SQL = "counts AS (SELECT source, count(*) FILTER (doc_id % 20 < 10 AND n_chars % 2 = 0) AS b, count(*) FILTER (n_chars % 7 = 0) AS c, count(*) AS n FROM documents GROUP BY source)"


def counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(E_sum("doc_id % 20 < 10 and n_chars % 2 = 0").alias("b"), E_sum("n_chars % 7 = 0").alias("c"), F.count(F.lit(1)).alias("n"))


def E_sum(condition: str):
    return F.sum(E.yes(F.expr(condition)))


@query("q_mcnemar", f"""WITH {COUNTS_SQL} SELECT source, b, c, p, b + c >= 6 AND p < 0.05 AS conclusive
    FROM (SELECT *, round({mcnemar_sql('b', 'c')}, 9) AS p FROM counts)""")
def q_mcnemar(spark, d):
    rows = counts(spark, d).withColumn("p", F.round(mcnemar_exact(F.col("b"), F.col("c")), 9))
    return rows.select("source", "b", "c", "p", ((F.col("b") + F.col("c") >= 6) & (F.col("p") < 0.05)).alias("conclusive"))


def wilson_sql(x: str, n: str, upper: bool) -> str:
    p, z = f"({x} / {n}::DOUBLE)", Z
    mid = f"(({p} + {z * z} / (2 * {n})) / (1 + {z * z} / {n}))"
    half = f"({z} * sqrt(greatest({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}), 0)) / (1 + {z * z} / {n}))"
    return f"least({mid} + {half}, 1.0)" if upper else f"greatest({mid} - {half}, 0.0)"


@query("q_wilson", f"WITH {COUNTS_SQL} SELECT source, c AS x, n, round({wilson_sql('c', 'n', False)}, 9) AS low, round({wilson_sql('c', 'n', True)}, 9) AS high FROM counts")
def q_wilson(spark, d):
    low, high = wilson(F.col("c"), F.col("n"))
    return counts(spark, d).select("source", F.col("c").alias("x"), "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("q_clopper_pearson")
def q_clopper_pearson(spark, d):
    return counts(spark, d).withColumn("i", clopper_pearson()("c", "n")).select("source", F.col("c").alias("x"), "n", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


FOUR_SQL = """four AS (SELECT source, count(*) FILTER (a AND b) AS both_, count(*) FILTER (a AND NOT b) AS f, count(*) FILTER (NOT a AND b) AS s, count(*) FILTER (NOT a AND NOT b) AS nn, count(*) AS n
    FROM (SELECT source, n_chars % 3 <> 0 AS a, n_chars % 5 <> 0 AS b FROM documents) GROUP BY source)"""


@query("q_newcombe", f"""WITH {FOUR_SQL}, v AS (
    SELECT *, (both_ + f) / n::DOUBLE AS p1, (both_ + s) / n::DOUBLE AS p2, {wilson_sql('(both_ + f)', 'n', False)} AS l1, {wilson_sql('(both_ + f)', 'n', True)} AS u1,
           {wilson_sql('(both_ + s)', 'n', False)} AS l2, {wilson_sql('(both_ + s)', 'n', True)} AS u2,
           (both_ + f) * (n - both_ - f) * (both_ + s) * (n - both_ - s) AS margin, both_ * nn - f * s AS excess FROM four),
    w AS (SELECT *, CASE WHEN margin = 0 THEN 0 ELSE excess / sqrt(margin::DOUBLE) END AS phi FROM v)
    SELECT source, round(p1 - p2, 9) AS difference, round(p1 - p2 - sqrt((p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2), 9) AS low,
           round(p1 - p2 + sqrt((u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2), 9) AS high FROM w""")
def q_newcombe(spark, d):
    docs = table(spark, d, "documents").select("source", F.expr("n_chars % 3 <> 0").alias("a"), F.expr("n_chars % 5 <> 0").alias("b"))
    four = docs.groupBy("source").agg(E_sum("a and b").alias("w"), E_sum("a and not b").alias("x"), E_sum("not a and b").alias("y"), E_sum("not a and not b").alias("z"))
    diff, low, high = paired_difference(*(F.col(c) for c in "wxyz"))
    return four.select("source", F.round(diff, 9).alias("difference"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("q_unpaired_difference", f"""WITH {COUNTS_SQL},
    v AS (SELECT *, b / n::DOUBLE AS p1, c / n::DOUBLE AS p2, {wilson_sql('b', 'n', False)} AS l1, {wilson_sql('b', 'n', True)} AS u1, {wilson_sql('c', 'n', False)} AS l2, {wilson_sql('c', 'n', True)} AS u2 FROM counts)
    SELECT source, round(p1 - p2, 9) AS difference, round(p1 - p2 - sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), 9) AS low, round(p1 - p2 + sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2), 9) AS high FROM v""")
def q_unpaired_difference(spark, d):
    diff, low, high = unpaired_difference(F.col("b"), F.col("n"), F.col("c"), F.col("n"))
    return counts(spark, d).select("source", F.round(diff, 9).alias("difference"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("q_diversity_summary", f"""WITH {topk_sql('a')}, r AS (SELECT query_id, count(DISTINCT item_id % 5) / count(*)::DOUBLE AS rate FROM a GROUP BY 1)
    SELECT round(avg(rate), 9) AS mean, median(rate) AS median, min(rate) AS low, max(rate) AS high FROM r""")
def q_diversity_summary(spark, d):
    rate = R.distinct_section_rate(topk(spark, d).withColumn("section", F.col("item_id") % 5), vectors(spark, d)[0])
    return rate.agg(F.round(F.avg("rate"), 9).alias("mean"), F.median("rate").alias("median"), F.min("rate").alias("low"), F.max("rate").alias("high"))


@query("q_gold_pinning", f"""WITH {CHUNKS_SQL}, g AS (SELECT DISTINCT source || ' › ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' › Part 1' ELSE ' › Part' END AS label FROM documents),
    m AS (SELECT label, section_path, doc_id * 1000000 + line_no AS chunk_id FROM g LEFT JOIN chunks c ON starts_with(section_path, label) AND NOT regexp_matches(substr(section_path, length(label) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))
    SELECT label, count(section_path) AS n_chunks, count(DISTINCT section_path) AS n_paths, count(section_path) = 0 AS unresolved, coalesce(NOT bool_or(section_path = label OR starts_with(section_path, label || ' › ')), false) AS truncated,
           count(DISTINCT section_path) > 1 AS ambiguous, coalesce(array_to_string(list_sort(list(DISTINCT section_path) FILTER (section_path IS NOT NULL)), '|'), '') AS paths,
           coalesce(array_to_string(list_sort(list(DISTINCT chunk_id) FILTER (chunk_id IS NOT NULL)), '|'), '') AS chunk_ids FROM m GROUP BY label""")
def q_gold_pinning(spark, d):
    """Labels of sections, and labels cut short, with the chunks that they stand for."""
    end = F.when(F.col("doc_id") % 2 == 0, "Part 1").otherwise("Part")
    gold = table(spark, d, "documents").where("source is not null and lang is not null").select(F.concat_ws(" › ", "source", "lang", end).alias("label"))
    pins = R.pin_golds(gold, chunks(spark, d).withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("line_no")))
    return pins.withColumns({"paths": F.array_join("paths", "|"), "chunk_ids": F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), "|")})


@query("q_block_mix", f"""WITH m AS (SELECT vec_id // 200 AS block, label % 3 AS shape, count(*) AS n FROM embeddings WHERE vec_id % 100 = 0 GROUP BY ALL),
    e AS (SELECT block, s AS shape, 1 AS expected FROM (SELECT DISTINCT vec_id // 200 AS block FROM embeddings), range(0, 3) u(s))
    SELECT coalesce(m.block, e.block)::BIGINT AS block, coalesce(m.shape, e.shape)::BIGINT AS shape, coalesce(n, 0) AS n, coalesce(expected, 0)::BIGINT AS expected, coalesce(n, 0) <> coalesce(expected, 0) AS breach
    FROM m FULL JOIN e ON m.block = e.block AND m.shape = e.shape""")
def q_block_mix(spark, d):
    got = table(spark, d, "embeddings").where("vec_id % 100 = 0").groupBy(F.floor(F.col("vec_id") / 200).alias("block"), (F.col("label") % 3).cast("long").alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    every = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 200).alias("block")).distinct()
    want = every.select("block", F.explode(F.expr("sequence(0L, 2L)")).alias("shape"), F.lit(1).cast("long").alias("expected"))
    both = got.join(want, ["block", "shape"], "full").fillna(0, ["n", "expected"])
    return both.withColumn("breach", F.col("n") != F.col("expected"))


@query("q_rank_histogram", f"""WITH {HITS_SQL}, r AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 0])::BIGINT AS rank)

    SELECT q.arm, r.rank, (SELECT count(*) FROM hits h WHERE h.arm = q.arm AND coalesce(h.hit_rank, 0) = r.rank) AS n FROM r, (SELECT DISTINCT arm FROM hits) q""")
def q_rank_histogram(spark, d):
    """0 stands for a miss; every bucket is there."""
    got = hits(spark, d).groupBy("arm", F.coalesce("hit_rank", F.lit(0)).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(9).select(F.col("id").alias("rank"), F.explode(F.array(F.lit("full"), F.lit("short"))).alias("arm"))
    return every.join(got, ["arm", "rank"], "left").select("arm", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def blocks(spark, d):
    return hits(spark, d).withColumn("block", F.floor(F.col("query_id") / 200))


BLOCKS_SQL = f"{PAIRS_SQL}, blocks AS (SELECT query_id // 200 AS block, count(*) AS n, count(*) FILTER (a <> b) AS n_discordant, avg(a::INT) AS recall, round(avg(coalesce(1.0 / ra, 0)), 9) AS mrr FROM paired GROUP BY 1)"


@query("q_block_interim", f"WITH {BLOCKS_SQL} SELECT block, n, n_discordant, n_discordant / n::DOUBLE AS r FROM blocks")
def q_block_interim(spark, d):
    """Blind to which arm won: swapping the arms changes nothing."""
    t = E.paired_outcomes(blocks(spark, d), "full", "short", ("block",))
    n = F.col("both") + F.col("first_only") + F.col("second_only") + F.col("neither")
    return t.select("block", n.alias("n"), "n_discordant", (F.col("n_discordant") / n).alias("r"))


@query("q_cumulative_sizing", f"""WITH {BLOCKS_SQL}, c AS (
        SELECT block, n, n_discordant, (sum(n) OVER o)::BIGINT AS n_so_far, (sum(n_discordant) OVER o)::BIGINT AS discordant_so_far FROM blocks WINDOW o AS (ORDER BY block))
    SELECT block, n, n_discordant, n_so_far, discordant_so_far, CASE WHEN discordant_so_far > 0 THEN ceil(round(6 * n_so_far / discordant_so_far::DOUBLE, 9))::BIGINT END AS need_6,
           CASE WHEN discordant_so_far > 0 THEN ceil(round(15 * n_so_far / discordant_so_far::DOUBLE, 9))::BIGINT END AS need_15,
           CASE WHEN discordant_so_far > 0 THEN ceil(round(23 * n_so_far / discordant_so_far::DOUBLE, 9))::BIGINT END AS need_23, round(discordant_so_far / n_so_far::DOUBLE, 9) AS r FROM c""")
def q_cumulative_sizing(spark, d):
    return E.cumulative_sizing(q_block_interim(spark, d).drop("r"))


@query("q_difficulty_band", f"WITH {BLOCKS_SQL} SELECT block, mrr, round(mrr - first_value(mrr) OVER (ORDER BY block), 9) AS change, abs(mrr - first_value(mrr) OVER (ORDER BY block)) > 0.19 AS breach FROM blocks")
def q_difficulty_band(spark, d):
    b = blocks(spark, d).where("arm = 'full'").groupBy("block").agg(E.mean_reciprocal_rank("hit_rank").alias("mrr"))
    change = F.col("mrr") - F.first("mrr").over(Window.orderBy("block"))
    return b.select("block", "mrr", F.round(change, 9).alias("change"), (F.abs(change) > 0.19).alias("breach"))


@query("q_discordant_cases", f"""WITH {PAIRS_SQL}, {CHUNKS_SQL}, x AS (SELECT p.query_id, CASE WHEN p.a THEN 'full' ELSE 'short' END AS winner, source || ' › ' || lang AS label FROM paired p LEFT JOIN documents ON doc_id = p.query_id WHERE p.a <> p.b),
    t AS (SELECT query_id, string_agg(c.text, chr(10) ORDER BY doc_id, line_no) AS gold_text FROM x JOIN chunks c ON starts_with(section_path, label) AND NOT regexp_matches(substr(section_path, length(label) + 1, 1), '[\\p{{L}}\\p{{N}}_]') GROUP BY query_id)
    SELECT query_id, winner, label, gold_text FROM x LEFT JOIN t USING (query_id)""")
def q_discordant_cases(spark, d):
    """Cases that one arm alone hits, with the gold text: that of all chunks under the source and language of the document
    of the query's number."""
    h = hits(spark, d)
    a, b = (h.where(F.col("arm") == x).select("query_id", F.col("hit_rank").isNotNull().alias(x)) for x in ("full", "short"))
    named = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.concat("source", F.lit(" › "), "lang").alias("label"))
    cases = a.join(b, "query_id").where("full <> short").join(named, "query_id", "left")
    cases = cases.select(F.col("query_id").alias("case_id"), F.when(F.col("full"), "full").otherwise("short").alias("winner"), "label")
    return R.discordant_worksheet(cases, chunks(spark, d), ["doc_id", "line_no"]).withColumnRenamed("case_id", "query_id")


@query("q_sensitivity", f"""WITH {COUNTS_SQL}, x AS (SELECT source, b, c, unnest(range(0, c + 1)) AS removed FROM counts),
    p AS (SELECT *, round({mcnemar_sql('b', '(c - removed)')}, 9) AS p FROM x)
    SELECT source, b, c, max(removed) FILTER (p < 0.05 AND c - removed > b) AS survives, max(p) AS worst FROM p GROUP BY ALL""")
def q_sensitivity(spark, d):
    """What an arm's lead survives, and the largest p on the way down: 1 where both arms come to be even, else that of all pairs,
    as p falls with the distance between them."""
    b, c = F.col("b"), F.col("c")
    worst = F.when(c >= b, 1.0).otherwise(F.round(mcnemar_exact(b, c), 9))
    return counts(spark, d).select("source", "b", "c", removals_survived(b, c).alias("survives"), worst.alias("worst"))


@query("q_competition_probe", f"""WITH {topk_sql('before', where='c.label <> 9')}, {topk_sql('after')},
    l AS (SELECT vec_id, label FROM embeddings),
    new AS (SELECT count(*) AS appearances, count(DISTINCT a.query_id) AS questions, round(count(*) / (SELECT count(*) FROM l WHERE label = 9)::DOUBLE, 9) AS density
            FROM after a JOIN l ON l.vec_id = a.item_id WHERE l.label = 9),
    moved AS (SELECT count(*) AS kept, count(*) FILTER (a.rank <> b.rank) AS moved, coalesce(round(avg(a.rank - b.rank), 9), 0) AS mean_change FROM before b JOIN after a USING (query_id, item_id))
    SELECT appearances, questions, (SELECT count(*) FROM before) - kept AS displaced, density, moved, mean_change FROM new, moved""")
def q_competition_probe(spark, d):
    """What items of a label do to the results of a corpus that they join: places taken, lost and moved."""
    q, c = vectors(spark, d)
    new = c.where("label = 9").select("item_id")
    before = R.vector_topk(q, c.where("label <> 9"), but_itself=True).select("query_id", "item_id", F.col("rank").alias("old"))
    after = R.vector_topk(q, c, but_itself=True)
    both = after.join(new.withColumn("new", F.lit(True)), "item_id", "left").join(before, ["query_id", "item_id"], "full")
    fresh, kept = F.col("new"), F.col("rank").isNotNull() & F.col("old").isNotNull()
    change = F.when(kept, F.col("rank") - F.col("old"))
    counts = both.agg(
        F.count(F.when(fresh, 1)).alias("appearances"), F.countDistinct(F.when(fresh, F.col("query_id"))).alias("questions"), F.count(F.when(F.col("old").isNotNull() & F.col("rank").isNull(), 1)).alias("displaced"),
        F.count(F.when(change != 0, 1)).alias("moved"), F.coalesce(F.round(F.avg(change), 9), F.lit(0.0)).alias("mean_change"),
    )
    sized = counts.crossJoin(new.agg(F.count(F.lit(1)).alias("size")))
    return sized.select("appearances", "questions", "displaced", F.round(F.col("appearances") / F.col("size"), 9).alias("density"), "moved", "mean_change")


@query("q_attractors", f"""WITH {topk_sql('a')} SELECT item_id, count(*) AS n, count(*) FILTER (rank = 1) AS at_1, count(*) FILTER (rank <= 3) AS at_3, min(rank) AS best_rank,
    label::BIGINT AS label, round(percent_rank() OVER (ORDER BY count(*)), 9) AS percentile FROM a JOIN embeddings ON vec_id = item_id GROUP BY item_id, label""")
def q_attractors(spark, d):
    """The items that stand among the nearest of any query: how often, how high, and their place among all by how often."""
    rows = topk(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rank") == 1, 1)).alias("at_1"), F.count(F.when(F.col("rank") <= 3, 1)).alias("at_3"), F.min("rank").alias("best_rank"))
    #: a row for each count, so the window holds as many rows as there are different counts
    spread = rows.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    below = F.sum("m").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    place = spread.select("n", F.coalesce(below, F.lit(0)).alias("below")).crossJoin(spread.agg(F.sum("m").alias("total")))
    percentile = F.when(F.col("total") > 1, F.round(F.col("below") / (F.col("total") - 1), 9)).otherwise(0.0)
    return rows.join(place.select("n", percentile.alias("percentile")), "n").join(vectors(spark, d)[1].select("item_id", "label"), "item_id")


@query("q_identical_topk", f"""WITH {topk_sql('a')}, {topk_sql('b', dims=16)}, x AS (SELECT query_id, list(item_id ORDER BY rank) AS i FROM a GROUP BY 1), y AS (SELECT query_id, list(item_id ORDER BY rank) AS j FROM b GROUP BY 1)
    SELECT v.vec_id AS query_id, coalesce(i = j, false) AS identical, i IS NULL OR j IS NULL AS empty FROM embeddings v LEFT JOIN x ON x.query_id = vec_id LEFT JOIN y ON y.query_id = vec_id WHERE vec_id % 100 = 0""")
def q_identical_topk(spark, d):
    def lists(rows, name):
        return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias(name))

    both = vectors(spark, d)[0].select("query_id").join(lists(topk(spark, d), "i"), "query_id", "left").join(lists(topk(spark, d, dims=16), "j"), "query_id", "left")
    return both.select("query_id", F.coalesce(F.col("i") == F.col("j"), F.lit(False)).alias("identical"), (F.col("i").isNull() | F.col("j").isNull()).alias("empty"))


# refusal: labels as answerable (quality) and refused (toxic or short)

CASES_SQL = "cases AS (SELECT l.doc_id, d.lang AS arm, l.quality = 1 AS answerable, l.toxic = 1 OR d.n_chars % 4 = 0 AS declined, d.n_chars % 9 = 0 AS stale FROM labels l JOIN documents d USING (doc_id))"


def cases(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select("doc_id", F.col("lang").alias("arm"), (F.col("quality") == 1).alias("answerable"), F.expr("toxic = 1 or n_chars % 4 = 0").alias("declined"), F.expr("n_chars % 9 = 0").alias("stale"))


@query("q_refusal_rates", f"""WITH {CASES_SQL}, t AS (SELECT arm, count(*) AS n, count(*) FILTER (declined) AS x FROM cases GROUP BY arm)
    SELECT arm, n, x, x / n::DOUBLE AS rate, round({wilson_sql('x', 'n', False)}, 9) AS low, round({wilson_sql('x', 'n', True)}, 9) AS high, 5 * x > n AS disables FROM t""")
def q_refusal_rates(spark, d):
    t = cases(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), E_sum("declined").alias("x"))
    low, high = wilson(F.col("x"), F.col("n"))
    return t.select("arm", "n", "x", (F.col("x") / F.col("n")).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), (5 * F.col("x") > F.col("n")).alias("disables"))


@query("q_refusal_confusion", f"""WITH {CASES_SQL} SELECT answerable, count(*) FILTER (NOT stale AND declined) AS declined, count(*) FILTER (NOT stale AND NOT declined) AS answered, count(*) FILTER (stale) AS stale FROM cases GROUP BY 1""")
def q_refusal_confusion(spark, d):
    return cases(spark, d).groupBy("answerable").agg(E_sum("not stale and declined").alias("declined"), E_sum("not stale and not declined").alias("answered"), E_sum("stale").alias("stale"))


@query("q_verdict_disagreement", f"""WITH {CASES_SQL} SELECT CASE WHEN answerable THEN 'answered' END AS provisional, CASE WHEN declined THEN 'insufficient_evidence' ELSE 'answered' END AS final, count(*) AS n,
    CASE WHEN answerable THEN 'answered' END IS DISTINCT FROM CASE WHEN declined THEN 'insufficient_evidence' ELSE 'answered' END AS differs FROM cases GROUP BY ALL""")
def q_verdict_disagreement(spark, d):
    rows = cases(spark, d).select(F.when(F.col("answerable"), "answered").alias("provisional"), F.when(F.col("declined"), "insufficient_evidence").otherwise("answered").alias("final"))
    return rows.groupBy("provisional", "final").agg(F.count(F.lit(1)).alias("n")).withColumn("differs", ~F.col("provisional").eqNullSafe(F.col("final")))


@query("q_set_leakage", """WITH b AS (SELECT item_id, lower(text) AS t FROM benchmark), d AS (SELECT DISTINCT lower(unnest(string_split(text, chr(10)))) AS line FROM documents)
    SELECT item_id FROM b WHERE t IN (SELECT line FROM d)""")
def q_set_leakage(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "\n")).alias("t"))
    return table(spark, d, "benchmark").withColumn("t", F.lower("text")).join(lines, "t", "left_semi").select("item_id")


@query("q_eval_run_scores", """SELECT run, metric, round(avg(score), 9) AS score, count(*) AS n FROM (
    SELECT user_id % 4 AS run, unnest(['value', 'k']) AS metric, unnest([value, json_extract_string(props, '$.k')::DOUBLE]) AS score FROM events) GROUP BY ALL""")
def q_eval_run_scores(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("run"), F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double")).alias("scores"))
    return e.select("run", F.explode("scores").alias("metric", "score")).groupBy("run", "metric").agg(F.round(F.avg("score"), 9).alias("score"), F.count(F.lit(1)).alias("n"))

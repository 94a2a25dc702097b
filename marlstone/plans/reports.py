"""Queries of report figures, refusal outcomes, budget alerts, error translation and sub-headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import evaluation as E
from marlstone.operators import telemetry as T
from marlstone.operators import text as X
from marlstone.plans.base import query
from marlstone.plans.evaluation import wilson_sql
from marlstone.plans.text import BLOCKS_SQL, blocks
from marlstone.sources.tables import chosen, table

#: three arms of documents: two that should be declined and a control
ARMS_SQL = "cases AS (SELECT source, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS arm, CASE doc_id % 3 WHEN 2 THEN n_chars % 11 = 0 WHEN 1 THEN n_chars % 7 <> 0 ELSE n_chars % 2 = 0 END AS declined FROM documents)"
_A, _B = ("x_0", "n_0"), ("x_1", "n_1")


@query("q_refusal_report", f"""WITH {ARMS_SQL},
    t AS (SELECT source, count(*) FILTER (arm = 'A') AS n_0, count(*) FILTER (arm = 'B') AS n_1, count(*) FILTER (arm = 'C') AS n_2,
                 count(*) FILTER (arm = 'A' AND declined) AS x_0, count(*) FILTER (arm = 'B' AND declined) AS x_1, count(*) FILTER (arm = 'C' AND declined) AS x_2 FROM cases GROUP BY source),
    r AS (SELECT source, x_0 / n_0::DOUBLE AS a, x_1 / n_1::DOUBLE AS b, x_2 / n_2::DOUBLE AS c, {wilson_sql(*_A, False)} AS la, {wilson_sql(*_A, True)} AS ua, {wilson_sql(*_B, False)} AS lb, {wilson_sql(*_B, True)} AS ub
          FROM t WHERE n_0 > 0 AND n_1 > 0 AND n_2 > 0)
    SELECT source, round(a, 9) AS rate_first, round(b, 9) AS rate_second, round(c, 9) AS rate_control, round(b - a, 9) AS difference,
           round(b - a - sqrt((b - lb) ** 2 + (ua - a) ** 2), 9) AS low, round(b - a + sqrt((ub - b) ** 2 + (a - la) ** 2), 9) AS high,
           CASE WHEN a >= 0.8 AND b >= 0.8 AND c <= 0.2 THEN 'refuses both' WHEN b >= 0.8 AND a <= 0.5 THEN 'refuses the second only' WHEN b <= 0.5 THEN 'refuses neither' ELSE 'indeterminate' END AS outcome FROM r""")
def q_refusal_report(spark, d):
    k, n = F.col("doc_id") % 3, F.col("n_chars")
    arm = F.when(k == 0, "A").when(k == 1, "B").otherwise("C")
    declined = F.when(k == 2, n % 11 == 0).when(k == 1, n % 7 != 0).otherwise(n % 2 == 0)
    return E.refusal_report(table(spark, d, "documents").select("source", arm.alias("arm"), declined.alias("declined")), "source")


#: comparisons, made of orders: discordant pairs, p, both arms, the difference's interval and the split's, and a metric
COMPARED_SQL = """compared AS (SELECT o_orderkey AS id, 40 AS n, o_orderkey % 23 AS b, o_orderkey % 29 AS c, (o_orderkey % 13) / 100.0 AS p, 0.05 AS alpha, 6 AS floor, (o_orderkey % 101) / 100.0 AS first, (o_orderkey % 97) / 100.0 AS second,
    (o_orderkey % 41 - 60) / 100.0 AS low, (o_orderkey % 43 + 20) / 100.0 AS high, CASE WHEN o_orderkey % 37 = 0 THEN (o_orderkey % 41 - 60) / 100.0 ELSE -2.0 END AS split_low, CASE WHEN o_orderkey % 37 = 0 THEN (o_orderkey % 43 + 20) / 100.0 ELSE 2.0 END AS split_high,
    (o_orderkey % 11) / 10.0 AS metric, (o_orderkey % 7 + 5) / 10.0 AS metric_high FROM orders)"""


def compared(spark, d):
    k = F.col("o_orderkey")
    part = lambda c: F.round(c, 2)
    low, high = part((k % 41 - 60) / 100), part((k % 43 + 20) / 100)
    return table(spark, d, "orders").select(
        k.alias("id"), F.lit(40).alias("n"), (k % 23).alias("b"), (k % 29).alias("c"), part(k % 13 / 100).alias("p"), F.lit(0.05).alias("alpha"), F.lit(6).alias("floor"), part(k % 101 / 100).alias("first"), part(k % 97 / 100).alias("second"),
        low.alias("low"), high.alias("high"), F.when(k % 37 == 0, low).otherwise(-2.0).alias("split_low"), F.when(k % 37 == 0, high).otherwise(2.0).alias("split_high"), part(k % 11 / 10).alias("metric"), part((k % 7 + 5) / 10).alias("metric_high"),
    )


@query("q_comparison_flags", f"""WITH {COMPARED_SQL} SELECT id, round(first - second, 9) AS difference_value,
    CASE WHEN b + c < floor OR p >= alpha THEN 'inconclusive' WHEN first >= second THEN 'first' ELSE 'second' END AS outcome, metric < 1 AS desaturated, metric_high < 1 AS desaturated_at_the_bound,
    array_to_string(list_filter([CASE WHEN b + c > n THEN 'pairs above n' END, CASE WHEN NOT round(first - second, 9) BETWEEN low AND high THEN 'difference outside its interval' END,
        CASE WHEN low = split_low AND high = split_high THEN 'interval of the split' END, CASE WHEN metric > metric_high THEN 'metric above its bound' END], lambda x: x IS NOT NULL), ', ') AS broken FROM compared""")
def q_comparison_flags(spark, d):
    return E.comparison_flags(compared(spark, d)).select("id", "difference_value", "outcome", "desaturated", "desaturated_at_the_bound", "broken")


SNAPSHOTS_SQL = "snapshots AS (SELECT ts, CASE WHEN event_type <> 'signup' THEN round(value / 4) END AS remaining_usd, user_id % 20 AS reserved_usd, event_id % 1000 AS age_s FROM events)"


@query("q_budget_alerts", f"""WITH {SNAPSHOTS_SQL}, w AS (SELECT (floor(epoch(ts) / 900) * 900)::BIGINT AS start, min(remaining_usd) AS headroom, max(age_s) AS age_s, max(reserved_usd) AS reserved FROM snapshots GROUP BY 1)
    SELECT start, headroom, age_s, reserved, coalesce(headroom < 1, false) AS little_headroom, coalesce(age_s > 900, false) AS old_snapshot, coalesce(reserved >= headroom, false) AS all_reserved,
           headroom IS NULL OR age_s IS NULL OR reserved IS NULL AS absent FROM w""")
def q_budget_alerts(spark, d):
    e = table(spark, d, "events")
    remaining = F.when(F.col("event_type") != "signup", F.round(F.col("value") / 4))
    return T.budget_alerts(e.select(F.col("ts").cast("timestamp").alias("ts"), remaining.alias("remaining_usd"), (F.col("user_id") % 20).alias("reserved_usd"), (F.col("event_id") % 1000).alias("age_s")))


CLASS = {"view": "EmbedderMismatchError", "click": "EmptyCorpusError", "signup": "UnknownModelError", "purchase": "KeyError"}


@query("q_error_translation", """SELECT error_class, CASE error_class WHEN 'EmbedderMismatchError' THEN 'embedder_mismatch' WHEN 'EmptyCorpusError' THEN 'empty_corpus' WHEN 'UnknownModelError' THEN 'misconfigured' END AS code,
    CASE error_class WHEN 'EmbedderMismatchError' THEN 503 WHEN 'EmptyCorpusError' THEN 503 WHEN 'UnknownModelError' THEN 500 END::BIGINT AS status, count(*) AS n
    FROM (SELECT CASE event_type WHEN 'view' THEN 'EmbedderMismatchError' WHEN 'click' THEN 'EmptyCorpusError' WHEN 'signup' THEN 'UnknownModelError' WHEN 'purchase' THEN 'KeyError' END AS error_class FROM events) GROUP BY ALL""")
def q_error_translation(spark, d):
    """Exception classes to codes and their declared statuses; a foreign class has none."""
    rows = table(spark, d, "events").select(chosen(F.col("event_type"), CLASS).alias("error_class")).withColumn("code", T.error_code(F.col("error_class")))
    known = rows.join(F.broadcast(T.conditions(spark).select("code", F.col("declared").alias("status"))), "code", "left")
    return known.groupBy("error_class", "code", "status").agg(F.count(F.lit(1)).alias("n"))


@query("q_subheadings", f"WITH {BLOCKS_SQL} SELECT doc, block_no FROM blocks WHERE NOT contains(text, ',') AND length(trim(text, ' ')) BETWEEN 5 AND 90")
def q_subheadings(spark, d):
    """Lines without a comma stand for blocks that are bold as a whole."""
    return blocks(spark, d).where(X.is_subheading(F.col("text"), ~F.col("text").contains(","))).select("doc", "block_no")

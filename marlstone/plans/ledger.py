"""Queries of prices and spend."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import ledger as L
from marlstone.plans.answers import prompts
from marlstone.plans.base import query
from marlstone.sources.tables import CHUNKS_SQL, QUERY_LOG_SQL, RATES_SQL, query_log, rates, table

#: Cost in millionths: price rows have cents, so the sum in hundredths is whole and rounds half to even exactly.
PRICED_SQL = f"""{RATES_SQL}, {QUERY_LOG_SQL},
    hundredths AS (
        SELECT q.*, r.input_per_mtok, r.output_per_mtok, r.effective_from,
               (q.prompt_tokens * (r.input_per_mtok * 100)::BIGINT + q.completion_tokens * (r.output_per_mtok * 100)::BIGINT)::BIGINT AS h
        FROM query_log q LEFT JOIN rates r ON r.identity = q.identity AND q.created_at::DATE >= r.effective_from AND (r.effective_until IS NULL OR q.created_at::DATE <= r.effective_until)),
    priced AS (
        SELECT *, (h // 100 + CASE WHEN h % 100 > 50 OR (h % 100 = 50 AND (h // 100) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS micro FROM hundredths)"""


def priced(spark, d):
    return L.priced(query_log(spark, d), rates(spark)).withColumn("micro", (F.col("cost_usd") * 1_000_000).cast("long"))


@query("q_rate_join", f"WITH {PRICED_SQL} SELECT id, identity, input_per_mtok::DOUBLE AS input_price, output_per_mtok::DOUBLE AS output_price, effective_from::VARCHAR AS since FROM priced")
def q_rate_join(spark, d):
    rows = L.with_rate(query_log(spark, d), F.broadcast(rates(spark)), F.to_date("created_at"))
    return rows.select("id", "identity", F.col("input_per_mtok").cast("double").alias("input_price"), F.col("output_per_mtok").cast("double").alias("output_price"), F.col("effective_from").cast("string").alias("since"))


@query("q_cost", f"WITH {PRICED_SQL} SELECT id, micro FROM priced WHERE micro IS NOT NULL")
def q_cost(spark, d):
    return priced(spark, d).where("micro is not null").select("id", "micro")


@query("q_reprice_drift", f"""WITH {PRICED_SQL} SELECT id, micro, micro + CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END AS stored FROM priced WHERE micro IS NOT NULL AND id % 97 = 0""")
def q_reprice_drift(spark, d):
    """Stored costs that differ from those of their own day's price; every 97th is stored off by a millionth."""
    rows = priced(spark, d).where("micro is not null").withColumn("stored", F.col("micro") + F.when(F.col("id") % 97 == 0, 1).otherwise(0))
    return rows.where(~F.col("stored").eqNullSafe(F.col("micro"))).select("id", "micro", "stored")


@query("q_unpriced", f"""WITH {PRICED_SQL} SELECT id, identity, CASE WHEN identity IN (SELECT identity FROM rates) THEN 'no rate that day' ELSE 'no rates' END AS reason FROM priced WHERE micro IS NULL""")
def q_unpriced(spark, d):
    return L.unpriced(query_log(spark, d), rates(spark)).select("id", "identity", "reason")


#: what stands before every question
SYSTEM_PROMPT = "Answer from the numbered sources alone. Say so if they do not hold the answer."


@query("q_max_cost", f"""WITH {CHUNKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM chunks),
    p AS (SELECT doc_id, string_agg('[' || i || '] ' || section_path || chr(10) || text, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || 'Question: what about ' || doc_id || '?' AS prompt FROM n WHERE i <= 8 GROUP BY doc_id)
    SELECT documents.doc_id, CASE WHEN prompt IS NULL THEN 0 ELSE (octet_length(encode(prompt)) + {len(SYSTEM_PROMPT)} + 64) * 3 + 4096 * 15 END::BIGINT AS micro FROM documents LEFT JOIN p USING (doc_id)""")
def q_max_cost(spark, d):
    """The most that each document's question can cost, in millionths; nothing for a document without chunks."""
    rows = table(spark, d, "documents").select("doc_id").join(prompts(spark, d), "doc_id", "left")
    bound = L.worst_cost(F.col("prompt"), SYSTEM_PROMPT, F.lit(3).cast("decimal(18,6)"), F.lit(15).cast("decimal(18,6)"))
    return rows.select("doc_id", (bound * 1_000_000).cast("long").alias("micro"))


@query("q_spend_windows", f"""WITH {PRICED_SQL} SELECT created_at::DATE::VARCHAR AS day, coalesce(sum(micro) FILTER (source = 'visitor'), 0)::BIGINT AS visitor, coalesce(sum(micro), 0)::BIGINT AS everyone,
    (sum(coalesce(sum(micro), 0)) OVER (PARTITION BY date_trunc('month', created_at::DATE)))::BIGINT AS month FROM priced GROUP BY created_at::DATE""")
def q_spend_windows(spark, d):
    visitor = F.sum(F.when(F.col("source") == "visitor", F.col("micro")))
    days = priced(spark, d).groupBy(F.to_date("created_at").alias("day")).agg(F.coalesce(visitor, F.lit(0)).alias("visitor"), F.coalesce(F.sum("micro"), F.lit(0)).alias("everyone"))
    #: a window over days, not over requests
    return days.withColumn("month", F.sum("everyone").over(Window.partitionBy(F.trunc("day", "month")))).withColumn("day", F.col("day").cast("string"))


@query("q_window_bounds", f"""WITH {QUERY_LOG_SQL} SELECT id, date_trunc('day', created_at)::DATE::VARCHAR AS day, date_trunc('month', created_at)::DATE::VARCHAR AS month, (date_trunc('month', created_at) + INTERVAL 1 MONTH)::DATE::VARCHAR AS next_month,
    greatest(1, 86400 - (extract(hour FROM created_at) * 3600 + extract(minute FROM created_at) * 60 + floor(extract(second FROM created_at))) - CASE WHEN extract(microseconds FROM created_at) % 1000000 > 0 THEN 1 ELSE 0 END)::BIGINT AS reset_s FROM query_log""")
def q_window_bounds(spark, d):
    at = F.col("created_at")
    left = F.unix_micros(F.date_trunc("day", at) + F.expr("interval 1 day")) - F.unix_micros(at)
    return query_log(spark, d).select(
        "id", F.to_date(at).cast("string").alias("day"), F.trunc(at, "month").cast("string").alias("month"), F.add_months(F.trunc(at, "month"), 1).cast("string").alias("next_month"),
        F.greatest(F.lit(1), F.floor(left / 1_000_000)).cast("long").alias("reset_s"),
    )


LIMITS_SQL = """days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
    limits AS (SELECT day, greatest(floor(20 * 100 / extract(day FROM last_day(day))) / 100, 0.01) AS derived FROM days)"""


@query("q_daily_ceiling", f"""WITH {LIMITS_SQL} SELECT day::VARCHAR AS day, derived::DOUBLE AS derived, least(0.9, 2 * derived)::DOUBLE AS tight, least(5.0, 2 * derived)::DOUBLE AS loose FROM limits""")
def q_daily_ceiling(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    limit = lambda override: L.daily_limit(F.lit(20).cast("decimal(18,2)"), F.lit(override).cast("decimal(18,2)"), F.col("day")).cast("double")
    return days.select(F.col("day").cast("string").alias("day"), L.derived_daily_limit(F.lit(20), F.col("day")).cast("double").alias("derived"), limit(0.9).alias("tight"), limit(5).alias("loose"))


@query("q_limit_origin", f"""WITH {LIMITS_SQL}, o AS (SELECT * FROM (VALUES (20.0, NULL), (20.0, 0.9), (20.0, 5.0), (NULL, 5.0), (NULL, NULL)) v(monthly, override))
    SELECT day::VARCHAR AS day, monthly::DOUBLE AS monthly, override::DOUBLE AS override,
           CASE WHEN monthly IS NULL AND override IS NULL THEN 'none' WHEN monthly IS NULL THEN 'override' WHEN override IS NULL THEN 'derived' WHEN override > 2 * derived THEN 'capped' ELSE 'burst' END AS origin,
           (CASE WHEN monthly IS NULL THEN override WHEN override IS NULL THEN derived ELSE least(override, 2 * derived) END)::DOUBLE AS daily FROM limits, o""")
def q_limit_origin(spark, d):
    """The daily limit and where it comes from, for each day and shape of limits."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    shapes = spark.createDataFrame([("20", None), ("20", "0.9"), ("20", "5"), (None, "5"), (None, None)], "m string, o string")
    rows = days.crossJoin(F.broadcast(shapes)).select("day", F.col("m").cast("decimal(18,2)").alias("monthly"), F.col("o").cast("decimal(18,2)").alias("override"))
    args = (F.col("monthly"), F.col("override"), F.col("day"))
    return rows.select(F.col("day").cast("string").alias("day"), F.col("monthly").cast("double").alias("monthly"), F.col("override").cast("double").alias("override"), L.limit_origin(*args).alias("origin"), L.daily_limit(*args).cast("double").alias("daily"))


@query("q_ceiling_trips", f"""WITH {PRICED_SQL},
    r AS (SELECT id, source, (coalesce(sum(micro) FILTER (source = 'visitor') OVER (PARTITION BY created_at::DATE ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS day_micro,
                 (sum(micro) OVER (PARTITION BY date_trunc('month', created_at) ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))::BIGINT AS month_micro FROM priced WHERE micro IS NOT NULL)
    SELECT id, day_micro, month_micro, CASE WHEN month_micro >= 80000000 THEN 'monthly' WHEN source = 'visitor' AND day_micro >= 2000000 THEN 'daily' END AS tripped FROM r""")
def q_ceiling_trips(spark, d):
    out = L.ceiling_trips(priced(spark, d).where("micro is not null"), 2, 80)
    micro = lambda c: (F.col(c) * 1_000_000).cast("long")
    return out.select("id", micro("spent_day").alias("day_micro"), micro("spent_month").alias("month_micro"), "tripped")


@query("q_headroom", f"""WITH {PRICED_SQL}, s AS (SELECT created_at::DATE AS day, coalesce(sum(micro) FILTER (source = 'visitor'), 0)::BIGINT AS v, coalesce(sum(micro), 0)::BIGINT AS e,
        86400 - floor(epoch(max(created_at)) - epoch(created_at::DATE))::BIGINT AS age_s FROM priced GROUP BY created_at::DATE)
    SELECT day::VARCHAR AS day, greatest(0, (floor(20 * 100 / extract(day FROM last_day(day))) * 10000)::BIGINT - v)::BIGINT AS headroom,
           greatest(0, 80000000 - sum(e) OVER (PARTITION BY date_trunc('month', day) ORDER BY day))::BIGINT AS month_headroom, age_s FROM s""")
def q_headroom(spark, d):
    visitor = F.coalesce(F.sum(F.when(F.col("source") == "visitor", F.col("micro"))), F.lit(0))
    day = F.to_date("created_at")
    days = priced(spark, d).groupBy(day.alias("day")).agg(visitor.alias("v"), F.coalesce(F.sum("micro"), F.lit(0)).alias("e"), F.max(F.unix_micros("created_at")).alias("last"))
    limit = (L.derived_daily_limit(F.lit(20), F.col("day")) * 1_000_000).cast("long")
    month = F.sum("e").over(Window.partitionBy(F.trunc("day", "month")).orderBy("day"))
    #: seconds from the last request of a day to its end, when the figures are read
    age = F.lit(86_400) - F.floor((F.col("last") - F.unix_micros(F.col("day").cast("timestamp"))) / 1_000_000)
    return days.select(
        F.col("day").cast("string").alias("day"), F.greatest(F.lit(0), limit - F.col("v")).cast("long").alias("headroom"),
        F.greatest(F.lit(0), F.lit(80_000_000) - month).cast("long").alias("month_headroom"), age.cast("long").alias("age_s"),
    )


@query("q_reservation_sweep", f"""WITH {QUERY_LOG_SQL},
    m AS (SELECT created_at AS moved, request_id, source, prompt_tokens AS change FROM query_log
          UNION ALL SELECT created_at + to_milliseconds(latency_ms), request_id, source, -prompt_tokens FROM query_log WHERE id % 50 <> 0)
    SELECT request_id, change, (sum(change) OVER w)::BIGINT AS outstanding_month, (sum(CASE WHEN source = 'visitor' THEN change ELSE 0 END) OVER w)::BIGINT AS outstanding_day
    FROM m WINDOW w AS (ORDER BY moved, change, request_id ROWS UNBOUNDED PRECEDING)""")
def q_reservation_sweep(spark, d):
    q = query_log(spark, d)
    settled = F.timestamp_micros(F.unix_micros("created_at") + F.col("latency_ms") * 1000)
    made = q.select("request_id", "source", F.col("prompt_tokens").alias("amount"), F.col("created_at").alias("reserved_at"), F.when(F.col("id") % 50 != 0, settled).alias("settled_at"))
    return L.reservation_sweep(made).select("request_id", "change", "outstanding_month", "outstanding_day")


@query("q_spend_cube", f"WITH {PRICED_SQL} SELECT source, identity, coalesce(sum(micro), 0)::BIGINT AS micro, count(*) AS n FROM priced GROUP BY CUBE (source, identity)")
def q_spend_cube(spark, d):
    return priced(spark, d).cube("source", "identity").agg(F.coalesce(F.sum("micro"), F.lit(0)).alias("micro"), F.count(F.lit(1)).alias("n"))


@query("q_cost_bounded_run", f"""WITH {PRICED_SQL}, t AS (SELECT id, micro, (sum(micro) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM priced WHERE micro IS NOT NULL AND id % 3 <> 0)
    SELECT id, micro, spent, (SELECT coalesce(max(spent - micro) <= 5000000, true) FROM t) AS complete FROM t WHERE spent - micro <= 5000000""")
def q_cost_bounded_run(spark, d):
    rows = priced(spark, d).where("micro is not null").select("id", "micro", "cost_usd")
    out = L.cost_bounded(rows, rows.where("id % 3 = 0").select("id"), 5)
    return out.select("id", "micro", (F.col("spent") * 1_000_000).cast("long").alias("spent"), "complete")


@query("q_run_admission", f"""WITH {PRICED_SQL}, r AS (SELECT user_id % 10 AS run, sum(prompt_tokens * 3 + 1024 * 15)::BIGINT AS estimate FROM query_log GROUP BY 1),
    s AS (SELECT sum(micro)::BIGINT AS spent FROM priced WHERE created_at < TIMESTAMP '2024-01-10')
    SELECT run, estimate, estimate > greatest(0, 80000000 - spent) AS refused, greatest(0, estimate - greatest(0, 80000000 - spent))::BIGINT AS shortfall FROM r, s""")
def q_run_admission(spark, d):
    runs = query_log(spark, d).groupBy((F.col("user_id") % 10).alias("run")).agg(F.sum(F.col("prompt_tokens") * 3 + 1024 * 15).alias("estimate"))
    spent = priced(spark, d).where("created_at < timestamp '2024-01-10'").agg(F.sum("micro").alias("spent"))
    left = F.greatest(F.lit(0), F.lit(80_000_000) - F.col("spent"))
    return runs.crossJoin(F.broadcast(spent)).select("run", "estimate", (F.col("estimate") > left).alias("refused"), F.greatest(F.lit(0), F.col("estimate") - left).alias("shortfall"))


@query("q_daily_running_spend", f"""WITH {PRICED_SQL} SELECT id, (sum(micro) OVER (PARTITION BY created_at::DATE, source ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM priced WHERE micro IS NOT NULL""")
def q_daily_running_spend(spark, d):
    w = Window.partitionBy(F.to_date("created_at"), "source").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return priced(spark, d).where("micro is not null").select("id", F.sum("micro").over(w).alias("spent"))

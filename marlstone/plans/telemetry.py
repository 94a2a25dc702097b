"""Queries of request logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.statistics import exclusive_quantile
from marlstone.operators import telemetry as T
from marlstone.plans.base import query
from marlstone.plans.ledger import PRICED_SQL, priced
from marlstone.sources.tables import QUERY_LOG_SQL, REQUEST_LOG_SQL, query_log, request_log, table

ROUTED_SQL = f"{REQUEST_LOG_SQL}, routed AS (SELECT *, coalesce(CASE WHEN path IN ('/query', '/documents') THEN path END, '__unmatched__') AS route FROM request_log)"


def routed(spark, d):
    """Requests with their route: a registered path, or one label for all others."""
    known = spark.createDataFrame([("/query",), ("/documents",)], "route string")
    rows = request_log(spark, d)
    return rows.join(F.broadcast(known), rows["path"] == known["route"], "left").withColumn("route", F.coalesce("route", F.lit("__unmatched__")))


@query("q_route_label", f"WITH {ROUTED_SQL} SELECT event_id, route FROM routed")
def q_route_label(spark, d):
    return routed(spark, d).select("event_id", "route")


@query("q_log_level", f"WITH {REQUEST_LOG_SQL} SELECT event_id, CASE WHEN path = '/ingest' THEN 'DEBUG' WHEN status >= 500 THEN 'WARNING' ELSE 'INFO' END AS level FROM request_log")
def q_log_level(spark, d):
    return request_log(spark, d).select("event_id", T.log_level(F.coalesce("path", F.lit("")), F.col("status")).alias("level"))


@query("q_log_parse", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def q_log_parse(spark, d):
    return table(spark, d, "events").withColumn("j", F.from_json("props", "k long, absent string")).select("event_id", "j.k", "j.absent")


@query("q_request_id", """SELECT event_id, CASE WHEN regexp_full_match(raw, '[A-Za-z0-9_.:-]{1,64}') THEN raw ELSE substr(sha256(event_id::VARCHAR), 1, 32) END AS request_id
    FROM (SELECT event_id, event_type || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE ':' END || user_id AS raw FROM events)""")
def q_request_id(spark, d):
    raw = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, " ").otherwise(":"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", T.request_id(raw, F.col("event_id")).alias("request_id"))


@query("q_query_sha", f"WITH {QUERY_LOG_SQL} SELECT id, substr(sha256(question), 1, 12) AS query_sha FROM query_log")
def q_query_sha(spark, d):
    return query_log(spark, d).select("id", F.substring(F.sha2("question", 256), 1, 12).alias("query_sha"))


@query("q_requests_total", f"WITH {ROUTED_SQL} SELECT route, status, count(*) AS n FROM routed GROUP BY ALL")
def q_requests_total(spark, d):
    return routed(spark, d).groupBy("route", "status").agg(F.count(F.lit(1)).alias("n"))


def histogram_sql(name: str) -> str:
    cells = ", ".join(str(b) for b in T.BOUNDS)
    return f"{name} AS (SELECT route, bound, count(*) FILTER (duration_s / 100 <= bound) AS n, round(sum(duration_s / 100), 6) AS total FROM routed, (SELECT unnest([{cells}, 'inf'::DOUBLE]) AS bound) GROUP BY route, bound)"


def histogram(spark, d):
    return T.latency_histogram(routed(spark, d).withColumn("s", F.col("duration_s") / 100), "s", "route").withColumn("total", F.round("total", 6))


@query("q_latency_histogram", f"WITH {ROUTED_SQL}, {histogram_sql('h')} SELECT route, CASE WHEN bound = 'inf'::DOUBLE THEN '+Inf' ELSE bound::VARCHAR END AS bound, n, total FROM h")
def q_latency_histogram(spark, d):
    return histogram(spark, d).withColumn("bound", F.when(F.col("bound") == float("inf"), "+Inf").otherwise(F.col("bound").cast("string")))


@query("q_histogram_quantile", f"""WITH {ROUTED_SQL}, {histogram_sql('h')},
    s AS (SELECT route, bound, n, coalesce(lag(bound) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before, 0.95 * max(n) OVER (PARTITION BY route) AS rank FROM h WINDOW w AS (PARTITION BY route ORDER BY bound)),
    f AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY bound) AS i FROM s WHERE n >= rank)
    SELECT route, round(CASE WHEN bound = 'inf'::DOUBLE THEN low ELSE low + (bound - low) * (rank - before) / (n - before) END, 9) AS p95 FROM f WHERE i = 1""")
def q_histogram_quantile(spark, d):
    return T.histogram_quantile(histogram(spark, d), "route", 0.95).select("route", F.round("quantile", 9).alias("p95"))


@query("q_verdict_totals", f"WITH {PRICED_SQL} SELECT verdict, count(*) AS n, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, coalesce(sum(micro), 0)::BIGINT AS micro FROM priced GROUP BY ROLLUP (verdict)")
def q_verdict_totals(spark, d):
    """Answers, tokens and cost by verdict, and of all; a row without a price costs nothing here and is told by `q_unpriced`."""
    totals = priced(spark, d).rollup("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.coalesce(F.sum("micro"), F.lit(0)).alias("micro"))
    return totals.select("verdict", "n", "prompt_tokens", "completion_tokens", "micro")


@query("q_error_counters", f"WITH {REQUEST_LOG_SQL} SELECT event_ts AS day, count(*) FILTER (error_code IS NOT NULL) AS errors, count(*) FILTER (status = 429) AS shed, count(*) FILTER (error_code = 'budget_exhausted') AS trips, count(*) FILTER (error_code = 'internal_error') AS internal FROM (SELECT *, ts::DATE::VARCHAR AS event_ts FROM request_log) GROUP BY 1")
def q_error_counters(spark, d):
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return request_log(spark, d).groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        n("error_code is not null").alias("errors"), n("status = 429").alias("shed"), n("error_code = 'budget_exhausted'").alias("trips"), n("error_code = 'internal_error'").alias("internal")
    )


CONDITIONS_SQL = "conditions AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {s}, '{p}', '{r}', {str(f).lower()})" for c, s, p, r, f in T.CONDITIONS) + ") v(code, declared, presentation, reset, refusal))"


@query("q_condition_join", f"WITH {REQUEST_LOG_SQL}, {CONDITIONS_SQL} SELECT event_id, error_code, presentation, reset, refusal, code IS NULL AS unknown FROM request_log LEFT JOIN conditions ON code = error_code WHERE error_code IS NOT NULL")
def q_condition_join(spark, d):
    rows = request_log(spark, d).where("error_code is not null").join(F.broadcast(T.conditions(spark)), F.col("code") == F.col("error_code"), "left")
    return rows.select("event_id", "error_code", "presentation", "reset", "refusal", F.col("code").isNull().alias("unknown"))


@query("q_status_contract", f"WITH {REQUEST_LOG_SQL}, {CONDITIONS_SQL} SELECT error_code, status + (event_id % 2)::BIGINT AS status, declared::BIGINT AS declared, count(*) AS n FROM request_log JOIN conditions ON code = error_code WHERE status + event_id % 2 <> declared GROUP BY ALL")
def q_status_contract(spark, d):
    """Statuses that differ from the declared one; odd events stand for a raiser that breaks the contract."""
    rows = request_log(spark, d).withColumn("status", F.col("status") + F.col("event_id") % 2).join(F.broadcast(T.conditions(spark)), F.col("code") == F.col("error_code"))
    return rows.where("status <> declared").groupBy("error_code", "status", "declared").agg(F.count(F.lit(1)).alias("n"))


@query("q_trace_stitch", f"""WITH {REQUEST_LOG_SQL} SELECT request_id, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS started, string_agg(event_type, '>' ORDER BY ts, event_id) AS steps FROM request_log GROUP BY 1""")
def q_trace_stitch(spark, d):
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    rows = request_log(spark, d).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t"), F.array_join(steps, ">").alias("steps"))
    return rows.select("request_id", "n", F.floor(F.unix_micros("t") / 1_000_000).alias("started"), "steps")


ALERT_SQL = """SELECT start, count(*) AS n, count(*) FILTER (status >= 500) AS failures, count(*) FILTER (status = 429) AS pressure, count(*) FILTER (status >= 500) > 0 AS any_failure,
    count(*) FILTER (status = 429) > 0.05 * count(*) AS much_pressure, max(duration_s) > 300 AS too_slow"""


@query("q_alerts", f"WITH {REQUEST_LOG_SQL} {ALERT_SQL} FROM (SELECT *, (floor(epoch(ts) / 900) * 900)::BIGINT AS start FROM request_log) GROUP BY start")
def q_alerts(spark, d):
    return T.alerts(request_log(spark, d))


@query("q_sliding_alerts", f"WITH {REQUEST_LOG_SQL} SELECT start, count(*) AS n, count(*) FILTER (status >= 500) AS failures FROM (SELECT *, unnest(range(0, 3)) AS k, ((floor(epoch(ts) / 300) - k) * 300)::BIGINT AS start FROM request_log) GROUP BY start")
def q_sliding_alerts(spark, d):
    w = F.window("ts", "15 minutes", "5 minutes")
    rows = request_log(spark, d).groupBy(w.alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") >= 500, 1)).alias("failures"))
    return rows.select(F.unix_timestamp("_w.start").alias("start"), "n", "failures")


@query("q_tumbling_metrics", f"WITH {ROUTED_SQL} SELECT route, (floor(epoch(ts) / 900) * 900)::BIGINT AS start, count(*) AS n, round(sum(duration_s), 6) AS total_s FROM routed GROUP BY ALL")
def q_tumbling_metrics(spark, d):
    rows = routed(spark, d).groupBy("route", F.window("ts", "15 minutes").alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_s"), 6).alias("total_s"))
    return rows.select("route", F.unix_timestamp("_w.start").alias("start"), "n", "total_s")


@query("q_absent_series", f"""WITH {ROUTED_SQL}, w AS (SELECT DISTINCT (floor(epoch(ts) / 900) * 900)::BIGINT AS start FROM routed), s AS (SELECT unnest(['/query', '/documents', '/healthz']) AS route)
    SELECT s.route, w.start FROM s, w WHERE NOT EXISTS (SELECT 1 FROM routed r WHERE r.route = s.route AND (floor(epoch(r.ts) / 900) * 900)::BIGINT = w.start)""")
def q_absent_series(spark, d):
    seen = q_tumbling_metrics(spark, d).select("route", "start")
    every = seen.select("start").distinct().withColumn("route", F.explode(F.array(*map(F.lit, ("/query", "/documents", "/healthz")))))
    return every.join(seen, ["route", "start"], "left_anti").select("route", "start")


@query("q_idle_gaps", f"""WITH {REQUEST_LOG_SQL}, g AS (SELECT request_id, ts, lag(ts) OVER (PARTITION BY request_id ORDER BY ts, event_id) AS before FROM request_log)
    SELECT request_id, (epoch_us(ts) - epoch_us(before))::BIGINT AS gap_us FROM g WHERE epoch_us(ts) - epoch_us(before) > 36000000000""")
def q_idle_gaps(spark, d):
    before = F.lag("ts").over(Window.partitionBy("request_id").orderBy("ts", "event_id"))
    gap = F.unix_micros("ts") - F.unix_micros("before")
    return request_log(spark, d).withColumn("before", before).select("request_id", gap.alias("gap_us")).where("gap_us > 36000000000")


#: a request's time is that of its embedding, its retrieval, and the rest; the shares follow from the event's number
STAGES_SQL = "stages AS (SELECT route, unnest(['embed', 'retrieval', 'total']) AS stage, unnest([duration_s * (1 + event_id % 3) / 10, duration_s * (1 + event_id % 4) / 10, duration_s]) AS v FROM routed)"


@query("q_stage_latency", f"""WITH {ROUTED_SQL}, {STAGES_SQL}, r AS (SELECT route, stage, v, row_number() OVER (PARTITION BY route, stage ORDER BY v) AS i, count(*) OVER (PARTITION BY route, stage) AS n FROM stages),
    p AS (SELECT *, 0.95 * (n + 1) AS spot, greatest(least(floor(0.95 * (n + 1)), n - 1), 1) AS j, 0.5 * (n + 1) AS mid, greatest(least(floor(0.5 * (n + 1)), n - 1), 1) AS m FROM r)
    SELECT route, stage, round(min(v) FILTER (i = m) + (min(v) FILTER (i = m + 1) - min(v) FILTER (i = m)) * max(mid - m), 9) AS p50, round(min(v) FILTER (i = j) + (min(v) FILTER (i = j + 1) - min(v) FILTER (i = j)) * max(spot - j), 9) AS p95, max(v) AS slowest FROM p GROUP BY route, stage""")
def q_stage_latency(spark, d):
    """Latency of each route's stages. Sorts nothing by route: order statistics come from histograms."""
    rows = routed(spark, d)
    part = lambda name, v: F.struct(F.lit(name).alias("stage"), v.alias("v"))
    share = lambda m: F.col("duration_s") * (1 + F.col("event_id") % m) / 10
    rows = rows.select("route", F.explode(F.array(part("embed", share(3)), part("retrieval", share(4)), part("total", F.col("duration_s")))).alias("s")).select("route", "s.stage", "s.v")
    at = lambda p, name: exclusive_quantile(rows, "v", ["route", "stage"], p).withColumn("quantile", F.round("quantile", 9)).withColumnRenamed("quantile", name)
    return rows.groupBy("route", "stage").agg(F.max("v").alias("slowest")).join(at(0.5, "p50"), ["route", "stage"]).join(at(0.95, "p95"), ["route", "stage"])


@query("q_embedding_ledger", """WITH e AS (SELECT event_type AS caller, event_id, round(value * 10)::BIGINT AS tokens FROM events),
    r AS (SELECT *, (sum(tokens) OVER (PARTITION BY caller ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM e)
    SELECT caller, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(tokens) * 0.02 / 1e6, 6) AS cost, min(event_id) FILTER (upto - tokens > 500000) AS stopped_at FROM r GROUP BY caller""")
def q_embedding_ledger(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("caller"), "event_id", F.round(F.col("value") * 10).cast("long").alias("tokens"))
    w = Window.partitionBy("caller").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("prior", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return e.groupBy("caller").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") * 0.02 / 1e6, 6).alias("cost"), F.min(F.when(F.col("prior") > 500_000, F.col("event_id"))).alias("stopped_at"))

"""Tables by name, and the views that the queries are written over.

Each view has a DataFrame form here and, for the oracle, the same definition as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Price rows (identity, input and output price of a million tokens, first and last day).
RATES = [
    ("north:alpha", "2.00", "10.00", "2023-01-01", "2024-01-15"),
    ("north:alpha", "3.00", "15.00", "2024-01-16", None),
    ("north:beta", "5.00", "25.00", "2023-01-01", None),
    ("south:gamma", "0.25", "1.25", "2024-01-05", "2024-01-20"),
    ("south:delta", "1.15", "5.05", "2023-01-01", None),
]

IDENTITY = {"view": "north:alpha", "click": "north:beta", "signup": "south:gamma", "purchase": "south:delta", "error": "west:omega"}
VERDICT = {"view": "answered", "click": "answered", "signup": "insufficient_evidence", "purchase": "answered", "error": "error"}
SECTION = " › "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(column, values: dict[str, str]):
    """The value for a column's text; null where there is none."""
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def rates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(RATES, "identity string, i string, o string, f string, u string")
    price = lambda c: F.col(c).cast("decimal(10,4)")
    return rows.select("identity", price("i").alias("input_per_mtok"), price("o").alias("output_per_mtok"), F.to_date("f").alias("effective_from"), F.to_date("u").alias("effective_until"))


RATES_SQL = "rates AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {a}::DECIMAL(10,4), {b}::DECIMAL(10,4), DATE '{f}', {f'DATE {chr(39)}{u}{chr(39)}' if u else 'NULL::DATE'})" for i, a, b, f, u in RATES) + ") v(identity, input_per_mtok, output_per_mtok, effective_from, effective_until))"


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered requests, made of events. Zone-less times are UTC."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("r"), F.col("event_id")).alias("request_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("question "), F.col("user_id")).alias("question"),
        chosen(F.col("event_type"), IDENTITY).alias("identity"),
        F.round(F.abs("value") * 100).cast("long").alias("prompt_tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"),
        F.when(F.col("user_id") % 10 == 0, "eval").when(F.col("user_id") % 10 == 1, "operator").otherwise("visitor").alias("source"),
        chosen(F.col("event_type"), VERDICT).alias("verdict"),
        F.round(F.col("value") * 20).cast("long").alias("latency_ms"),
        F.col("event_type"),
        F.col("user_id"),
        F.col("value"),
    )


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


QUERY_LOG_SQL = f"""query_log AS (
    SELECT event_id AS id, 'r' || event_id AS request_id, ts AS created_at, 'question ' || user_id AS question,
           {_case('event_type', IDENTITY)} AS identity, round(abs(value) * 100)::BIGINT AS prompt_tokens,
           json_extract_string(props, '$.k')::BIGINT AS completion_tokens,
           CASE WHEN user_id % 10 = 0 THEN 'eval' WHEN user_id % 10 = 1 THEN 'operator' ELSE 'visitor' END AS source,
           {_case('event_type', VERDICT)} AS verdict, round(value * 20)::BIGINT AS latency_ms, event_type, user_id, value
    FROM events)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of documents as chunks."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where(F.trim("text") != "")
    path = F.concat_ws(SECTION, "source", "lang", F.concat(F.lit("Part "), F.col("doc_id") % 12))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", path.alias("section_path"), F.col("lang").alias("doc_type"), "source")


CHUNKS_SQL = """chunks AS (
    SELECT doc_id, line_no::BIGINT AS line_no, text, source || ' › ' || lang || ' › Part ' || (doc_id % 12) AS section_path, lang AS doc_type, source
    FROM (SELECT doc_id, source, lang, unnest(range(len(w))) AS line_no, unnest(w) AS text
          FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS w FROM documents))
    WHERE trim(text, ' ') <> '')"""


ROUTES = {"view": "/query", "click": "/documents", "signup": "/ingest", "purchase": "/query", "error": None}


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion records of requests, made of events."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", F.when(F.col("value") > 100, 503).when(F.col("value") > 30, 500).otherwise(404)).when(F.col("value") > 150, 429).otherwise(200)
    code = F.when(status == 503, "budget_exhausted").when(status == 500, "internal_error").when(status == 404, "not_found").when(status == 429, "rate_limited")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("r"), F.col("user_id")).alias("request_id"),
        chosen(F.col("event_type"), {k: v for k, v in ROUTES.items() if v}).alias("path"),
        status.cast("long").alias("status"),
        F.col("value").alias("duration_s"),
        code.alias("error_code"),
        "event_type",
    )


REQUEST_LOG_SQL = f"""request_log AS (
    SELECT event_id, ts, 'r' || user_id AS request_id, {_case('event_type', {k: v for k, v in ROUTES.items() if v})} AS path, status, value AS duration_s,
           CASE status WHEN 503 THEN 'budget_exhausted' WHEN 500 THEN 'internal_error' WHEN 404 THEN 'not_found' WHEN 429 THEN 'rate_limited' END AS error_code,
           event_type
    FROM (SELECT *, (CASE WHEN event_type = 'error' THEN CASE WHEN value > 100 THEN 503 WHEN value > 30 THEN 500 ELSE 404 END
                          WHEN value > 150 THEN 429 ELSE 200 END)::BIGINT AS status FROM events))"""

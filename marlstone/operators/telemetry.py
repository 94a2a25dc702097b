"""Request counts, histograms, failure counters, traces and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets, in seconds.
BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
#: Error code, its status, how it is presented, when it resets, whether it is a refusal.
CONDITIONS = [
    ("budget_exhausted", 503, "explanatory", "window", True),
    ("budget_pressure", 503, "transient", "shortly", True),
    ("overloaded", 503, "transient", "shortly", True),
    ("embedder_mismatch", 503, "degraded", "operator", True),
    ("empty_corpus", 503, "degraded", "operator", True),
    ("upstream_error", 502, "transient", "shortly", True),
    ("misconfigured", 500, "degraded", "operator", False),
    ("internal_error", 500, "degraded", "shortly", False),
    ("unauthenticated", 401, "request", "none", False),
    ("forbidden", 403, "request", "none", False),
    ("not_found", 404, "request", "none", False),
    ("http_error", 400, "request", "none", False),
    ("validation_error", 422, "request", "none", False),
    ("ingest_in_progress", 409, "transient", "shortly", False),
    ("ingest_too_large", 413, "request", "none", False),
]
#: Exception classes of the library and the codes that they are reported as.
ERROR_CODES = {"EmbedderMismatchError": "embedder_mismatch", "EmptyCorpusError": "empty_corpus", "UnknownModelError": "misconfigured"}


def error_code(error_class: Column, codes: dict[str, str] = ERROR_CODES) -> Column:
    """The code of an exception class; null for one that is not the library's own."""
    return F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))[error_class]


def conditions(spark) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, "code string, declared long, presentation string, reset string, refusal boolean")


def latency_histogram(rows: DataFrame, value: str, by: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts by upper bound, the last one infinite; empty buckets are rows too. One pass over `rows`."""
    cells = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"_{k}") for k, b in enumerate(bounds)]
    wide = rows.groupBy(by).agg(*cells, F.count(F.lit(1)).alias("_all"), F.sum(value).alias("total"))
    steps = F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"_{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("bound"), F.col("_all").alias("n")))
    return wide.select(by, "total", F.explode(steps).alias("_b")).select(by, F.col("_b.bound").alias("bound"), F.col("_b.n").alias("n"), "total")


def histogram_quantile(histogram: DataFrame, by: str, q: float) -> DataFrame:
    """The q quantile, linear inside its bucket; in the infinite bucket its lower bound."""
    w = Window.partitionBy(by).orderBy("bound")
    total = F.max("n").over(Window.partitionBy(by))
    rows = histogram.withColumn("_low", F.coalesce(F.lag("bound").over(w), F.lit(0.0))).withColumn("_before", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("_rank", q * total)
    first = rows.where("n >= _rank").groupBy(by).agg(F.min(F.struct("bound", "_low", "_before", "n", "_rank")).alias("_f"))
    f = F.col("_f")
    inside = f["_low"] + (f["bound"] - f["_low"]) * (f["_rank"] - f["_before"]) / (f["n"] - f["_before"])
    return first.select(by, F.when(f["bound"] == float("inf"), f["_low"]).otherwise(inside).alias("quantile"))


def log_level(path: Column, status: Column) -> Column:
    return F.when(path.isin("/healthz", "/ingest"), "DEBUG").when(status >= 500, "WARNING").otherwise("INFO")


def request_id(raw: Column, otherwise: Column) -> Column:
    """A well-formed id as it is, else a hash of `otherwise`."""
    return F.when(raw.rlike(r"^[A-Za-z0-9_.:-]{1,64}$"), raw).otherwise(F.substring(F.sha2(otherwise.cast("string"), 256), 1, 32))


def alerts(rows: DataFrame, seconds: int = 900) -> DataFrame:
    """By window: requests, failures, share of pressure, and which rules fire."""
    w = F.window("ts", f"{seconds} seconds")
    out = rows.groupBy(w.alias("_w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("status") >= 500, 1).otherwise(0)).alias("failures"),
        F.sum(F.when(F.col("status") == 429, 1).otherwise(0)).alias("pressure"),
        F.max("duration_s").alias("slowest"),
    )
    return out.select(
        F.unix_timestamp("_w.start").alias("start"), "n", "failures", "pressure",
        (F.col("failures") > 0).alias("any_failure"), (F.col("pressure") > 0.05 * F.col("n")).alias("much_pressure"), (F.col("slowest") > 300).alias("too_slow"),
    )


def budget_alerts(snapshots: DataFrame, seconds: int = 900, least: float = 1.0, oldest: float = 900.0) -> DataFrame:
    """By window of (ts, remaining_usd, reserved_usd, age_s): the least headroom, the oldest snapshot and the most that is
    reserved, and which rules fire. A figure that no row of a window holds is absent, which is an alert of its own."""
    out = snapshots.groupBy(F.window("ts", f"{seconds} seconds").alias("_w")).agg(
        F.min("remaining_usd").alias("headroom"), F.max("age_s").alias("age_s"), F.max("reserved_usd").alias("reserved")
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        F.unix_timestamp("_w.start").alias("start"), "headroom", "age_s", "reserved",
        no(F.col("headroom") < least).alias("little_headroom"), no(F.col("age_s") > oldest).alias("old_snapshot"), no(F.col("reserved") >= F.col("headroom")).alias("all_reserved"),
        (F.col("headroom").isNull() | F.col("age_s").isNull() | F.col("reserved").isNull()).alias("absent"),
    )

"""Effective-dated prices, exact costs, spend windows, ceilings and reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_rate(rows: DataFrame, rates: DataFrame, day: Column, how: str = "left") -> DataFrame:
    """The price in force on a day; both ends of an interval are in it, an open end is null.

    The identity is an equal key, so the interval is a condition of a hash join."""
    covers = (F.col("_day") >= F.col("effective_from")) & (F.col("effective_until").isNull() | (F.col("_day") <= F.col("effective_until")))
    r = rates.withColumnRenamed("identity", "_identity")
    return rows.withColumn("_day", day).join(r, (F.col("identity") == F.col("_identity")) & covers, how).drop("_identity", "_day")


def cost(prompt: Column, completion: Column, input_price: Column, output_price: Column) -> Column:
    """Price of the tokens to six places, half to even."""
    tokens = lambda c: c.cast("decimal(18,0)")
    return F.bround((tokens(prompt) * input_price + tokens(completion) * output_price) / F.lit(1_000_000), 6).cast("decimal(18,6)")


#: Tokens that a provider puts round the messages, and the most that it answers with.
STRUCTURE_TOKENS, MOST_OUTPUT = 64, 4096


def worst_cost(prompt: Column, system: str, input_price: Column, output_price: Column, most_output: int = MOST_OUTPUT) -> Column:
    """What a rendered prompt (null: nothing was retrieved, so nothing is asked) can cost at most: no byte-level encoding of a
    text has more tokens than the text has bytes, and the answer has `most_output` tokens at most."""
    tokens = F.octet_length(F.concat(F.lit(system), prompt)) + STRUCTURE_TOKENS
    return F.when(prompt.isNull(), F.lit(0).cast("decimal(18,6)")).otherwise(cost(tokens, F.lit(most_output), input_price, output_price))


def priced(rows: DataFrame, rates: DataFrame) -> DataFrame:
    return with_rate(rows, rates, F.to_date("created_at")).withColumn("cost_usd", cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("input_per_mtok"), F.col("output_per_mtok")))


def unpriced(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows without a price: of an identity without any, or of a day that none covers."""
    known = rates.select("identity").distinct()
    none = rows.join(known, "identity", "left_anti").withColumn("reason", F.lit("no rates"))
    some = with_rate(rows.join(known, "identity", "left_semi"), rates, F.to_date("created_at")).where("effective_from is null")
    return none.unionByName(some.select(*rows.columns).withColumn("reason", F.lit("no rate that day")))


def derived_daily_limit(monthly: Column, day: Column) -> Column:
    """The month's limit by its days, rounded down to the cent, a cent at least."""
    return F.greatest(F.floor(monthly.cast("decimal(18,6)") / F.dayofmonth(F.last_day(day)), 2), F.lit(0.01).cast("decimal(18,2)"))


def daily_limit(monthly: Column, override: Column, day: Column) -> Column:
    """The derived limit, or the override up to twice that; without a monthly limit the override as it is."""
    derived = derived_daily_limit(monthly, day)
    return F.when(monthly.isNull(), override).when(override.isNull(), derived).otherwise(F.least(override, 2 * derived))


def limit_origin(monthly: Column, override: Column, day: Column) -> Column:
    """Where the daily limit comes from: the override alone, the month, an override within twice the month's share or cut to it."""
    most = 2 * derived_daily_limit(monthly, day)
    return F.when(monthly.isNull() & override.isNull(), "none").when(monthly.isNull(), "override").when(override.isNull(), "derived").when(override > most, "capped").otherwise("burst")


def ceiling_trips(rows: DataFrame, daily: float, monthly: float) -> DataFrame:
    """Running spend by UTC day (visitors) and month (all) with what trips at >=; the month outranks the day.

    A day opens with what the days of its month before it have spent, so only a day's rows are run through together."""
    upto = Window.partitionBy("_d").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    visitor = F.when(F.col("source") == "visitor", F.col("cost_usd"))
    out = rows.withColumn("_d", F.to_date("created_at")).withColumn("_m", F.date_trunc("month", "created_at"))
    days = out.groupBy("_m", "_d").agg(F.sum("cost_usd").alias("_s"))
    opening = days.select("_d", F.coalesce(F.sum("_s").over(Window.partitionBy("_m").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_open"))
    out = out.join(opening, "_d", "left").withColumn("spent_day", F.coalesce(F.sum(visitor).over(upto), F.lit(0))).withColumn("spent_month", F.col("_open") + F.sum("cost_usd").over(upto)).drop("_open")
    trips = F.when(F.col("spent_month") >= monthly, "monthly").when((F.col("source") == "visitor") & (F.col("spent_day") >= daily), "daily")
    return out.withColumn("tripped", trips)


def reservation_sweep(reservations: DataFrame) -> DataFrame:
    """Outstanding amounts over time: each reservation adds at reserved_at and leaves at settled_at.

    Visitors press the daily and the monthly ceiling, others the monthly one."""
    begin = reservations.select(F.col("reserved_at").alias("at"), "request_id", "source", F.col("amount").alias("change"))
    end = reservations.where("settled_at is not null").select(F.col("settled_at").alias("at"), "request_id", "source", (-F.col("amount")).alias("change"))
    day = F.to_date("at")
    w = Window.partitionBy("day").orderBy("at", F.col("change"), "request_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moves = begin.unionByName(end).withColumn("day", day)
    visitor = F.when(F.col("source") == "visitor", F.col("change")).otherwise(F.lit(0))
    #: a day opens with what is left of the days before
    totals = moves.groupBy("day").agg(F.sum("change").alias("net"), F.sum(visitor).alias("net_v"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select("day", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("open"), F.coalesce(F.sum("net_v").over(before), F.lit(0)).alias("open_v"))
    run = moves.withColumn("m", F.sum("change").over(w)).withColumn("v", F.sum(visitor).over(w)).join(opening, "day")
    return run.select("day", "at", "request_id", "change", (F.col("open") + F.col("m")).alias("outstanding_month"), (F.col("open_v") + F.col("v")).alias("outstanding_day"))


def cost_bounded(rows: DataFrame, done: DataFrame, bound: float, order: str = "id") -> DataFrame:
    """A run with resume: rows not yet done, up to and with the first whose cost reaches beyond the bound, with `complete`,
    whether that is all of them. Ids are numbers."""
    todo = rows.join(done, order, "left_anti")
    #: sums by runs of ids first, so that a long run isn't one window
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    todo = todo.withColumn("_part", F.floor(F.col(order) / 10_000))
    parts = todo.groupBy("_part").agg(F.sum("cost_usd").alias("_s"))
    opening = parts.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    run = todo.join(opening, "_part").withColumn("spent", F.col("_o") + F.sum("cost_usd").over(w))
    within = F.col("spent") - F.col("cost_usd") <= bound
    complete = parts.agg((F.sum("_s") <= bound).alias("_all")).crossJoin(run.agg(F.min(within).alias("_each"))).select((F.col("_all") | F.col("_each")).alias("complete"))
    return run.where(within).drop("_part", "_o").crossJoin(F.broadcast(complete))

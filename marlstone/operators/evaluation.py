"""Paired evaluation of retrieval and refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.statistics import mcnemar_exact, unpaired_difference


def yes(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("long")


def recall(rank: str, k: int) -> Column:
    """Share of all questions, misses included, with a hit among the first k."""
    return F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0))


def mean_reciprocal_rank(rank: str) -> Column:
    return F.round(F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))), 9)


def paired_outcomes(hits: DataFrame, first: str, second: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The 2 x 2 table of two arms over the same questions (arm, query_id, hit_rank, ...)."""
    a = hits.where(F.col("arm") == first).select("query_id", *by, F.col("hit_rank").isNotNull().alias("_a"))
    b = hits.where(F.col("arm") == second).select("query_id", F.col("hit_rank").isNotNull().alias("_b"))
    rows = a.join(b, "query_id")
    x, y = F.col("_a"), F.col("_b")
    return rows.groupBy(*by).agg(
        F.sum(yes(x & y)).alias("both"), F.sum(yes(x & ~y)).alias("first_only"), F.sum(yes(~x & y)).alias("second_only"), F.sum(yes(~x & ~y)).alias("neither")
    ).withColumn("n_discordant", F.col("first_only") + F.col("second_only"))


def outcome(table: DataFrame, alpha: float = 0.05, least: int = 6) -> DataFrame:
    """p of the exact test and whether it decides: at least `least` discordant pairs and p below alpha."""
    p = F.round(mcnemar_exact(F.col("first_only"), F.col("second_only")), 9)
    enough = F.col("n_discordant") >= least
    decided = enough & (F.col("p") < alpha)
    return table.withColumn("p", p).withColumn("conclusive", decided).withColumn("winner", F.when(decided, F.when(F.col("first_only") > F.col("second_only"), "first").otherwise("second"))).withColumn(
        "reason", F.when(~enough, "too few discordant pairs").when(~decided, "p is not below alpha").otherwise("decided")
    )


def cumulative_sizing(blocks: DataFrame, required: tuple[int, ...] = (6, 15, 23)) -> DataFrame:
    """Running questions, discordant pairs and their rate by block, and the questions that each requirement would take."""
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocks.withColumn("n_so_far", F.sum("n").over(w)).withColumn("discordant_so_far", F.sum("n_discordant").over(w))
    rate = F.col("discordant_so_far") / F.col("n_so_far")
    for r in required:
        out = out.withColumn(f"need_{r}", F.when(F.col("discordant_so_far") > 0, F.ceil(F.round(F.lit(r) / rate, 9))))
    return out.withColumn("r", F.round(rate, 9))


def refusal_outcome(a: Column, b: Column, control: Column) -> Column:
    """What refusal rates of two unanswerable arms and of an answerable control arm decide. A control arm that refuses more
    than a fifth makes the first outcome unavailable; what falls between the limits is indeterminate."""
    high, low = F.lit(0.8), F.lit(0.5)
    named = F.when((a >= high) & (b >= high) & (control <= 0.2), "refuses both").when((b >= high) & (a <= low), "refuses the second only").when(b <= low, "refuses neither")
    return F.coalesce(named, F.lit("indeterminate"))


def refusal_report(cases: DataFrame, by: str, first: str = "A", second: str = "B", control: str = "C") -> DataFrame:
    """Refusals (arm, declined) of three arms by group: their rates, the difference second - first with its interval, outcome."""
    arms = (first, second, control)
    counts = cases.groupBy(by).agg(*(F.count(F.when(F.col("arm") == x, 1)).alias(f"n_{k}") for k, x in enumerate(arms)), *(F.count(F.when((F.col("arm") == x) & F.col("declined"), 1)).alias(f"x_{k}") for k, x in enumerate(arms)))
    counts = counts.where("n_0 > 0 and n_1 > 0 and n_2 > 0")
    rate = [F.col(f"x_{k}") / F.col(f"n_{k}") for k in range(3)]
    difference, low, high = unpaired_difference(F.col("x_1"), F.col("n_1"), F.col("x_0"), F.col("n_0"))
    shown = [F.round(rate[k], 9).alias(name) for k, name in enumerate(("rate_first", "rate_second", "rate_control"))]
    return counts.select(by, *shown, F.round(difference, 9).alias("difference"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), refusal_outcome(*rate).alias("outcome"))


def comparison_flags(figures: DataFrame) -> DataFrame:
    """Comparisons (n, b, c, p, alpha, floor, first, second, low, high of the difference, split_low, split_high, metric,
    metric_high) with what follows from them: difference_value, outcome, desaturated, desaturated_at_the_bound, and the
    rules that they break, in order."""
    difference = F.col("first") - F.col("second")
    decided = (F.col("b") + F.col("c") >= F.col("floor")) & (F.col("p") < F.col("alpha"))
    rules = {
        "pairs above n": F.col("b") + F.col("c") > F.col("n"),
        "difference outside its interval": ~F.round(difference, 9).between(F.col("low"), F.col("high")),
        "interval of the split": (F.col("low") == F.col("split_low")) & (F.col("high") == F.col("split_high")),
        "metric above its bound": F.col("metric") > F.col("metric_high"),
    }
    broken = F.array_join(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items()))), ", ")
    return figures.select(
        "*", F.round(difference, 9).alias("difference_value"), F.when(~decided, "inconclusive").when(difference >= 0, "first").otherwise("second").alias("outcome"),
        (F.col("metric") < 1).alias("desaturated"), (F.col("metric_high") < 1).alias("desaturated_at_the_bound"), broken.alias("broken"),
    )

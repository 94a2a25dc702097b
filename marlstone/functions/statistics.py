"""Closed-form statistics as columns, and the one that needs a solver as an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Exact two-sided p of b and c discordant pairs; 1 without any. Terms are summed in log space, so large counts do not underflow."""
    n, k = b + c, F.least(b, c)
    log_half = F.lit(-0.6931471805599453)
    #: (log of the term, sum of terms): each term follows from the one before
    start = F.struct((n * log_half).alias("t"), F.exp(n * log_half).alias("s"))
    after = lambda acc, i: F.struct((acc["t"] + F.ln((n - i + 1) / i)).alias("t"), (acc["s"] + F.exp(acc["t"] + F.ln((n - i + 1) / i))).alias("s"))
    tail = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, after, lambda acc: acc["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def removals_survived(b: Column, c: Column, alpha: float = 0.05, places: int = 9) -> Column:
    """How many of c discordant pairs may go with p, to `places` digits, still below alpha and c still above b; null if none.

    With b the smaller count, p falls as c grows, so the least c that decides is looked for from b on: n grows by one pair,
    P(X <= b) of n pairs is that of n - 1 less half of P(X = b), and each of these follows from the one before: b + c steps."""
    to = lambda x, y: F.when(x <= y, F.sequence(x.cast("long"), y.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    middle = F.aggregate(to(F.lit(1), b), F.lit(0.0), lambda t, i: t + F.ln((2 * i - 1) / (2 * i)))
    start = F.struct(middle.alias("t"), (0.5 + F.exp(middle) / 2).alias("s"), F.lit(None).cast("long").alias("least"))

    def after(acc, i):
        s = acc["s"] - F.exp(acc["t"]) / 2
        return F.struct((acc["t"] + F.ln((b + i) / (2 * i))).alias("t"), s.alias("s"), F.coalesce(acc["least"], F.when(F.round(2 * s, places) < alpha, i)).alias("least"))

    return c - F.aggregate(to(b + 1, c), start, after, lambda acc: acc["least"])


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion x / n."""
    p = x / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def unpaired_difference(x1: Column, n1: Column, x2: Column, n2: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Difference of two proportions with its interval by square-and-add of Wilson bounds."""
    (l1, u1), (l2, u2) = wilson(x1, n1, z), wilson(x2, n2, z)
    d = x1 / n1 - x2 / n2
    return d, d - F.sqrt((x1 / n1 - l1) ** 2 + (u2 - x2 / n2) ** 2), d + F.sqrt((u1 - x1 / n1) ** 2 + (x2 / n2 - l2) ** 2)


def paired_difference(both: Column, first: Column, second: Column, neither: Column, z: float = Z95, corrected: bool = False) -> tuple[Column, Column, Column]:
    """Difference of two paired proportions with its interval; the correlation term is 0 on a degenerate margin. `corrected`
    lowers a positive term by half the number of pairs, as some authors have it."""
    n = both + first + second + neither
    x1, x2 = both + first, both + second
    (l1, u1), (l2, u2) = wilson(x1, n, z), wilson(x2, n, z)
    p1, p2 = x1 / n, x2 / n
    margin = x1 * (n - x1) * x2 * (n - x2)
    excess = both * neither - first * second
    lowered = F.when(excess > 0, F.greatest(excess - n / 2, F.lit(0.0))).otherwise(excess.cast("double")) if corrected else excess.cast("double")
    phi = F.when(margin == 0, F.lit(0.0)).otherwise(lowered / F.sqrt(margin.cast("double")))
    d = p1 - p2
    low = F.sqrt((p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2)
    high = F.sqrt((u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2)
    return d, d - low, d + high


def _beta_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial, 0 < k <= n: the regularised incomplete beta function of k and n - k + 1 by its continued
    fraction, whose length grows with the root of n at most."""
    from math import exp, lgamma, log, log1p

    a, b = k, n - k + 1
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(p) + b * log1p(-p))
    swap = p > (a + 1) / (a + b + 2)
    if swap:
        a, b, p = b, a, 1 - p
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * p / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value, m, change = d, 1, 0.0
    while abs(change - 1) > 1e-15 and m < 100_000:
        for step in (m * (b - m) * p / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * p / ((a + 2 * m) * (a + 2 * m + 1))):
            c, d = 1 + step / c, 1 + step * d
            c, d = (c if abs(c) > tiny else tiny), 1 / (d if abs(d) > tiny else tiny)
            change = c * d
            value *= change
        m += 1
    return 1 - front * value / a if swap else front * value / a


def clopper_pearson(alpha: float = 0.05):
    """An Arrow function (x, n) -> exact interval of a proportion; bisects the binomial tails of each row."""

    @F.pandas_udf("low double, high double")
    def bounds(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for k, m in zip(x.astype(int), n.astype(int)):
            ends = []
            for lower in (True, False):
                if (lower and k == 0) or (not lower and k == m):
                    ends.append(0.0 if lower else 1.0)
                    continue
                lo, hi = 0.0, 1.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    value = _beta_tail(k, m, mid) if lower else 1 - _beta_tail(k + 1, m, mid)
                    lo, hi = (mid, hi) if (value < alpha / 2) == lower else (lo, mid)
                ends.append((lo + hi) / 2)
            out.append(ends)
        return pd.DataFrame(out, columns=["low", "high"])

    return bounds


#: Accuracy of the bounds between which an order statistic is looked for, and the rows of a group that need no bounds.
ACCURACY, FEW = 20_000, 40_000


def exclusive_quantile(df, value: str, by: list[str], p: float, few: int = FEW):
    """The p quantile by the exclusive definition, at place p * (n + 1) between two order statistics; nulls are no values.

    A first pass finds bounds for the place of each group by mergeable summaries, whose error in rank is known; a second one
    counts the rows below them and the rows of each value between them, and only these values are put in order. So a group of
    n rows brings a few n / ACCURACY values to one task, and groups of up to `few` rows their values."""
    from pyspark.sql import Window

    names = by or ["_g"]
    rows = df.select(*(by or [F.lit(0).alias("_g")]), F.col(value).cast("double").alias("_v")).where("_v is not null")
    #: the summary is off by n / ACCURACY places at most, and the place from p * n by two
    slack = 2 / ACCURACY + 3 / few
    bounds = F.percentile_approx("_v", F.array(F.lit(max(p - slack, 0.0)), F.lit(min(p + slack, 1.0))), ACCURACY)
    groups = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), bounds.alias("_b"))
    at = F.lit(p) * (F.col("_n") + 1)
    place = F.greatest(F.least(F.floor(at), F.col("_n") - 1), F.lit(1))
    large = F.col("_n") > few
    groups = groups.select(
        *(F.col(c).alias(f"_r{k}") for k, c in enumerate(names)), place.alias("_j"), (at - place).alias("_f"), F.least(place + 1, F.col("_n")).alias("_next"),
        F.when(large, F.col("_b")[0]).otherwise(F.col("_least")).alias("_low"), F.when(large, F.col("_b")[1]).otherwise(F.col("_most")).alias("_high"),
    )
    near = rows.join(groups, [F.col(c).eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate(names)]).where("_v <= _high")
    values = near.groupBy(*names, "_j", "_next", "_f", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    values = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*names).orderBy(F.asc_nulls_first("_v"))))
    first, second = (F.min(F.when(F.col("_upto") >= F.col(c), F.col("_v"))) for c in ("_j", "_next"))
    return values.groupBy(*names).agg((first + (second - first) * F.max("_f")).alias("quantile"))

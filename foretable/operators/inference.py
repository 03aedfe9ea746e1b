"""Tests and intervals over day means, as relations: windows over the days of a group, column functions for tails, and draws that a
hash of their place decides, so that every engine and every partitioning draws the same days."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretable.functions.measures import share

#: Terms of the continued fraction; about the root of the degrees of freedom is enough.
TERMS = 300


def t_two_sided(t: Column, df: Column) -> Column:
    """The probability of a value of Student's t at least as far from 0 (df: whole, 1 or more): the regularised incomplete beta
    function I_x(df / 2, 1 / 2) at x = df / (df + t * t), as a continued fraction on the side where it converges fast."""
    a, b, x = df / 2, F.lit(0.5), df / (df + t * t)
    # gamma((n + 1) / 2) / gamma(n / 2), from n = 1 on: one value and the next multiply to n / 2
    first = F.lit(1 / math.sqrt(math.pi))
    ratio = F.when(df > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(df - 1, F.lit(1)).cast("int")), first, lambda r, n: n / 2 / r)).otherwise(first)
    front = F.pow(x, a) * F.sqrt(1 - x) * ratio / math.sqrt(math.pi)
    near = front / (a * _fraction(a, b, x))
    far = 1 - front / (b * _fraction(b, a, 1 - x))
    return F.when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """1 + d1 / (1 + d2 / (1 + ...)) of the incomplete beta function, from its last term to its first."""

    def term(j: Column) -> Column:
        m = F.floor(j / 2)
        return F.when(j % 2 == 0, m * (b - m) * x).otherwise(-(a + m) * (a + b + m) * x) / ((a + j - 1) * (a + j))

    return F.aggregate(F.sequence(F.lit(TERMS), F.lit(1)), F.lit(1.0), lambda acc, j: 1 + term(j) / acc)


def dm_test(diffs: DataFrame, by: list[str], lag: int = 1) -> DataFrame:
    """(by, days, mean_diff, stat, p) from day differences (by, day, d): Diebold-Mariano with a Bartlett long-run variance of at most
    lag days (never more than days - 2) and the small-sample correction. stat and p are null below 5 days or without variance."""
    group = Window.partitionBy(*by)
    days = diffs.withColumn("__e", F.col("d") - F.avg("d").over(group))
    days = days.withColumns({f"__e{k}": F.col("__e") * F.lag("__e", k).over(group.orderBy("day")) for k in range(1, lag + 1)})
    sums = days.groupBy(*by).agg(
        F.count("*").alias("days"), F.avg("d").alias("mean_diff"), F.sum(F.col("__e") * F.col("__e")).alias("__e0"), *(F.sum(f"__e{k}").alias(f"__e{k}") for k in range(1, lag + 1)),
    )
    t = F.col("days")
    used = F.least(F.lit(lag), t - 2)
    later = (F.when(used >= k, 2 * (1 - k / (used + 1)) * F.col(f"__e{k}")).otherwise(0.0) for k in range(1, lag + 1))
    variance, h = reduce(lambda x, y: x + y, later, F.col("__e0")) / t, used + 1
    sums = sums.withColumn("__v", variance)
    stat = F.col("mean_diff") / F.sqrt(F.col("__v") / t) * F.sqrt((t + 1 - 2 * h + h * (h - 1) / t) / t)
    out = sums.withColumn("stat", F.when((t >= 5) & (F.col("__v") > 0), stat)).withColumn("p", t_two_sided(F.col("stat"), t - 1))
    return out.select(*by, "days", "mean_diff", "stat", "p")


def block_bootstrap(diffs: DataFrame, by: list[str], blocks: tuple[int, ...] = (1, 2, 3, 4), draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, block, days, mean_diff, low, high, p_sign): the 95 % interval of the mean over a group's days, drawn as moving blocks (1: days
    alone), and twice the smaller part of the draws at or beyond 0. diffs: (by, day, d), one row a day.

    Where block q of a draw begins is the first 15 hexadecimal digits of md5("seed|keys|block|draw|q") modulo the places where a
    block can begin; the last block of a draw is cut to the group's number of days. Draws meet days by an equi-join on group and
    place, so neither a group's days nor its draws are held in one task."""
    ordered = Window.partitionBy(*by).orderBy("day")
    days = diffs.select(*(F.col(c).alias(f"__{c}") for c in by), "d", (F.row_number().over(ordered) - 1).alias("__i"))
    groups = diffs.groupBy(*by).agg(F.count("*").alias("days"), F.avg("d").alias("mean_diff"))
    wanted = groups.withColumn("block", F.explode(F.array(*map(F.lit, blocks)))).withColumn("__size", F.least("block", F.col("days")).cast("long"))
    drawn = wanted.withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(*by, "block", "__draw")
    drawn = drawn.withColumn("__q", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("days") - 1) / F.col("__size")))))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), "block", "__draw", "__q").cast("binary")), 1, 15)
    start = F.pmod(F.conv(digits, 16, 10).cast("long"), F.col("days") - F.col("__size") + 1)
    held = F.least(F.col("__size"), F.col("days") - F.col("__q") * F.col("__size"))  # days of the block that the draw holds
    drawn = drawn.select(*by, "block", "days", "mean_diff", "__draw", F.explode(F.sequence(start, start + held - 1)).alias("__i"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [drawn["__i"] == days["__i"]]
    means = drawn.join(days, same).groupBy(*by, "block", "days", "mean_diff", "__draw").agg(F.avg("d").alias("m"))
    return means.groupBy(*by, "block", "days", "mean_diff").agg(
        F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"),
        F.least(F.lit(1.0), 2 * F.least(share(F.col("m") <= 0), share(F.col("m") >= 0))).alias("p_sign"),
    )


def bootstrap_ci(diffs: DataFrame, by: list[str], block: int = 1, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """block_bootstrap with one length of blocks: (by, days, mean_diff, low, high, p_sign)."""
    return block_bootstrap(diffs, by, (block,), draws, seed).drop("block")


def range_quantile(k: int, level: float = 0.95) -> float:
    """The quantile of the range of k standard normal values."""
    z = np.linspace(-9, 9, 4001)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))

    def below(q: float) -> float:
        shifted = 0.5 * (1 + np.array([math.erf((v - q) / math.sqrt(2)) for v in z]))
        return float(k * np.trapezoid(density * (cdf - shifted) ** (k - 1), z))

    low, high = 0.0, 12.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < level else (low, middle)
    return (low + high) / 2


def mcb(ranks: DataFrame, by: list[str], methods: int) -> DataFrame:
    """ranks (by, method, mean_rank, blocks) with cd, the critical difference, and whether a method is in the best set."""
    q = range_quantile(methods) / math.sqrt(2) * math.sqrt(methods * (methods + 1) / 6)
    best = ranks.groupBy(*by).agg(F.min("mean_rank").alias("__best"))
    out = ranks.join(best, by).withColumn("cd", F.lit(q) / F.sqrt("blocks"))
    return out.withColumn("in_best_set", F.col("mean_rank") <= F.col("__best") + F.col("cd")).drop("__best")

"""Scoring: scales, errors by horizon, summaries by any keys, ranks, and paired differences by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretable.functions.measures import pinball, share
from foretable.functions.temporal import bucket, day, lead_days, lead_hours, midnight, plus_hours
from foretable.operators.origins import history
from foretable.protocol import Daily, Grid, Hourly


def hourly_scales(panel: DataFrame, grid: Grid, p: Hourly) -> DataFrame:
    """(series_id, k, origin, scale): the mean seasonal difference of history, of enough pairs, above 0."""
    past = panel.select("series_id", plus_hours(F.col("ts"), p.season).alias("ts"), F.col("y").alias("before"))
    pairs = panel.select("series_id", "ts", "y").join(past, ["series_id", "ts"]).select("series_id", "ts", F.abs(F.col("y") - F.col("before")).alias("d"))
    return _scales(pairs, grid, F.col("ts"), p.min_pairs)


def daily_scales(panel: DataFrame, grid: Grid, p: Daily) -> DataFrame:
    past = panel.select("series_id", F.date_add("date", p.season).alias("date"), F.col("y").alias("before"))
    pairs = panel.select("series_id", "date", "y").join(past, ["series_id", "date"]).select("series_id", "date", F.abs(F.col("y") - F.col("before")).alias("d"))
    return _scales(pairs, grid, midnight(F.col("date")), p.min_pairs)


def _scales(pairs: DataFrame, grid: Grid, ts: Column, least: int) -> DataFrame:
    sums = history(pairs, grid, ts, ["series_id"], {"s": F.col("d"), "n": F.col("d").isNotNull().cast("long")})
    return sums.where((F.col("n") >= least) & (F.col("s") > 0)).select("series_id", "k", "origin", (F.col("s") / F.col("n")).alias("scale"))


def mean_scales(scales: DataFrame) -> DataFrame:
    return scales.groupBy("series_id").agg(F.avg("scale").alias("scale"))


def evaluate_hourly(forecasts: DataFrame, panel: DataFrame, p: Hourly) -> DataFrame:
    """Forecasts (any number of methods) with actuals, lead, bucket and errors; rows outside all buckets are dropped."""
    rows = forecasts.join(panel.select("series_id", "park", "regime", "ts", "y"), ["series_id", "ts"])
    return _errors(rows.withColumn("lead", lead_hours(F.col("origin"), F.col("ts"))), p.buckets)


def evaluate_daily(forecasts: DataFrame, panel: DataFrame, p: Daily, legacy_lead: bool = False) -> DataFrame:
    """As evaluate_hourly. legacy_lead: counts leads from 2, as one published table does."""
    rows = forecasts.join(panel.select("series_id", "park", "regime", "date", "y"), ["series_id", "date"])
    return _errors(rows.withColumn("lead", lead_days(F.col("origin"), F.col("date")) + int(legacy_lead)), p.buckets)


def _errors(rows: DataFrame, buckets: dict[str, tuple[int, int]]) -> DataFrame:
    rows = rows.withColumn("bucket", bucket(F.col("lead"), buckets)).where("bucket IS NOT NULL AND y_hat IS NOT NULL")
    return rows.withColumns({"abs_err": F.abs(F.col("y") - F.col("y_hat")), "sq_err": F.pow(F.col("y") - F.col("y_hat"), F.lit(2))})


def metrics() -> list[Column]:
    e = F.col("abs_err")
    return [
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg("sq_err")).alias("rmse"), F.avg(e / F.col("scale")).alias("mase"),
        share(e <= 5).alias("w5"), share(e <= 10).alias("w10"),
    ]


def summarize(scored: DataFrame, scales: DataFrame, by: list[str]) -> DataFrame:
    """n, mae, rmse, mase, w5, w10 by any keys, of rows whose series has a scale."""
    return scored.join(scales, "series_id").groupBy(*by).agg(*metrics())


def summarize_sets(scored: DataFrame, scales: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The same for several sets of keys in one pass; keys that a set lacks are null, and level tells the set by its number."""
    keys = sorted({k for s in sets for k in s})
    rows = scored.join(scales, "series_id")
    level = F.lit(None).cast("int")
    for i, s in enumerate(sets):
        mask = sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s)
        level = F.when(F.grouping_id() == mask, F.lit(i)).otherwise(level)
    return rows.groupingSets([tuple(F.col(k) for k in s) for s in sets], *keys).agg(*metrics(), level.alias("level"))


def quantile_metrics(frame: DataFrame, by: list[str]) -> DataFrame:
    """Of y, p10, p50, p90 and scale: rows, coverage, mean width, scaled width, and pinball losses over the scale."""
    y, s = F.col("y"), F.col("scale")
    width = F.col("p90") - F.col("p10")
    return frame.groupBy(*by).agg(
        F.count("*").alias("n"), share((y >= F.col("p10")) & (y <= F.col("p90"))).alias("coverage"), F.avg(width).alias("width"), F.avg(width / s).alias("scaled_width"),
        *(F.avg(pinball(y, F.col(f"p{int(q * 100)}"), q) / s).alias(f"pinball_{int(q * 100)}") for q in (0.1, 0.5, 0.9)),
    )


def by_method(scored: DataFrame, scales: DataFrame, methods: list[str], keys: list[str]) -> DataFrame:
    """Wide: the scaled error of each method at each key."""
    rows = scored.join(scales, "series_id").withColumn("ase", F.col("abs_err") / F.col("scale"))
    return rows.groupBy(*keys).pivot("method", methods).agg(F.first("ase", ignorenulls=True))


def block_losses(wide: DataFrame, methods: list[str], by: list[str]) -> DataFrame:
    """Mean loss of each method over its own rows of a block (series and origin); blocks that lack a method are dropped."""
    means = wide.groupBy(*by).agg(*(F.avg(m).alias(m) for m in methods))
    return means.where(" AND ".join(f"{m} IS NOT NULL" for m in methods))


def mean_ranks(losses: DataFrame, methods: list[str], block: list[str], by: list[str]) -> DataFrame:
    """(by, method, mean_rank, blocks): ranks within a block from 1, ties averaged."""
    long = losses.select(*block, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("loss")) for m in methods))).alias("x")).select(*block, "x.*")
    order = Window.partitionBy(*block).orderBy("loss")
    ties = Window.partitionBy(*block, "loss")
    ranked = long.withColumn("rank", F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)
    return ranked.groupBy(*by, "method").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("blocks"))


def day_differences(wide: DataFrame, a: str, b: str, by: list[str], origin: str = "origin") -> DataFrame:
    """(by, day, d, n): the mean of a - b over the rows of an origin day at which both exist."""
    both = wide.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").withColumn("day", day(F.col(origin)))
    return both.groupBy(*by, "day").agg(F.avg(F.col(a) - F.col(b)).alias("d"), F.count("*").alias("n"))


def day_means(wide: DataFrame, method: str, by: list[str], origin: str = "origin") -> DataFrame:
    """(by, day, d): the mean loss of one method over its rows of an origin day."""
    rows = wide.where(f"{method} IS NOT NULL").withColumn("day", day(F.col(origin)))
    return rows.groupBy(*by, "day").agg(F.avg(method).alias("d"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Correlation and mean absolute difference of two sets of forecasts on the keys that both have."""
    both = a.withColumnRenamed("y_hat", "a").join(b.withColumnRenamed("y_hat", "b").select(*keys, "b"), keys)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"))


def delta_to(summary: DataFrame, base: str, by: list[str], method: str = "method", metric: str = "mase") -> DataFrame:
    """summary with delta: a method's metric less that of the base method at the same keys."""
    own = summary.where(F.col(method) == base).select(*by, F.col(metric).alias("__base"))
    return summary.join(own, by, "left").withColumn("delta", F.col(metric) - F.col("__base")).drop("__base")


def quartiles(x: str) -> list[Column]:
    return [F.count(x).alias("n"), *(F.percentile(x, F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75))]


def ratio_cv(ratios: DataFrame, by: str = "window", least: int = 5) -> DataFrame:
    """(by, n, p25, p50, p75) of the coefficients of variation of series' ratios over origins, of series with enough origins."""
    spread = ratios.groupBy(by, "series_id").agg((F.stddev_samp("ratio") / F.nullif(F.avg("ratio"), F.lit(0.0))).alias("cv"), F.count("ratio").alias("origins"))
    return spread.where(F.col("origins") >= least).groupBy(by).agg(*quartiles("cv"))


def stability(ratios: DataFrame, by: str = "window", full: str = "full") -> DataFrame:
    """How far ratios of shorter windows are from that of the full window at the same origin: (by, n, p50, p75, p90 of the
    absolute difference of logarithms, and the shares within 10 and 20 %)."""
    whole = ratios.where(F.col(by) == full).select("series_id", "origin", F.col("ratio").alias("whole"))
    rows = ratios.where(F.col(by) != full).join(whole, ["series_id", "origin"]).withColumn("off", F.abs(F.log("ratio") - F.log("whole")))
    return rows.groupBy(by).agg(
        F.count("off").alias("n"), *(F.percentile("off", F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.75, 0.9)),
        share(F.col("off") <= F.log(F.lit(1.1))).alias("within_10"), share(F.col("off") <= F.log(F.lit(1.2))).alias("within_20"),
    )

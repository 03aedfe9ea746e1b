"""Sample matrices: targets with what their origin's history shows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretable.functions.measures import mean_of_present
from foretable.functions.temporal import day, lead_days, lead_hours, midnight, plus_hours, seconds, weekday
from foretable.operators.baselines import lagged, weekday_means
from foretable.operators.origins import daily_targets, history, targets, trailing
from foretable.protocol import Daily, Grid, Hourly

LAGS = (168, 336, 504, 672)


def seasonal_lags(panel: DataFrame, grid: Grid, p: Hourly) -> DataFrame:
    """Hourly targets with the values 1 to 4 weeks before, and the mean of those that exist. No lag is shorter than the
    longest lead, so that all are history."""
    if min(LAGS) < p.horizon:
        raise ValueError("a lag reaches beyond the origin")
    out = targets(panel, grid, p.horizon)
    for h in LAGS:
        out = lagged(out, panel, h, f"lag{h}")
    return out.withColumn("sdhr4", mean_of_present([F.col(f"lag{h}") for h in LAGS]))


def recency(panel: DataFrame, grid: Grid) -> DataFrame:
    """(series_id, k, last_y, last_ts, r24h, r7d, r28d): the last row before each origin, and trailing means."""
    last = history(panel.where("y IS NOT NULL"), grid, F.col("ts"), ["series_id"], {}, {"last": F.struct("ts", "y")})
    within = lambda days: F.avg(F.when(F.col("ts") >= plus_hours(F.col("origin"), -24 * days), F.col("y")))
    means = trailing(panel, grid, F.col("ts"), 28).groupBy("series_id", "k").agg(within(1).alias("r24h"), within(7).alias("r7d"), within(28).alias("r28d"))
    return last.join(means, ["series_id", "k"], "left").select("series_id", "k", F.col("last.y").alias("last_y"), F.col("last.ts").alias("last_ts"), "r24h", "r7d", "r28d")


def hourly_samples(panel: DataFrame, grid: Grid, p: Hourly) -> DataFrame:
    """The feature matrix of hourly targets, y included."""
    rows = seasonal_lags(panel, grid, p).join(recency(panel, grid), ["series_id", "k"], "left")
    ts, dow = F.col("ts"), weekday(F.col("ts"))
    return rows.select(
        "series_id", "park", "regime", "origin", "ts", "y", lead_hours(F.col("origin"), ts).alias("lead"), F.hour(ts).alias("hour"), dow.alias("dow"), (dow >= 5).cast("int").alias("is_weekend"), F.month(ts).alias("month"),
        *(f"lag{h}" for h in LAGS), "sdhr4", "last_y", ((seconds(F.col("origin")) - seconds(F.col("last_ts"))) / 3600).alias("hrs_since_last"), "r24h", "r7d", "r28d",
    )


def centred_mean(panel: DataFrame, reach: int = 14, least: int = 7) -> DataFrame:
    """(series_id, date, centred): the mean of the days from date - reach to date + reach, where there are enough."""
    around = Window.partitionBy("series_id").orderBy(F.unix_date("date")).rangeBetween(-reach, reach)
    return panel.select("series_id", "date", F.when(F.count("y").over(around) >= least, F.avg("y").over(around)).alias("centred"))


def annual_lookup(panel: DataFrame) -> DataFrame:
    """(series_id, date, lag364, ann28): for each date whose day 364 days before exists, that day's value and centred mean."""
    past = panel.select("series_id", "date", "y").join(centred_mean(panel), ["series_id", "date"])
    return past.select("series_id", F.date_add("date", 364).alias("date"), F.col("y").alias("lag364"), F.col("centred").alias("ann28"))


def daily_recency(panel: DataFrame, grid: Grid) -> DataFrame:
    within = lambda days: F.avg(F.when(F.col("date") >= F.date_sub(day(F.col("origin")), days), F.col("y")))
    return trailing(panel, grid, midnight(F.col("date")), 28).groupBy("series_id", "k").agg(within(7).alias("r7"), within(28).alias("r28"))


def daily_samples(panel: DataFrame, grid: Grid, p: Daily) -> DataFrame:
    """The feature matrix of daily targets, y included."""
    dow = weekday(F.col("date"))
    rows = daily_targets(panel, grid, p.horizon).withColumn("dow", dow)
    rows = rows.join(daily_recency(panel, grid), ["series_id", "k"], "left").join(weekday_means(panel, grid, 8).withColumnRenamed("m", "dow8w"), ["series_id", "dow", "k"], "left")
    rows = rows.join(annual_lookup(panel), ["series_id", "date"], "left")
    return rows.select(
        "series_id", "park", "regime", "origin", "date", "y", lead_days(F.col("origin"), F.col("date")).alias("lead"), "dow", (F.col("dow") >= 5).cast("int").alias("is_weekend"), F.month("date").alias("month"), "r7", "r28", "dow8w", "lag364", "ann28",
    )


def regular_grid(panel: DataFrame, grid: Grid, least: int = 336, context: int | None = None) -> DataFrame:
    """(series_id, origin, ts, y): every hour from a series' start to the origin, or the last context hours of them, 0 where
    nothing was observed; series with fewer hours than least are left out."""
    start = history(panel, grid, F.col("ts"), ["series_id"], {}, {"negative": -seconds(F.col("ts"))})
    hours = ((seconds(F.col("origin")) + F.col("negative")) / 3600).cast("int")
    slots = start.withColumn("hours", hours).where(F.col("hours") >= least)
    slots = slots.select("series_id", "origin", F.explode(F.sequence(F.lit(1), F.col("hours") if context is None else F.least("hours", F.lit(context)))).alias("back")).select("series_id", "origin", plus_hours(F.col("origin"), -F.col("back")).alias("ts"))
    return slots.join(panel.select("series_id", "ts", "y"), ["series_id", "ts"], "left").select("series_id", "origin", "ts", F.coalesce("y", F.lit(0.0)).alias("y"))


def truncated_context(rows: DataFrame, most: int) -> DataFrame:
    """The last rows of each series and origin."""
    latest = Window.partitionBy("series_id", "origin").orderBy(F.col("ts").desc())
    return rows.withColumn("__no", F.row_number().over(latest)).where(F.col("__no") <= most).drop("__no")


def label_codes(frame: DataFrame, column: str) -> DataFrame:
    """(column, code): codes of the sorted distinct values, from 0. Join it left and coalesce to 0 for values not seen. The window has
    one partition: it is meant for a column of few values (categories)."""
    return frame.select(column).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)

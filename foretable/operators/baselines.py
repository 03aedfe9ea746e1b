"""Seasonal forecasts without a fitted model. Every lag is an equi-join on a shifted key, as panels have gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.functions.temporal import day, lead_days, midnight, plus_hours, weekday
from foretable.operators.origins import daily_targets, history, targets, trailing
from foretable.protocol import Daily, Grid, Hourly

KEY = ["series_id", "origin", "ts"]


def lagged(frame: DataFrame, panel: DataFrame, hours: int, name: str) -> DataFrame:
    """frame with the value of its series so many hours earlier, or null."""
    past = panel.select("series_id", plus_hours(F.col("ts"), hours).alias("ts"), F.col("y").alias(name))
    return frame.join(past, ["series_id", "ts"], "left")


def first_of_lags(frame: DataFrame, panel: DataFrame, lags: Column, name: str = "y_hat") -> DataFrame:
    """frame (series_id, k, origin, date, ...) with the first value that exists at date - lag days, for the lags of an array
    column, in its order, before the origin; rows without any are dropped."""
    asked = frame.select("*", F.posexplode(lags).alias("__no", "__days"))
    asked = asked.withColumn("__date", F.date_sub("date", F.col("__days"))).where("__date < origin")
    past = panel.select("series_id", F.col("date").alias("__date"), F.col("y").alias("__y"))
    found = asked.join(past, ["series_id", "__date"])
    keys = frame.columns
    return found.groupBy(*keys).agg(F.min_by("__y", "__no").alias(name))


def snaive_hourly(panel: DataFrame, grid: Grid, p: Hourly, weeks: int = 4) -> DataFrame:
    """series_id, origin, ts, y_hat: the value 1, 2, ... weeks before, the first that exists."""
    goal = targets(panel, grid, p.horizon).select("series_id", "origin", "ts")
    past = panel.select("series_id", "ts", "y").select("series_id", "y", F.col("ts").alias("seen"), F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("w"))
    past = past.select("series_id", "y", "seen", "w", plus_hours(F.col("seen"), F.col("w") * p.season).alias("ts"))
    both = goal.join(past, ["series_id", "ts"]).where("seen < origin AND y IS NOT NULL")
    return both.groupBy("series_id", "ts", "origin").agg(F.min_by("y", "w").alias("y_hat")).select(*KEY, "y_hat")


def hourly_average(panel: DataFrame, grid: Grid, p: Hourly) -> DataFrame:
    """The mean of history at the same weekday and hour."""
    slot = lambda df: df.withColumns({"dow": weekday(F.col("ts")), "hour": F.hour("ts")})
    means = history(slot(panel), grid, F.col("ts"), ["series_id", "dow", "hour"], {"s": F.col("y"), "n": F.col("y").isNotNull().cast("long")})
    means = means.where("n > 0").select("series_id", "dow", "hour", "k", (F.col("s") / F.col("n")).alias("y_hat"))
    return slot(targets(panel, grid, p.horizon)).join(means, ["series_id", "dow", "hour", "k"]).select(*KEY, "y_hat")


def snaive7(panel: DataFrame, grid: Grid, p: Daily, weeks: int = 4) -> DataFrame:
    """series_id, origin, date, y_hat: the value 1 to 4 weeks before the date, of those before the origin; none beyond 28 days."""
    lags = F.array(*(F.lit(p.season * w) for w in range(1, weeks + 1)))
    return first_of_lags(_goal(panel, grid, p), panel, lags).select("series_id", "origin", "date", "y_hat")


def snaive7_extended(panel: DataFrame, grid: Grid, p: Daily) -> DataFrame:
    """The same over the whole horizon: whole weeks back as far as needed to be before the origin, and up to 4 more."""
    first = F.ceil(lead_days(F.col("origin"), F.col("date")) / p.season).cast("int")
    lags = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda e: (first + e) * p.season)
    return first_of_lags(_goal(panel, grid, p), panel, lags).select("series_id", "origin", "date", "y_hat")


def _goal(panel: DataFrame, grid: Grid, p: Daily) -> DataFrame:
    return daily_targets(panel, grid, p.horizon).select("series_id", "k", "origin", "date")


def weekday_means(panel: DataFrame, grid: Grid, weeks: int | None) -> DataFrame:
    """(series_id, dow, k, m): means by weekday of all history, or of its last weeks."""
    rows = panel.withColumn("dow", weekday(F.col("date")))
    if weeks is None:
        sums = history(rows, grid, midnight(F.col("date")), ["series_id", "dow"], {"s": F.col("y"), "n": F.col("y").isNotNull().cast("long")})
        return sums.where("n > 0").select("series_id", "dow", "k", (F.col("s") / F.col("n")).alias("m"))
    recent = trailing(rows, grid, midnight(F.col("date")), 7 * weeks)
    return recent.groupBy("series_id", "dow", "k").agg(F.avg("y").alias("m")).where("m IS NOT NULL")


def dow_mean(panel: DataFrame, grid: Grid, p: Daily, weeks: int | None = 8) -> DataFrame:
    goal = _goal(panel, grid, p).withColumn("dow", weekday(F.col("date")))
    return goal.join(weekday_means(panel, grid, weeks), ["series_id", "dow", "k"]).select("series_id", "origin", "date", F.col("m").alias("y_hat"))


def snaive364(panel: DataFrame, grid: Grid, p: Daily) -> DataFrame:
    """The value 52 weeks before."""
    past = panel.select("series_id", F.date_add("date", 364).alias("date"), F.col("y").alias("y_hat"), F.col("date").alias("seen"))
    return _goal(panel, grid, p).join(past, ["series_id", "date"]).where("seen < origin AND y_hat IS NOT NULL").select("series_id", "origin", "date", "y_hat")


def month_shape(panel: DataFrame, grid: Grid, span_days: int = 56) -> DataFrame:
    """(series_id, k, month, shape): the mean of the coarse era in a month over that of the months of the last span_days
    days before the origin, each weighted with its days. Months without coarse rows have no shape and no weight."""
    coarse = panel.where("source = 'coarse'").withColumn("month", F.month("date"))
    sums = history(coarse, grid, midnight(F.col("date")), ["series_id", "month"], {"s": F.col("y"), "n": F.col("y").isNotNull().cast("long")})
    months = sums.where("n > 0").select("series_id", "month", "k", day(F.col("origin")).alias("origin"), (F.col("s") / F.col("n")).alias("m"))
    days = F.sequence(F.date_sub("origin", span_days), F.date_sub("origin", 1))
    held = F.size(F.filter(days, lambda d: F.month(d) == F.col("month"))) / F.lit(float(span_days))
    months = months.withColumn("w", held)
    base = months.groupBy("series_id", "k").agg((F.sum(F.col("m") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("base"))
    return months.join(base, ["series_id", "k"]).where("base > 0").select("series_id", "k", "month", (F.col("m") / F.col("base")).alias("shape"))


def dow_shape_annual(panel: DataFrame, grid: Grid, p: Daily, weeks: int = 8) -> DataFrame:
    """The weekday mean of the last weeks, times the shape of the target's month; rows without a shape are dropped."""
    goal = _goal(panel, grid, p).withColumns({"dow": weekday(F.col("date")), "month": F.month("date")})
    out = goal.join(weekday_means(panel, grid, weeks), ["series_id", "dow", "k"]).join(month_shape(panel, grid, 7 * weeks), ["series_id", "k", "month"])
    return out.select("series_id", "origin", "date", (F.col("m") * F.col("shape")).alias("y_hat"))


def shape_layer(forecasts: DataFrame, panel: DataFrame, grid: Grid) -> DataFrame:
    """Any daily forecast times the shape of its month; a forecast without a shape stays as it is."""
    from foretable.operators.origins import origins

    of = origins(panel.sparkSession, grid).select("k", day(F.col("origin")).alias("origin"))
    rows = forecasts.join(F.broadcast(of), "origin").withColumn("month", F.month("date"))
    rows = rows.join(month_shape(panel, grid), ["series_id", "k", "month"], "left")
    return rows.select("series_id", "origin", "date", (F.col("y_hat") * F.coalesce("shape", F.lit(1.0))).alias("y_hat"))

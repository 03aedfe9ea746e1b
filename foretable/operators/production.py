"""A forecast in three layers: a model of daily history and calendar, spread over the hours; a ratio of all history; a ratio of the last days.

Every table here carries k, the number of the origin day, so that all origins are one plan. readings are sums
(series_id, date, hour, cnt, total); history is daily (series_id, park, date, avg).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.functions.measures import break_scores, hour_flags
from foretable.functions.temporal import HOURS, MONTHS, WEEK, YEAR, cyclic, day, midnight, weekday
from foretable.operators.calibrate import apply_ratio, clipped, pooled_layer, recent_layer
from foretable.operators.origins import history, trailing
from foretable.protocol import Grid

#: The hours that are learned from, what stands for a mean or for weather that isn't known, and from where on
#: a month is hot or rainy.
TRAIN_HOURS = (8, 22)
NO_MEAN = 30.0
NO_WEATHER = {"temp_max": 80.0, "temp_min": 65.0, "humidity": 70.0, "rain": 20.0}
HOT, RAINY = 85.0, 30.0
FEATURES = (
    "doy", "doy_sin", "doy_cos", "dow", "dow_sin", "dow_cos", "month", "month_sin", "month_cos", "is_weekend", "hour", "hour_sin", "hour_cos", "is_peak", "is_evening", "is_morning",
    *NO_WEATHER, "is_hot", "is_rainy", "spring_break", "summer_break", "winter_break", "series_code", "park_code", "baseline",
)


def calendar(date: Column) -> dict[str, Column]:
    """Features of a date."""
    dow, doy, month = weekday(date), F.dayofyear(date), F.month(date)
    out = {"doy": doy, "dow": dow, "month": month, "is_weekend": (dow >= 5).cast("int")}
    for name, value, period in (("doy", doy, YEAR), ("dow", dow, WEEK), ("month", month, MONTHS)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(value, period)
    return out | break_scores(date)


def hours_of_day(hour: Column) -> dict[str, Column]:
    sin, cos = cyclic(hour, HOURS)
    return {"hour_sin": sin, "hour_cos": cos} | hour_flags(hour)


def patterns(readings: DataFrame, grid: Grid, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(k, series_id, hour, hour_mean) where there are at least so many readings, and (k, series_id, series_mean), of what is before each origin."""
    sums = lambda keys: history(readings, grid, midnight(F.col("date")), keys, {"cnt": F.col("cnt"), "total": F.col("total")})
    by_hour = sums(["series_id", "hour"]).where(F.col("cnt") >= least).select("k", "series_id", "hour", (F.col("total") / F.col("cnt")).alias("hour_mean"))
    return by_hour, sums(["series_id"]).where("cnt > 0").select("k", "series_id", (F.col("total") / F.col("cnt")).alias("series_mean"))


def month_weather(weather: DataFrame, grid: Grid) -> DataFrame:
    """(k, month, means of weather before the origin, is_hot, is_rainy) for all 12 months; a month without any has the stand-ins."""
    present = {f"n_{c}": F.col(c).isNotNull().cast("long") for c in NO_WEATHER}
    seen = history(weather.withColumn("month", F.month("date")), grid, midnight(F.col("date")), ["month"], {**{c: F.col(c) for c in NO_WEATHER}, **present})
    spark = weather.sparkSession
    slots = spark.range(grid.count).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    rows = slots.join(seen, ["k", "month"], "left").select("k", "month", *(F.coalesce(F.col(c) / F.nullif(F.col(f"n_{c}"), F.lit(0)), F.lit(v)).alias(c) for c, v in NO_WEATHER.items()))
    return rows.withColumns({"is_hot": (F.col("temp_max") > HOT).cast("int"), "is_rainy": (F.col("rain") > RAINY).cast("int")})


def codes(history_: DataFrame, grid: Grid, column: str) -> DataFrame:
    """(k, column, code): of each origin the codes, from 0, of the sorted values that occur before it. One row a value and origin."""
    from pyspark.sql.window import Window

    seen = history(history_, grid, midnight(F.col("date")), [column], {"n": F.lit(1)})
    return seen.select("k", column, (F.row_number().over(Window.partitionBy("k").orderBy(column)) - 1).alias(f"{column.removesuffix('_id')}_code"))


def features(rows: DataFrame, default: Column, weather: DataFrame, by_hour: DataFrame, series_codes: DataFrame, park_codes: DataFrame) -> DataFrame:
    """rows (k, series_id, park, date, hour) with FEATURES. default: the baseline of an hour that has no mean."""
    out = rows.withColumns(calendar(F.col("date"))).withColumns(hours_of_day(F.col("hour"))).join(weather, ["k", "month"], "left")
    if "hour_mean" not in out.columns:
        out = out.join(by_hour, ["k", "series_id", "hour"], "left")
    out = out.withColumn("baseline", F.coalesce("hour_mean", default)).join(series_codes, ["k", "series_id"], "left").join(park_codes, ["k", "park"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("series_code", "park_code")})


def training_frame(daily: DataFrame, readings: DataFrame, weather: DataFrame, grid: Grid) -> DataFrame:
    """(k, series_id, park, date, FEATURES, target): what each origin's first layer learns from. The target is the day's mean times
    the hour's part of the series' mean; a series without any hour's mean has its day's mean at every hour."""
    by_hour, by_series = patterns(readings, grid)
    past = _before(daily, grid).withColumn("hour", F.explode(F.sequence(*map(F.lit, TRAIN_HOURS))))
    known = by_hour.select("k", "series_id", F.lit(True).alias("has_hours")).distinct()
    rows = past.join(by_hour, ["k", "series_id", "hour"], "left").join(by_series, ["k", "series_id"], "left").join(known, ["k", "series_id"], "left")
    mean = F.when(F.col("has_hours"), F.coalesce("series_mean", F.lit(NO_MEAN))).otherwise(F.col("avg"))
    ratio = F.when(F.col("hour_mean").isNotNull() & (mean > 0), F.col("hour_mean") / F.nullif(mean, F.lit(0.0))).otherwise(F.lit(1.0))
    rows = rows.withColumns({"mean": mean, "target": F.col("avg") * ratio})
    out = features(rows, F.col("mean"), month_weather(weather, grid), by_hour, codes(daily, grid, "series_id"), codes(daily, grid, "park"))
    return out.select("k", "series_id", "park", "date", *FEATURES, "target")


def _before(daily: DataFrame, grid: Grid) -> DataFrame:
    """Daily rows once for each origin after them."""
    if not grid.count:
        return daily.withColumn("k", F.lit(0)).limit(0)
    span = F.sequence(F.greatest(_first_after(F.col("date"), grid), F.lit(0)), F.lit(grid.count - 1))
    return daily.withColumn("k", F.explode(F.when(_first_after(F.col("date"), grid) < grid.count, span)))


def _first_after(date: Column, grid: Grid) -> Column:
    from foretable.operators.origins import passed

    return passed(midnight(date), grid)


def goal_frame(rows: DataFrame, daily: DataFrame, readings: DataFrame, weather: DataFrame, grid: Grid) -> DataFrame:
    """rows (k, series_id, park, date, hour, ...) to forecast, with FEATURES; only series that an origin's history knows."""
    by_hour, _ = patterns(readings, grid)
    known = codes(daily, grid, "series_id")
    rows = rows.join(known.select("k", "series_id"), ["k", "series_id"], "left_semi")
    return features(rows, F.lit(NO_MEAN), month_weather(weather, grid), by_hour, known, codes(daily, grid, "park"))


def observed_grid(readings: DataFrame, grid: Grid, days: int) -> DataFrame:
    """(k, series_id, date, hour): the hours that were observed in the last days before each origin."""
    return trailing(readings, grid, midnight(F.col("date")), days).select("k", "series_id", "date", "hour").distinct()


def layered(readings: DataFrame, first_past: DataFrame, first_goal: DataFrame, grid: Grid, long_days: int = 30, short_days: int = 5) -> DataFrame:
    """first_goal (k, series_id, date, hour, l1, ...) with l2, l3 and y_hat. first_past: (k, series_id, date, hour, l1) over
    observed_grid of long_days."""
    keys = ["k", "series_id"]
    sums = lambda keys_: history(readings, grid, midnight(F.col("date")), keys_, {"cnt": F.col("cnt"), "total": F.col("total")})
    second = pooled_layer(sums(["series_id", "hour"]), first_past, keys)
    near = trailing(readings, grid, midnight(F.col("date")), short_days)
    in_reach = first_past.join(near.select("k", "series_id", "date", "hour").distinct(), ["k", "series_id", "date", "hour"], "left_semi")
    third = recent_layer(near, in_reach, second, keys)
    out = apply_ratio(apply_ratio(first_goal.withColumns({"l2": F.lit(1.0), "l3": F.lit(1.0)}), second, keys, "l2"), third, keys, "l3")
    return out.withColumn("y_hat", clipped(F.col("l1") * F.col("l2") * F.col("l3")))


def by_day(forecasts: DataFrame) -> DataFrame:
    """Daily means of hourly forecasts, over the hours that were forecast."""
    return forecasts.groupBy("k", "series_id", day(F.col("ts")).alias("date")).agg(F.avg("l1").alias("l1"), F.avg("y_hat").alias("y_hat"))

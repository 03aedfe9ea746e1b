"""Calibration of forecasts and eras: level ratios, clamped ratio tables with the nearest hour as a fallback, widened intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.functions.measures import clamp, positive_ratio
from foretable.functions.temporal import day, midnight
from foretable.operators.origins import history, trailing
from foretable.protocol import Grid


def level_ratio(panel: DataFrame, grid: Grid, days: int = 56, least: int = 14) -> DataFrame:
    """(series_id, k, origin, ratio): the mean of a series' first days of the own era over that of its last coarse days, each with enough rows."""
    own, coarse = panel.where("source = 'own'"), panel.where("source = 'coarse'")
    starts = own.groupBy("series_id").agg(F.min("date").alias("start"))
    ends = coarse.groupBy("series_id").agg(F.max("date").alias("final"))
    early = own.join(starts, "series_id").where(F.col("date") < F.date_add("start", days))
    late = coarse.join(ends, "series_id").where(F.col("date") >= F.date_sub("final", days))
    level = late.groupBy("series_id").agg(F.avg("y").alias("coarse_mean"), F.count("y").alias("n")).where((F.col("n") >= least) & (F.col("coarse_mean") > 0)).drop("n")
    seen = history(early, grid, midnight(F.col("date")), ["series_id"], {"s": F.col("y"), "n": F.col("y").isNotNull().cast("long")}).where(F.col("n") >= least)
    return seen.join(level, "series_id").select("series_id", "k", day(F.col("origin")).alias("origin"), (F.col("s") / F.col("n") / F.col("coarse_mean")).alias("ratio"))


def window_ratio(panel: DataFrame, grid: Grid, weeks: int, days: int = 56, least: int = 7) -> DataFrame:
    """(series_id, k, origin, ratio): as level_ratio, but with bounds that all series share: own rows of the first days of the weeks
    before the origin, coarse rows of the last days of the whole coarse era."""
    held = trailing(panel.where("source = 'own'"), grid, midnight(F.col("date")), 7 * weeks)
    begin = held.groupBy("k").agg(F.min("date").alias("begin"))
    own = held.join(begin, "k").where(F.col("date") < F.date_add("begin", days)).groupBy("series_id", "k", "origin").agg(F.avg("y").alias("own_mean"), F.count("y").alias("n")).where(F.col("n") >= least)
    return own.join(coarse_level(panel, days), "series_id").select("series_id", "k", day(F.col("origin")).alias("origin"), (F.col("own_mean") / F.col("coarse_mean")).alias("ratio"))


def window_ratios(panel: DataFrame, grid: Grid, weeks: tuple[int | None, ...], days: int = 56, least: int = 7) -> DataFrame:
    """window_ratio for several windows: window (k02, k04, ... or full, for None), series_id, k, origin, ratio, days_seen (from
    the first own day in the window to the origin, at most the window)."""
    out = None
    for n in weeks:
        made = (window_ratio(panel, grid, n, days, least) if n else full_ratio(panel, grid, days, least)).join(days_seen(panel, grid, n), "k")
        made = made.select(F.lit(f"k{n:02d}" if n else "full").alias("window"), "series_id", "k", "origin", "ratio", "days_seen")
        out = made if out is None else out.unionByName(made)
    return out


def full_ratio(panel: DataFrame, grid: Grid, days: int = 56, least: int = 7) -> DataFrame:
    """window_ratio for a window that begins with the own era: its first days, as far as they are before the origin."""
    begin = panel.where("source = 'own'").agg(F.min("date").alias("begin"))
    early = panel.where("source = 'own'").join(F.broadcast(begin)).where(F.col("date") < F.date_add("begin", days))
    seen = history(early, grid, midnight(F.col("date")), ["series_id"], {"s": F.col("y"), "n": F.col("y").isNotNull().cast("long")}).where(F.col("n") >= least)
    return seen.join(coarse_level(panel, days), "series_id").select("series_id", "k", day(F.col("origin")).alias("origin"), (F.col("s") / F.col("n") / F.col("coarse_mean")).alias("ratio"))


def coarse_level(panel: DataFrame, days: int = 56) -> DataFrame:
    """(series_id, coarse_mean): each series' mean over the last days of the whole coarse era; only means above 0."""
    final = panel.where("source = 'coarse'").agg(F.max("date").alias("final"))
    late = panel.where("source = 'coarse'").join(F.broadcast(final)).where(F.col("date") >= F.date_sub("final", days))
    return late.groupBy("series_id").agg(F.avg("y").alias("coarse_mean")).where("coarse_mean > 0")


def days_seen(panel: DataFrame, grid: Grid, weeks: int | None) -> DataFrame:
    """(k, days_seen) of each origin."""
    own = panel.where("source = 'own'")
    if weeks is None:
        first = history(own, grid, midnight(F.col("date")), [], {}, {"negative": -F.unix_date("date")}).select("k", "origin", (-F.col("negative")).alias("first"))
        return first.select("k", (F.unix_date(day(F.col("origin"))) - F.col("first")).cast("int").alias("days_seen"))
    held = trailing(own, grid, midnight(F.col("date")), 7 * weeks).groupBy("k").agg(F.min("date").alias("first"), F.first("origin").alias("origin"))
    return held.select("k", F.least(F.datediff(day(F.col("origin")), F.col("first")), F.lit(7 * weeks)).alias("days_seen"))


def level_calibrated(forecasts: DataFrame, ratios: DataFrame) -> DataFrame:
    """Forecasts times the ratio of their series and origin; those without one are dropped."""
    return forecasts.join(ratios.select("series_id", "origin", "ratio"), ["series_id", "origin"]).select("series_id", "origin", "date", (F.col("y_hat") * F.col("ratio")).alias("y_hat"))


def splice_calibrated(panel: DataFrame, ratio: DataFrame) -> DataFrame:
    """The panel with its coarse rows times their series' ratio (series_id, ratio); coarse rows without one are dropped."""
    rows = panel.join(ratio.select("series_id", "ratio"), "series_id", "left").where("source = 'own' OR ratio IS NOT NULL")
    return rows.withColumn("y", F.when(F.col("source") == "coarse", F.col("y") * F.col("ratio")).otherwise(F.col("y"))).select(*panel.columns)


def ratio_table(pool: DataFrame, keys: list[str], y: str = "y", forecast: str = "y_hat", floor: float = 1.0, low: float = 0.3, high: float = 3.0) -> DataFrame:
    """(keys, ratio): the mean of y over that of the forecast (at least floor), clamped."""
    return pool.groupBy(*keys).agg(clamp(F.avg(y) / F.greatest(F.avg(forecast), F.lit(floor)), low, high).alias("ratio")).where("ratio IS NOT NULL")


def every_hour(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hour, ratio) for all 24 hours: an hour's own ratio, or that of the nearest hour (the lower of two) of the same keys."""
    spread = table.select(*keys, F.col("hour").alias("of"), "ratio", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return spread.groupBy(*keys, "hour").agg(F.min_by("ratio", F.struct(F.abs(F.col("of") - F.col("hour")), "of")).alias("ratio"))


def apply_ratio(forecasts: DataFrame, table: DataFrame, keys: list[str], name: str = "y_hat") -> DataFrame:
    """Forecasts times the ratio of their keys and hour (by the nearest hour), or times 1."""
    filled = every_hour(table, keys).withColumnRenamed("ratio", "__r")
    return forecasts.join(filled, [*keys, "hour"], "left").withColumn(name, F.col(name) * F.coalesce("__r", F.lit(1.0))).drop("__r")


def pool_before(forecasts: DataFrame, grid: Grid, days: int) -> DataFrame:
    """Scored forecasts (origin, ts, y, y_hat) as the pool of every later origin: those with at - days <= ts < at, made before; adds at."""
    pooled = trailing(forecasts.withColumnRenamed("origin", "made"), grid, F.col("ts"), days)
    return pooled.where("made < origin").withColumnRenamed("origin", "at")


def two_layers(forecasts: DataFrame, pool: DataFrame, long_days: int = 30, short_days: int = 5) -> DataFrame:
    """forecasts (series_id, origin, ts, hour, y_hat) with l2 (times the ratio of the last long_days) and l2l3 (times that of the
    last short_days after l2). pool: of each origin (at), rows with at - long_days <= ts < at. Without l2 ratios for an origin, l3 is 1."""
    from foretable.functions.temporal import plus_hours

    pool = pool.withColumn("hour", F.hour("ts")).withColumnRenamed("at", "origin")
    keys = ["origin", "series_id"]
    second = ratio_table(pool, [*keys, "hour"])
    recent = apply_ratio(pool.where(F.col("ts") >= plus_hours(F.col("origin"), -24 * short_days)), second, keys)
    third = ratio_table(recent, [*keys, "hour"])
    l2 = apply_ratio(forecasts.withColumn("l2", F.col("y_hat")), second, keys, "l2")
    return apply_ratio(l2.withColumn("l2l3", F.col("l2")), third, keys, "l2l3")


def pooled_layer(readings: DataFrame, first: DataFrame, keys: list[str], low: float = 0.3, high: float = 3.0, floor: float = 5.0) -> DataFrame:
    """(keys, hour, ratio): the pooled mean of readings (cnt, total) over the mean of first-layer forecasts (l1), at least floor; clamped."""
    by = [*keys, "hour"]
    actual = readings.groupBy(*by).agg((F.sum("total") / F.nullif(F.sum("cnt"), F.lit(0))).alias("actual"))
    expected = first.groupBy(*by).agg(F.avg("l1").alias("expected"))
    return actual.join(expected, by).select(*by, clamp(F.col("actual") / F.greatest(F.col("expected"), F.lit(floor)), low, high).alias("ratio")).where("ratio IS NOT NULL")


def recent_layer(readings: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], low: float = 0.3, high: float = 3.0, least: float = 5.0) -> DataFrame:
    """(keys, hour, ratio): the pooled mean of recent readings over l1 times the second layer's ratio (of the nearest hour, else 1),
    where l1 and that product are at least least; clamped."""
    by = [*keys, "hour"]
    actual = readings.groupBy(*by).agg((F.sum("total") / F.nullif(F.sum("cnt"), F.lit(0))).alias("actual"))
    rows = actual.join(first.groupBy(*by).agg(F.avg("l1").alias("l1")), by).withColumn("expected", F.col("l1"))
    rows = apply_ratio(rows, second, keys, "expected").where((F.col("l1") >= least) & (F.col("expected") >= least))
    return rows.select(*by, clamp(positive_ratio(F.col("actual"), F.col("expected")), low, high).alias("ratio")).where("ratio IS NOT NULL")


def clipped(x: Column, low: float = 5.0, high: float = 300.0) -> Column:
    return clamp(x, low, high)


def widened(p10: Column, p50: Column, p90: Column, factor: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), p50 - factor * (p50 - p10)), p50 + factor * (p90 - p50)


FACTORS = tuple(round(1 + 0.05 * i, 2) for i in range(13))


def coverage_by_factor(frame: DataFrame, by: list[str], factors: tuple[float, ...] = FACTORS) -> DataFrame:
    """(by, factor, coverage) of intervals p10, p50, p90 around y, widened by each factor."""
    low, high = widened(F.col("p10"), F.col("p50"), F.col("p90"), F.col("factor"))
    rows = frame.withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    return rows.groupBy(*by, "factor").agg(F.avg(((F.col("y") >= low) & (F.col("y") <= high)).cast("double")).alias("coverage"))


def frozen_factor(frame: DataFrame, goal: float = 0.8) -> DataFrame:
    """(factor): of one row, the least factor whose coverage over the whole frame reaches the goal; null if none does."""
    return coverage_by_factor(frame, []).agg(F.min(F.when(F.col("coverage") >= goal, F.col("factor"))).alias("factor"))


def holdout_coverage(frame: DataFrame) -> DataFrame:
    """The holdout rows of a frame with halves: y, raw and widened (whether each interval covers y), by the factor that the
    calibration half gives."""
    factor = frozen_factor(frame.where("half = 'calibration'"))
    low, high = widened(F.col("p10"), F.col("p50"), F.col("p90"), F.col("factor"))
    rows = frame.where("half = 'holdout'").join(F.broadcast(factor))
    inside = lambda a, b: ((F.col("y") >= a) & (F.col("y") <= b)).cast("double")
    return rows.withColumns({"raw": inside(F.greatest(F.lit(0.0), F.col("p10")), F.col("p90")), "widened": inside(low, high)})


def halves(frame: DataFrame, column: str) -> DataFrame:
    """Adds half: calibration for the first half of the column's distinct values (the smaller half of an odd number), else holdout."""
    from pyspark.sql.window import Window

    days = frame.select(column).distinct()
    order = Window.orderBy(column)
    placed = days.select(column, F.row_number().over(order).alias("__i"), F.count("*").over(Window.partitionBy()).alias("__n"))
    half = F.when(F.col("__i") <= F.floor(F.col("__n") / 2), F.lit("calibration")).otherwise(F.lit("holdout"))
    return frame.join(F.broadcast(placed.select(column, half.alias("half"))), column)

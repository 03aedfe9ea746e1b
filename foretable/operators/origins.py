"""Origins, and how rows meet them: which origins have a row in their horizon, and what each origin's history adds up to."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretable.functions.temporal import at, day, midnight, seconds
from foretable.protocol import Daily, Grid, Hourly


def hourly_grid(panel: DataFrame, p: Hourly, min_train_days: int | None = None) -> Grid:
    """Weekly origin days from min_train_days after the first day, as long as a whole horizon follows. One small aggregation runs here."""
    low, high = panel.agg(F.min(day(F.col("ts"))), F.max(day(F.col("ts")))).first()
    if low is None:
        return Grid(datetime(1970, 1, 1), 0, p.hours, p.spacing_days)
    first = datetime.combine(low, time()) + timedelta(days=p.min_train_days if min_train_days is None else min_train_days)
    last = datetime.combine(high, time()) - timedelta(hours=p.horizon)
    return Grid(first, max(0, (last - first).days // p.spacing_days + 1) if last >= first else 0, p.hours, p.spacing_days)


def daily_grid(panel: DataFrame, p: Daily) -> Grid:
    """Weekly origins within the own era, from min_train_days after its first day to a week before its last."""
    low, high = panel.where("source = 'own'").agg(F.min("date"), F.max("date")).first()
    if low is None:
        return Grid(datetime(1970, 1, 1), 0, (0,), p.spacing_days)
    first, last = low + timedelta(days=p.min_train_days), high - timedelta(days=7)
    return Grid(datetime.combine(first, time()), max(0, (last - first).days // p.spacing_days + 1) if last >= first else 0, (0,), p.spacing_days)


def origins(spark: SparkSession, grid: Grid) -> DataFrame:
    """(k, origin), one row each."""
    return spark.range(grid.count).select(F.col("id").cast("int").alias("k"), origin_time(F.col("id").cast("int"), grid).alias("origin"))


def origin_time(k: Column, grid: Grid) -> Column:
    hour = F.element_at(F.array(*map(F.lit, grid.hours)), (k % len(grid.hours)) + 1)
    week = F.floor(k / len(grid.hours)).cast("int")
    return at(grid.first) + F.make_dt_interval(week * grid.spacing_days, hour)


def passed(ts: Column, grid: Grid) -> Column:
    """How many origins are at or before ts: the number of the first origin that has ts in its history. Negative before the first week."""
    off = seconds(ts) - int((grid.first - datetime(1970, 1, 1)).total_seconds())
    step = 86400 * grid.spacing_days
    week = F.floor(off / step).cast("int")
    within = off - week.cast("long") * step
    return week * len(grid.hours) + sum(((within >= h * 3600).cast("int") for h in grid.hours), F.lit(0))


def targets(panel: DataFrame, grid: Grid, horizon_hours: int) -> DataFrame:
    """Rows of an hourly panel once for each origin with origin <= ts < origin + horizon: adds k, origin."""
    return _meet(panel, F.col("ts"), grid, F.lit(0), F.lit(horizon_hours))


def daily_targets(panel: DataFrame, grid: Grid, horizon_days: int) -> DataFrame:
    """The same for a daily panel; origin is a date."""
    out = _meet(panel, midnight(F.col("date")), grid, F.lit(0), F.lit(24 * horizon_days))
    return out.withColumn("origin", day(F.col("origin")))


def trailing(panel: DataFrame, grid: Grid, ts: Column, days: int) -> DataFrame:
    """Rows once for each origin with origin - days <= ts < origin: adds k, origin."""
    return _meet(panel, ts, grid, F.lit(-24 * days), F.lit(0))


def _meet(panel: DataFrame, ts: Column, grid: Grid, low_hours: Column, high_hours: Column) -> DataFrame:
    """Rows once for each origin with origin + low <= ts < origin + high. At most (high - low) / spacing + 1 weeks are tried for a row."""
    if not grid.count:
        return panel.withColumns({"k": F.lit(0), "origin": F.lit(None).cast("timestamp_ntz")}).limit(0)
    off = seconds(ts) - int((grid.first - datetime(1970, 1, 1)).total_seconds())
    step = 86400 * grid.spacing_days
    from_week = F.greatest(F.floor((off - high_hours * 3600 - 86400) / step), F.lit(0)).cast("int")
    to_week = F.least(F.floor((off - low_hours * 3600) / step), F.lit(grid.weeks - 1)).cast("int")
    weeks = F.when(from_week <= to_week, F.sequence(from_week, to_week))
    n = len(grid.hours)
    ks = F.flatten(F.transform(weeks, lambda w: F.array(*(w * n + i for i in range(n)))))
    rows = panel.withColumn("k", F.explode(ks)).withColumn("origin", origin_time(F.col("k"), grid))
    lead = seconds(ts) - seconds(F.col("origin"))
    return rows.where((lead >= low_hours * 3600) & (lead < high_hours * 3600))


def history(panel: DataFrame, grid: Grid, ts: Column, keys: list[str], sums: dict[str, Column], latest: dict[str, Column] | None = None) -> DataFrame:
    """For each key and origin what all rows before the origin add up to: keys, k, origin, the sums, and of latest the greatest.

    Rows are summed up once for each key and gap between origins; then a running sum over the gaps, which are as many as
    the origins at most, gives every origin's history. History is never joined with origins.
    """
    latest = latest or {}
    if not grid.count:
        return panel.select(*keys, F.lit(0).alias("k"), F.lit(None).cast("timestamp_ntz").alias("origin"), *(c.alias(n) for n, c in {**sums, **latest}.items())).limit(0)
    gaps = panel.withColumn("k", F.greatest(passed(ts, grid), F.lit(0))).where(F.col("k") < grid.count)
    gaps = gaps.groupBy(*keys, "k").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.max(c).alias(n) for n, c in latest.items()))
    by = Window.partitionBy(*keys).orderBy("k")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = gaps.select(*keys, "k", F.lead("k", 1, grid.count).over(by).alias("next"), *(F.sum(n).over(so_far).alias(n) for n in sums), *(F.max(n).over(so_far).alias(n) for n in latest))
    run = run.withColumn("k", F.explode(F.sequence(F.col("k"), F.col("next") - 1))).drop("next")
    return run.withColumn("origin", origin_time(F.col("k"), grid))

"""From raw readings to hourly and daily panels."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.functions.temporal import at, day, hour_floor


@dataclass(frozen=True)
class SeriesRule:
    """Series whose id begins with prefix belong to this park, resort and regime."""

    prefix: str
    park: str
    resort: str
    regime: str


def classify(frame: DataFrame, rules: tuple[SeriesRule, ...], must_contain: str = "", never: tuple[str, ...] = (), never_ends: tuple[str, ...] = (), id_col: str = "series_id") -> DataFrame:
    """Adds park, resort, regime; drops series that no rule knows or that are excluded."""
    s = F.col(id_col)
    keep = s.contains(must_contain) if must_contain else F.lit(True)
    for part in never:
        keep = keep & ~s.contains(part)
    for end in never_ends:
        keep = keep & ~s.endswith(end)

    def pick(name: str) -> Column:
        out = F.lit(None).cast("string")
        for r in reversed(rules):
            out = F.when(s.startswith(r.prefix), F.lit(getattr(r, name))).otherwise(out)
        return out

    return frame.where(keep).withColumns({n: pick(n) for n in ("park", "resort", "regime")}).where(F.col("regime").isNotNull())


def hourly_panel(readings: DataFrame, series: Column, ts: Column, value: Column, rules: tuple[SeriesRule, ...], min_obs: int, as_of: date | None = None, since: date | None = None) -> DataFrame:
    """series_id, park, resort, regime, ts, y, n_obs: hourly means of readings that aren't null, where there are min_obs. as_of: the day from
    which on readings are not used."""
    rows = readings.select(series.alias("series_id"), ts.alias("__ts"), value.alias("__v")).where(F.col("__v").isNotNull())
    if since:
        rows = rows.where(F.col("__ts") >= at(since))
    if as_of:
        rows = rows.where(F.col("__ts") < at(as_of))
    hours = rows.groupBy("series_id", hour_floor(F.col("__ts")).alias("ts")).agg(F.avg("__v").alias("y"), F.count("__v").alias("n_obs")).where(F.col("n_obs") >= min_obs)
    return classify(hours, rules).select("series_id", "park", "resort", "regime", "ts", "y", "n_obs")


def curated(hourly: DataFrame, min_days: int) -> DataFrame:
    """Series with rows on at least so many days."""
    days = hourly.groupBy("series_id").agg(F.count_distinct(day(F.col("ts"))).alias("days")).where(F.col("days") >= min_days)
    return hourly.join(days, "series_id", "left_semi")


def daily_from_hourly(hourly: DataFrame, min_hours: int) -> DataFrame:
    """Means of hourly means, of days with at least min_hours hours."""
    days = hourly.groupBy("series_id", "park", "resort", "regime", day(F.col("ts")).alias("date")).agg(F.avg("y").alias("y"), F.count("*").alias("hours"))
    return days.where(F.col("hours") >= min_hours).drop("hours").withColumn("source", F.lit("own"))


def spliced(own: DataFrame, coarse: DataFrame, own_start: date) -> DataFrame:
    """Both eras in one panel: the coarse source before own_start (values above 0), the own one after."""
    early = coarse.where((F.col("date") < F.lit(own_start)) & (F.col("y") > 0)).withColumn("source", F.lit("coarse"))
    names = ["series_id", "park", "resort", "regime", "date", "y", "source"]
    return early.select(*names).unionByName(own.select(*names))


def assert_unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The frame, checked when it is computed: a key that occurs twice raises instead of multiplying rows in a later join."""
    twice = frame.groupBy(*keys).agg(F.count("*").alias("__n"))
    checked = twice.select(*keys, F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate key in {keys}"))).alias("__bad"))
    return frame.join(checked.where(F.col("__bad").isNull()).select(*keys), keys, "left_semi")

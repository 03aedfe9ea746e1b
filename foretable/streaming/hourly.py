"""The hourly panel over a stream of readings: what the batch query gives, as hours close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.sources.panels import SeriesRule, classify


def streaming_hourly_panel(readings: DataFrame, series: Column, ts: Column, value: Column, rules: tuple[SeriesRule, ...], min_obs: int, late: str = "2 hours") -> DataFrame:
    """series_id, park, resort, regime, ts, y, n_obs. Readings later than late are dropped; an hour is final when the watermark
    has passed it, so that the state holds only hours still open."""
    rows = readings.select(series.alias("series_id"), ts.cast("timestamp").alias("at"), value.alias("v")).where(F.col("v").isNotNull())
    hours = rows.withWatermark("at", late).groupBy("series_id", F.window("at", "1 hour")).agg(F.avg("v").alias("y"), F.count("v").alias("n_obs")).where(F.col("n_obs") >= min_obs)
    return classify(hours, rules).select("series_id", "park", "resort", "regime", F.col("window.start").cast("timestamp_ntz").alias("ts"), "y", "n_obs")

"""Hourly and daily panels from the tables at hand: events by hour and type, line items by day, flag and status."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretable.functions.measures import break_scores
from foretable.functions.temporal import day
from foretable.operators.origins import daily_grid, hourly_grid
from foretable.protocol import Daily, Grid, Hourly
from foretable.sources.files import stored
from foretable.sources.panels import SeriesRule, classify, hourly_panel

HOURLY = Hourly(min_train_days=14, min_series_days=14)
SMALL = replace(HOURLY, min_obs=1, min_pairs=5)
DAILY = Daily(own_start=date(2001, 3, 6))
EVENT_RULES = (
    SeriesRule("click", "P1", "east", "A"), SeriesRule("view", "P2", "east", "A"), SeriesRule("purchase", "P3", "east", "B"),
    SeriesRule("signup", "P4", "west", "C"), SeriesRule("error", "P5", "west", "C"),
)
ITEM_RULES = (SeriesRule("A-", "PA", "east", "A"), SeriesRule("N-", "PN", "east", "B"), SeriesRule("R-", "PR", "west", "C"))
#: From here on regime B has coarse rows; regime C has none.
LATE_COARSE = date(2000, 5, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, p: Hourly = HOURLY) -> DataFrame:
    return hourly_panel(table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"), F.col("value"), EVENT_RULES, p.min_obs)


def daily(spark: SparkSession, sf_dir: str, min_count: int = 3) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("series_id"), day(F.col("l_shipdate")).alias("date"), "l_quantity")
    rows = items.groupBy("series_id", "date").agg(F.avg("l_quantity").alias("y"), F.count("*").alias("n")).where(F.col("n") >= min_count).drop("n")
    rows = classify(rows, ITEM_RULES).withColumn("source", F.when(F.col("date") >= F.lit(DAILY.own_start), F.lit("own")).otherwise(F.lit("coarse")))
    keep = (F.col("source") == "own") | (F.col("regime") == "A") | ((F.col("regime") == "B") & (F.col("date") >= F.lit(LATE_COARSE)))
    return rows.where(keep).select("series_id", "park", "resort", "regime", "date", "y", "source")


def hourly_pair(spark: SparkSession, sf_dir: str, p: Hourly = HOURLY) -> tuple[DataFrame, Grid]:
    """The panel, made once and stored, as forecasts, scales and actuals all read it; and its grid of origins."""
    panel = stored(hourly(spark, sf_dir, p), "hourly")
    return panel, hourly_grid(panel, p)


def daily_pair(spark: SparkSession, sf_dir: str, min_count: int = 3) -> tuple[DataFrame, Grid]:
    panel = stored(daily(spark, sf_dir, min_count), "daily")
    return panel, daily_grid(panel, DAILY)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of events by series, day and hour: (series_id, date, hour, cnt, total)."""
    events = table(spark, sf_dir, "events").where(F.col("value") > 0)
    return events.groupBy(F.col("event_type").alias("series_id"), day(F.col("ts")).alias("date"), F.hour("ts").alias("hour")).agg(F.count("*").alias("cnt"), F.sum("value").alias("total"))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of events: (series_id, park, date, avg)."""
    events = table(spark, sf_dir, "events").where(F.col("value") > 0)
    days = events.groupBy(F.col("event_type").alias("series_id"), day(F.col("ts")).alias("date")).agg(F.avg("value").alias("avg"))
    return classify(days, EVENT_RULES).select("series_id", "park", "date", "avg")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for weather by day, made from line items."""
    items = table(spark, sf_dir, "lineitem").groupBy(day(F.col("l_shipdate")).alias("date"))
    return items.agg((F.avg("l_quantity") + 60).alias("temp_max"), (F.avg("l_quantity") + 40).alias("temp_min"), (F.avg("l_discount") * 1000).alias("humidity"), (F.avg("l_tax") * 1000).alias("rain"))


def crowd_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a calendar of breaks and events by day: order days, with the break scores of their dates."""
    days = table(spark, sf_dir, "orders").groupBy(day(F.col("o_orderdate")).alias("date")).agg(F.count("*").cast("double").alias("event_score"), F.max("o_totalprice").alias("peak_week_score"))
    return days.select("date", *(c.alias(f"{k}_score") for k, c in break_scores(F.col("date")).items()), "event_score", "peak_week_score")


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar and weather by date; either may lack a day."""
    return crowd_calendar(spark, sf_dir).join(weather(spark, sf_dir), "date", "full_outer")


SCHOOL, EVENTS, WEATHER = ("spring_break_score", "summer_break_score", "winter_break_score"), ("event_score", "peak_week_score"), ("temp_max", "temp_min", "humidity", "rain")

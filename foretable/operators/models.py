"""Fitted models: which samples each evaluation day's model learns from (the trees are in boosting), and per-series decomposition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.functions.temporal import day as day_of
from foretable.operators.smoothing import theta_forecast
from foretable.protocol import Grid
from foretable.sources.packing import ship

HOURLY_NUMBERS = ("lead", "hour", "dow", "is_weekend", "month", "lag168", "lag336", "lag504", "lag672", "sdhr4", "last_y", "hrs_since_last", "r24h", "r7d", "r28d")
DAILY_NUMBERS = ("lead", "dow", "is_weekend", "month", "r7", "r28", "dow8w", "lag364", "ann28")
CATEGORIES = ("series_id", "park", "regime")


def per_series(grid: DataFrame, season: int, horizon: int, method=theta_forecast, context: int | None = None) -> DataFrame:
    """(series_id, origin, ts, y_hat): a forecast of every hour of the horizon from a regular grid (series_id, origin, ts, y), of which
    the last context hours are used, or all. method: any function of values, season and horizon (a pretrained model may be one,
    with a context of 2,048, say). Groups are one series at one origin: a few numbers an hour."""
    from foretable.operators.features import truncated_context

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        ahead = method(frame["y"].to_numpy(float), season, horizon)
        return pd.DataFrame({"series_id": key[0], "origin": key[1], "ts": [key[1] + pd.Timedelta(hours=i) for i in range(horizon)], "y_hat": ahead})

    ship(grid.sparkSession)
    rows = grid if context is None else truncated_context(grid, context)
    return rows.groupBy("series_id", "origin").applyInPandas(run, "series_id string, origin timestamp_ntz, ts timestamp_ntz, y_hat double")


def context_curve(grid: DataFrame, season: int, horizon: int, contexts: tuple[int | None, ...], method: Callable[[np.ndarray, int, int], np.ndarray] = theta_forecast) -> DataFrame:
    """(series_id, origin, context, ts, y_hat): what method forecasts from the last so many hours of a regular grid, for each of contexts
    (None: all hours, in the result null). A series comes to its task once and is cut there, however many contexts there are;
    contexts longer than it are left out, as they would repeat the whole."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values("ts")["y"].to_numpy(float)
        held = [c for c in contexts if c is None or c <= len(y)]
        ts = [key[1] + pd.Timedelta(hours=i) for i in range(horizon)]
        parts = [pd.DataFrame({"series_id": key[0], "origin": key[1], "context": pd.array([c] * horizon, "Int32"), "ts": ts, "y_hat": method(y if c is None else y[len(y) - c :], season, horizon)}) for c in held]
        empty = frame.head(0).rename(columns={"y": "y_hat"}).assign(context=pd.array([], "Int32"))
        return pd.concat(parts) if parts else empty

    ship(grid.sparkSession)
    return grid.groupBy("series_id", "origin").applyInPandas(run, "series_id string, origin timestamp_ntz, context int, ts timestamp_ntz, y_hat double")


def later_days(rows: DataFrame, grid: Grid, known: Column) -> DataFrame:
    """rows once for each evaluation day (one of each week of the grid) from the date known on: adds day. The weeks are found by
    arithmetic."""
    first = F.to_date(F.lit(grid.first.date().isoformat()))
    week = F.greatest(F.ceil(F.datediff(known, first) / grid.spacing_days).cast("int"), F.lit(0))
    weeks = F.when(week < grid.weeks, F.sequence(week, F.lit(max(grid.weeks - 1, 0))))
    days = F.transform(weeks, lambda w: F.date_add(first, w * grid.spacing_days))
    return rows.withColumn("day", F.explode(days)) if grid.weeks else rows.withColumn("day", first).limit(0)


def known_hourly(horizon_days: int) -> Column:
    """The date from which on a sample's whole horizon has passed at midnight."""
    return F.date_add(day_of(F.col("origin")), horizon_days + (F.hour("origin") > 0).cast("int"))


def named(rows: DataFrame, *parts: str | Column) -> DataFrame:
    """rows with model, made of those columns."""
    return rows.withColumn("model", F.concat_ws("|", *parts))

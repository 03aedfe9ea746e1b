"""Time without time zones. Timestamps are TIMESTAMP_NTZ throughout, so that a daylight-saving gap changes nothing."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: datetime | date | None) -> Column:
    """A literal TIMESTAMP_NTZ. F.lit() of a datetime would go through time zones."""
    return F.lit(None if moment is None else str(moment)).cast("timestamp_ntz")


def hour_floor(ts: Column) -> Column:
    """The hour that ts is in. date_trunc would go through the session's time zone."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts))


def day(ts: Column) -> Column:
    return ts.cast("date")


def midnight(date: Column) -> Column:
    return date.cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 as the clock shows them."""
    return F.datediff(day(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def plus_hours(ts: Column, hours: Column | int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours if isinstance(hours, Column) else F.lit(hours))


def lead_hours(origin: Column, ts: Column) -> Column:
    """Hours ahead, counted from 1."""
    return (F.floor((seconds(ts) - seconds(origin)) / 3600) + 1).cast("int")


def lead_days(origin: Column, date: Column) -> Column:
    """Days ahead, counted from 1."""
    return F.datediff(date, origin) + 1


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day(ts))


def bucket(lead: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    """The label of the range (both ends included) that lead is in; null outside all."""
    out = F.lit(None).cast("string")
    for label, (low, high) in ranges.items():
        out = F.when((lead >= low) & (lead <= high), F.lit(label)).otherwise(out)
    return out


#: The periods of the cyclic encodings.
YEAR, MONTHS, WEEK, HOURS = 365.0, 12.0, 7.0, 24.0


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value's place in its period."""
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)

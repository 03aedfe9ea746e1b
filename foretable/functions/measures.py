"""Arithmetic that keeps nulls null: greatest() and least() would skip them, a division by zero would raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def positive_ratio(a: Column, b: Column) -> Column:
    """a / b where b is above zero, else null."""
    return F.when(b > 0, a / b)


def mean_of_present(columns: list[Column]) -> Column:
    """The mean of those columns that aren't null."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))
    count = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))
    return F.when(count > 0, total / count)


def pinball(y: Column, forecast: Column, q: float) -> Column:
    d = y - forecast
    return F.when(d.isNotNull(), F.greatest(F.lit(q) * d, F.lit(q - 1.0) * d))


def in_order(columns: list[Column]) -> list[Column]:
    """The same values from the least to the greatest, and none below 0: repairs quantiles that cross."""
    held = F.array_sort(F.array(*columns))
    return [F.greatest(F.lit(0.0), held[i]) for i in range(len(columns))]


#: The edges of the bins of series by their mean.
SIZE_EDGES = (0, 10, 20, 30, 50)


def size_bin(x: Column, edges: tuple[int, ...] = SIZE_EDGES) -> Column:
    """Bins closed on the right: (0,10], (10,20] ... and above the last edge; null at or below the first."""
    out = F.when(x > edges[-1], F.lit(f">{edges[-1]}"))
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when((x > low) & (x <= high), F.lit(f"{low}-{high}"))
    return out


def share(condition: Column) -> Column:
    """The part of rows for which condition is true (an aggregate; null conditions don't count)."""
    return F.avg(condition.cast("double"))


def break_scores(date: Column) -> dict[str, Column]:
    """Scores of how much of school is on break: spring, summer, winter."""
    md = F.month(date) * 100 + F.dayofmonth(date)
    # fixed values: month and day of each season's first and last day, and the scores within and outside it
    spring = F.when(md.between(310, 415), 0.9).otherwise(0.2)
    summer = F.when(md.between(601, 815), 0.9).otherwise(0.1)
    winter = F.when((md >= 1220) | (md <= 105), 0.9).otherwise(0.1)
    return {"spring_break": spring, "summer_break": summer, "winter_break": winter}


def hour_flags(hour: Column) -> dict[str, Column]:
    return {"is_peak": hour.between(10, 14).cast("int"), "is_evening": (hour >= 17).cast("int"), "is_morning": (hour <= 10).cast("int")}

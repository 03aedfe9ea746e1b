"""How well stored forecasts did: which of them was the newest at a moment, and scores on targets that several methods share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretable.functions.measures import share


def as_of(asks: DataFrame, stored: DataFrame, keys: list[str], moment: str, made: str, values: list[str]) -> DataFrame:
    """asks, each with made and values of the newest stored row of its keys that was made at or before its moment, null where there is
    none. Of rows made at one time the greatest values count. asks stays whole, repeated rows and null keys (which match null)
    included; names of made and values must not be among its own.

    Both sides pass one sort by keys and time, in which each ask takes the last stored row before it: no pairs are made, however
    often a target was forecast."""
    kept = F.struct(made, *values)
    left = asks.select(*keys, F.col(moment).alias("__at"), F.lit(1).alias("__side"), F.struct(*(F.col(f"`{c}`") for c in asks.columns)).alias("__ask"))
    right = stored.where(F.col(made).isNotNull()).select(*keys, F.col(made).alias("__at"), F.lit(0).alias("__side"), kept.alias("__kept"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first(), "__side", "__kept").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__kept", F.last("__kept", ignorenulls=True).over(order)).where("__side = 1")
    return found.select("__ask.*", *(F.col(f"__kept.{c}").alias(c) for c in (made, *values)))


def shared(methods: list[str], y: str = "y") -> Column:
    """Whether a row has the target and a forecast of every method."""
    return F.least(*(F.col(c).isNotNull().cast("int") for c in (y, *methods))) == 1


def same_targets(wide: DataFrame, methods: list[str], by: list[str], y: str = "y") -> DataFrame:
    """(by, method, n, mae, rmse, w5, w10, bias) of rows that hold the target and a forecast of every method."""
    parts = F.array(*(F.struct(F.lit(m).alias("method"), (F.col(m) - F.col(y)).alias("e")) for m in methods))
    long = wide.where(shared(methods, y)).select(*by, F.explode(parts).alias("x")).select(*by, "x.*")
    size = F.abs("e")
    return long.groupBy(*by, "method").agg(
        F.count("*").alias("n"), F.avg(size).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), share(size <= 5).alias("w5"), share(size <= 10).alias("w10"), F.avg("e").alias("bias"),
    )


def same_target_agreement(wide: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, corr, mean_abs_diff, mean_a, mean_b) of rows that hold both forecasts."""
    both = wide.where(shared([a], b))
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("corr"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))

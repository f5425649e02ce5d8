"""As-of and carry-forward operators over ordered observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters as flt


def daily_prices(obs: DataFrame, keys: list[str]) -> DataFrame:
    """One price per key and day, the official lowest first, with whether it is official. Card prices and accessories do not count."""
    rows = obs.where(flt.not_accessory() & flt.public_price() & flt.audited("not_rejected") & (F.col("is_bundle") == 0))
    own = F.min(F.when(flt.official(), F.col("sale_price")))
    return rows.groupBy(*keys, "obs_date").agg(F.coalesce(own, F.min("sale_price")).alias("price"), own.isNotNull().cast("int").alias("is_official"))


def price_changes(daily: DataFrame, keys: list[str], lookback: int, noise_pct: float) -> DataFrame:
    """Each day's price against the latest earlier day's of the same key, if at most ``lookback`` days back and beyond the noise.

    A lag over days, one shuffle on the key, instead of a range join.
    """
    w = Window.partitionBy(*keys).orderBy("obs_date")
    rows = daily.select("*", F.lag("price").over(w).alias("prev_price"), F.lag("obs_date").over(w).alias("prev_date"))
    rows = rows.withColumn("days_span", F.datediff("obs_date", "prev_date")).withColumn("change_pct", F.try_divide(F.col("price") - F.col("prev_price"), F.col("prev_price")) * 100)
    return rows.where((F.col("days_span") <= lookback) & (F.col("prev_price") > 0) & (F.abs("change_pct") >= noise_pct)).withColumnRenamed("price", "curr_price")


def spine(days: DataFrame, keys: list[str], day: str = "day", start: str = "start", end: str = "end") -> DataFrame:
    """A row for every key and day from ``start`` to ``end`` (columns of ``days``)."""
    return days.select(*keys, F.explode(F.sequence(start, end)).alias(day))


def carry_forward(value: str, keys: list[str], day: str = "day") -> tuple[Column, Column]:
    """The last known value up to each day and whether it was filled; nothing is filled before the first one."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(w)
    return last, F.col(value).isNull() & last.isNotNull()

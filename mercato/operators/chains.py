"""The chained matched-pair index with breaks and re-basing, spread over days and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import interpolated


def _on(order: str = "day"):
    return Window.partitionBy("series").orderBy(order)


def base_pairs(days: DataFrame) -> DataFrame:
    """series, base, day: the days that may be the base of each day. ``days``: series, day, covered.

    A well covered day always becomes the base, so the base of a day is the last covered one before it or a day between the two: candidates
    share a run with their day, and runs are as long as coverage stays bad.
    """
    before = _on().rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.col("covered").cast("long")).over(before), F.lit(0))
    numbered = days.select("series", "day", "covered", run.alias("run"))
    bases = numbered.select("series", F.col("day").alias("base"), (F.col("run") + F.col("covered").cast("long")).alias("run"))
    return numbered.join(bases, ["series", "run"]).where("base < day").select("series", "base", "day")


def _fold(rows: Column, min_pairs: int) -> Column:
    """Over a series' days in order, each with its candidates: what the base was, and the index where the day is tied to it."""
    shape = "struct<base:date,level:double,out:array<struct<day:date,pairs:bigint,chain_index:double>>>"
    none = F.lit(None).cast("double")

    def step(acc: Column, x: Column) -> Column:
        tie = F.get(F.filter(x["ties"], lambda t: t["base"] == acc["base"]), F.lit(0))
        pairs = F.coalesce(tie["pairs"], F.lit(0)).cast("long")
        first, tied = acc["base"].isNull(), pairs >= min_pairs
        level = F.when(~first & tied, acc["level"] * tie["step"]).otherwise(acc["level"])
        said = F.struct(x["day"].alias("day"), F.when(first, 0).otherwise(pairs).cast("long").alias("pairs"), F.when(first | tied, level).otherwise(none).alias("chain_index"))
        return F.struct(F.when(first | tied | x["covered"], x["day"]).otherwise(acc["base"]).alias("base"), level.alias("level"), F.concat(acc["out"], F.array(said)).alias("out"))

    start = F.struct(F.lit(None).cast("date").alias("base"), F.lit(100.0).alias("level"), F.array().cast("array<struct<day:date,pairs:bigint,chain_index:double>>").alias("out")).cast(shape)
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def chain_index(prices: DataFrame, min_pairs: int = 3, cover: float = 0.5) -> DataFrame:
    """series, day, pairs, chain_index. ``prices``: series, day, member, v, one row for a member's day; null prices are absent.

    A day with at least ``min_pairs`` members of the base day moves the index by the median of their ratios and becomes the base. A day with
    fewer has no index (a break); it becomes the base all the same if ``cover`` of the series' members are there, and the chain
    goes on from the last index. The first day is 100. Which day is the base depends on all days before, but only a calendar's rows of counts
    and medians are folded in order; members meet on their own key, and medians are spread.
    """
    d = prices.where("v is not null").select("series", "day", "member", "v")
    size = d.groupBy("series").agg(F.countDistinct("member").alias("size"))
    days = d.groupBy("series", "day").agg(F.count("*").alias("present")).join(size, "series").select("series", "day", (F.col("present") >= cover * F.col("size")).alias("covered"))
    then = d.where("v <> 0").select("series", F.col("day").alias("base"), "member", F.col("v").alias("was"))
    both = base_pairs(days).join(then, ["series", "base"]).join(d, ["series", "day", "member"])
    steps = interpolated(both.select("series", "base", "day", (F.col("v") / F.col("was")).alias("ratio")), ["series", "base", "day"], "ratio", {"step": 0.5})
    ties = steps.groupBy("series", "day").agg(F.collect_list(F.struct("base", F.col("n").alias("pairs"), "step")).alias("ties"))
    no_ties = F.array().cast("array<struct<base:date,pairs:bigint,step:double>>")
    rows = days.join(ties, ["series", "day"], "left").withColumn("ties", F.coalesce("ties", no_ties))
    folded = rows.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("day", "covered", "ties"))).alias("rows"))
    return folded.select("series", F.explode(_fold(F.col("rows"), min_pairs)).alias("x")).select("series", "x.*")

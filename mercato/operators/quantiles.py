"""Exact quantiles of large groups, spread over tasks.

Equal values of a group are counted first, before any shuffle. The counts go to buckets of nearby values, whose sums are few for a group and
tell which bucket holds the wanted rank. Only the values of such buckets are ordered, a bucket at a time: no task holds or sorts a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS = 64  # buckets for each factor of e


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """keys, n (values that are not null) and, for each name, the value at a rank from 1, given as SQL over n. Null keys are groups."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m"))
    counts = counts.withColumn("b", F.floor(F.signum("v") * F.log1p(F.abs("v")) * STEPS))
    w = Window.partitionBy(*keys)
    sums = counts.groupBy(*keys, "b").agg(F.sum("m").alias("s"))
    sums = sums.select("*", (F.sum("s").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.sum("s").over(w).alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.expr(f"cast({e} as bigint)").alias("rank")) for name, e in ranks.items()])
    hits = F.filter(wanted, lambda x: (x["rank"] > F.col("before")) & (x["rank"] <= F.col("before") + F.col("s")))
    found = sums.withColumn("hits", hits).where(F.size("hits") > 0).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b").alias("_b"), "before", "n", "hits")
    same = F.col("b") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    near = counts.join(found, same)
    run = F.sum("m").over(Window.partitionBy(*keys, "b").orderBy("v")) + F.col("before")
    near = near.withColumn("upto", run).withColumn("hit", F.explode("hits")).where((F.col("hit.rank") > F.col("upto") - F.col("m")) & (F.col("hit.rank") <= F.col("upto")))
    return near.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("hit.name") == name, F.col("v"))).alias(name) for name in ranks])


def interpolated(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and the interpolated quantile of each name."""
    ranks = {}
    for name, p in shares.items():
        ranks |= {f"{name}_lo": f"floor({p}D * (n - 1)) + 1", f"{name}_hi": f"ceil({p}D * (n - 1)) + 1"}
    out = at_ranks(df, keys, value, ranks)
    part = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    return out.select(*keys, "n", *[(F.col(f"{x}_lo") + part(p) * (F.col(f"{x}_hi") - F.col(f"{x}_lo"))).alias(x) for x, p in shares.items()])

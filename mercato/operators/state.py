"""Keyed state without in-place updates: every operator is a pure function of the table before and the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_only(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the batch's rows whose key is new, each key once. Null keys are keys."""
    t = table.alias("t")
    new = batch.dropDuplicates(keys).alias("b")
    cond = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return table.unionByName(new.join(t, cond, "left_anti"), allowMissingColumns=True)


def upsert_latest(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``; on a tie the batch's."""
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(order, "_new", *[c for c in rest if c != order])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def protect(rebuilt: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Rebuilt rows, except where a person has decided: those rows stay as they are."""
    return decided.unionByName(rebuilt.join(decided.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def append_archive(manifest: DataFrame, fresh: DataFrame, part: str, rows: str = "rows_") -> DataFrame:
    """Partitions that may be written: new ones and those that do not shrink against the manifest's last count."""
    last = manifest.groupBy(part).agg(F.max(rows).alias("_had"))
    return fresh.join(last, part, "left").where(F.col("_had").isNull() | (F.col(rows) >= F.col("_had"))).drop("_had")

"""Connected components of records that share keys, without pairs: every record of a key is tied to the key's least record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_table, write_table

_EDGE = "u long, v long"


def ties(evidence: DataFrame, record: str = "record", key: str = "key") -> DataFrame:
    """u, v: each record and the least record of each of its keys. A key of n records gives n - 1 ties; null keys tie nothing."""
    e = evidence.where(F.col(record).isNotNull() & F.col(key).isNotNull()).select(F.col(record).cast("long").alias("u"), F.col(key).alias("k")).distinct()
    least = e.groupBy("k").agg(F.min("u").alias("v"))
    return e.join(least, "k").where("u <> v").select("u", "v").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """record, cluster: the least record that each tied one reaches; the least itself is left out.

    Rounds alternate: larger neighbours are tied to the least one, then smaller ones. They grow with the logarithm of the longest chain, every
    round's edges are a table in the shared folder, and no node's neighbours are ever collected. Not settled after ``most_rounds``: an error.
    """
    spark = edges.sparkSession
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = write_table(edges, "ties")
    was = None
    for _ in range(most_rounds):
        edges = spark.read.schema(_EDGE).parquet(path)
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if state == was or not state[0]:
            return edges.select(F.col("u").alias("record"), F.col("v").alias("cluster"))
        was = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, path = path, write_table(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "ties")
        drop_table(spark, old)
    raise RuntimeError(f"clusters are not settled after {most_rounds} rounds")

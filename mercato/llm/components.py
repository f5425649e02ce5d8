"""Connected components over a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_EDGE = "u long, v long"


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest reachable id of each linked id except the smallest itself.

    ``links`` has long columns u, v in any order; repeated links and self-links do no harm, and null ends are
    left out. Each round costs two aggregations and two joins of the links; a node with very many links
    is only aggregated (combined before the shuffle) or split by the adaptive skew join. Rounds grow with
    the logarithm of the longest chain; if ``most_rounds`` are not enough, that is an error. An empty table gives no rows.
    """
    spark = links.sparkSession
    pairs = links.where("u is not null and v is not null and u <> v")
    path = common.write_table(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    edges = spark.read.schema(_EDGE).parquet(path)
    sign = _signature(edges)
    for _ in range(most_rounds if sign[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u")
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, path = path, common.write_table(small, "links")
        edges = spark.read.schema(_EDGE).parquet(path)
        common.drop_table(spark, old)
        was, sign = sign, _signature(edges)
        if was == sign:
            break
    else:
        if sign[0]:
            raise RuntimeError(f"the components are not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

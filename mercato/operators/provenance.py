"""Values that were inferred from others, kept with what they came from: carrying them on and taking them back, over any number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_table, write_table


def reachable(edges: DataFrame, start: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """fact: all that is derived, directly or not, from the facts of ``start`` (column fact). ``edges``: derived, premise.

    A frontier moves along the edges by equi-joins, each round only with what is new, until nothing is. Rounds are as many as the longest
    derivation; cycles end, as a fact is new once. Rounds are tables in the shared folder; nothing is collected.
    """
    spark = edges.sparkSession
    steps = edges.where("derived is not null and premise is not null").select("derived", "premise").distinct()
    new = write_table(start.select("fact").where("fact is not null").distinct(), "frontier")
    done: list[str] = []
    shape = start.select("fact").schema
    for _ in range(most_rounds):
        frontier = spark.read.schema(shape).parquet(new)
        found = steps.join(frontier, F.col("premise") == F.col("fact"), "left_semi").select(F.col("derived").alias("fact")).distinct()
        for path in done:
            found = found.join(spark.read.schema(shape).parquet(path), "fact", "left_anti")
        path = write_table(found, "frontier")
        if spark.read.schema(shape).parquet(path).isEmpty():
            drop_table(spark, path)
            break
        done.append(path)
        if len(done) > 8:  # many rounds are folded into one table
            folded = write_table(spark.read.schema(shape).parquet(*done), "revoked")
            for old in done[:-1]:
                drop_table(spark, old)
            done = [folded]
        new = path
    else:
        raise RuntimeError(f"derivations are longer than {most_rounds} steps")
    if not done:
        return start.select("fact").where("false")
    return spark.read.schema(shape).parquet(*done)


def revoke(facts: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``facts`` (fact, value, origin: source or inferred) with what was derived from a changed fact taken back: value null, origin revoked.

    A derivation needs all its premises, so one changed premise is enough. Changed facts themselves stay, as do facts that nothing links to a
    changed one; a source is never revoked, even if an edge says that it was derived.
    """
    gone = reachable(edges, changed).withColumn("gone", F.lit(True))
    both = facts.join(gone, "fact", "left")
    lost = F.col("gone").isNotNull() & (F.col("origin") == "inferred")
    return both.select("fact", F.when(~lost, F.col("value")).alias("value"), F.when(lost, "revoked").otherwise(F.col("origin")).alias("origin"))

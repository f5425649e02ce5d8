"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are in ``P`` source partitions by a hash of their key. Shards are cut into parts of at most ``part_rows`` slots, so that
no task ever sorts a whole shard; part sizes are fixed and shard sizes differ by one row at most. Row ``p`` of the matrix
says how many rows of partition ``p`` go to each part. It is drawn exactly: a multivariate hypergeometric draw of the
partition's size from the slots that are left. A partition is then permuted locally, dealt out along its matrix row, and
each part is permuted again. There are ``least_sources`` sources at any size, so that one task never orders the whole table,
and about ``most_parts`` sources and parts at most, so the driver draws a bounded matrix; the drawn cells that are not
empty go out as a table (a marker for each), never as a broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 10**9


def _draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws without replacement from ``room`` slots fall in each part."""
    if room.sum() < LIMIT:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    if len(room) == 1:
        return np.array([n])
    half = len(room) // 2  # parts are halved until numpy's limit holds
    left, right = int(room[:half].sum()), int(room[half:].sum())
    k = int(_hypergeometric(rng, left, right, n))
    return np.concatenate([_draw(rng, room[:half], k), _draw(rng, room[half:], n - k)])


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw of any size by inversion outward from the mode."""
    if good + bad < LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    from math import exp, lgamma

    lo, hi = max(0, n - bad), min(n, good)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    pick = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    up = down = peak = exp(pick(good, mode) + pick(bad, n - mode) - pick(good + bad, n))
    u, i, j = rng.random() - peak, mode, mode
    while u > 0 and (i < hi or j > lo):
        if i < hi:
            up *= (good - i) / (i + 1) * (n - i) / (bad - n + i + 1)
            i += 1
            if (u := u - up) <= 0:
                return i
        if j > lo:
            down *= j / (good - j + 1) * (bad - n + j) / (n - j + 1)
            j -= 1
            if (u := u - down) <= 0:
                return j
    return mode


def communication_matrix(sources: list[int], parts: list[int], seed: int):
    """Rows of the matrix, one for each source; columns sum to ``parts``."""
    rng, room = np.random.default_rng(seed), np.array(parts, np.int64)
    for n in sources:
        row = _draw(rng, room, n)
        room -= row
        yield row


def shuffle_into_shards(
    rows: DataFrame, shards: int = 8, key: str = "doc_id", seed: int = 20, part_rows: int = 250_000, most_parts: int = 1000, shard_col: str = "shard", slot_col: str = "slot",
    least_sources: int = 8,
) -> DataFrame:
    """``rows`` with ``shard_col`` (0 to shards - 1) and ``slot_col`` (its place there, gapless from 0).

    A uniformly random assignment for a seed: all shards have the same number of rows or one more, and every order of the
    rows is equally likely. The input is read three times, for its size, the sizes of its source partitions and its rows; it must not change meanwhile.
    A null key has a source partition as any other value has; rows with equal keys are spread by their other columns'
    hash, and wholly equal rows are interchangeable. An empty table gives no rows. Columns named like the two results are
    replaced. Wide columns travel with the rows: select what is needed.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in (shard_col, slot_col)]
    every = F.xxhash64(F.lit(seed), *[F.col(c) for c in names])
    total = rows.count()
    part_rows = max(part_rows, total // most_parts)
    sources = max(least_sources, -(-total // part_rows))
    # The caller's columns travel as one struct, so none of their names can clash with a helper's.
    base = rows.select(F.struct(*names).alias("row"), every.alias("order"), F.col(key).alias("key"))
    base = base.withColumn("source", F.pmod(F.xxhash64(F.lit(~seed), F.col("key"), "order"), F.lit(sources)).cast("int"))
    counts = {r[0]: r[1] for r in base.groupBy("source").count().collect()}

    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    parts = []  # (shard, first slot, size)
    for s, n in enumerate(sizes):
        k = max(1, -(-n // part_rows))
        bounds = [n * i // k for i in range(k + 1)]
        parts += [(s, a, b - a) for a, b in zip(bounds, bounds[1:])]
    cells = []
    matrix = communication_matrix([counts.get(p, 0) for p in range(sources)], [x[2] for x in parts], seed)
    for p, row in enumerate(matrix):
        begin = np.cumsum(row) - row
        cells += [(p, int(begin[j]), int(j), parts[j][0], parts[j][1]) for j in np.flatnonzero(row)]
    marks = spark.createDataFrame(cells, "source int, begin long, part int, shard int, first long")

    local = Window.partitionBy("source").orderBy("order", "key")
    dealt = base.withColumn("at", F.row_number().over(local) - F.lit(1)).withColumn("mark", F.lit(1))
    both = dealt.unionByName(marks.select("source", F.col("begin").alias("at"), "part", "shard", "first", F.lit(0).alias("mark")), allowMissingColumns=True)
    along = Window.partitionBy("source").orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(along).alias(c)
    sent = both.select("row", "key", "order", "mark", last("part"), last("shard"), last("first")).where("mark = 1")
    again = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "order"), "order", "key")
    return sent.select("row.*", F.col("shard").alias(shard_col), (F.col("first") + F.row_number().over(again) - 1).cast("long").alias(slot_col))

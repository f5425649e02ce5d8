"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half-keys are computed for a document, ``m`` in each, a half-key being ``rows`` minima.
Every pair of a half-key of the first and one of the second collection is the key of one table, so ``m * m`` tables
of ``2 * rows`` minima cost ``2 * m * rows`` minima instead of ``2 * m * m * rows``. ``m`` follows from the threshold:
a linked pair shares no table with probability under ``2 * miss``.

Candidates are verified on full shingle sets. Pairs of a crowded bucket are not emitted: members are held against the bucket's
hub, the member with the least share of shingles of its own. A member x that is not linked to its hub h can be linked to a member y of
another component in two ways only. Either they share a shingle that h lacks, so x and y meet by equality on (h, shingle), again
through a hub of that group first. Or all they share is in h; then ``J(x, y) >= t > J(x, h)`` makes y smaller than h, by a size
that x bounds, so they meet by equality on (h, size). Nothing else in a bucket has to meet, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

_SIGNED = np.int64


def half_keys_needed(percent: int, rows: int, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)))


class Tensor:
    """The half-keys of a set of 64-bit hashes."""

    def __init__(self, m: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.m, self.rows = m, rows
        n = 2 * m * rows
        self.mul = rng.integers(0, 2**63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**64, (n, 1), dtype=np.uint64)
        self.fold = rng.integers(0, 2**63, (1, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def halves(self, hashes: np.ndarray) -> np.ndarray:
        """2 * m half-keys, the first collection's before the second's."""
        low = np.full(len(self.mul), np.uint64(2**64 - 1))
        for a in range(0, len(hashes), 4096):
            np.minimum(low, (self.mul * hashes[None, a : a + 4096] + self.add).min(axis=1), out=low)
        return common.mix64((low.reshape(-1, self.rows) * self.fold).sum(axis=1, dtype=np.uint64))


_SIGNED_ROWS = "doc_id long, n_shingles long, set_hi long, set_lo long, left_keys array<long>, right_keys array<long>"


def _signatures(run_id: str, m: int, rows: int, words: int):
    def run(batches):
        common.only(run_id)
        tensor = Tensor(m, rows)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = common.shingle_sets(part.column(1), words)
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), _SIGNED).reshape(-1, 2)
                keys = [tensor.halves(s).view(_SIGNED) if len(s) else None for s in sets]
                half = lambda lo, hi: pa.array([None if k is None else k[lo:hi] for k in keys], pa.list_(pa.int64()))
                cols = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), half(0, m), half(m, 2 * m)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_hi", "set_lo", "left_keys", "right_keys"])
        common.release()

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [s.tobytes() for s in common.shingle_sets(part.column(1), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])

    return run


def _exploded(batches):
    for batch in batches:
        sets, ids = batch.column("hashes").to_pylist(), batch.column("doc_id").to_numpy()
        sizes = np.array([len(x) // 8 for x in sets], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sets), np.int64)), pa.array(np.repeat(ids, sizes))], names=["h", "doc_id"])


_OUTSIDE = "hub long, rep long, n long, rank double, both long, outside array<long>"


def _outside(batches):
    """How many shingles a member shares with its hub, and those that the hub lacks."""
    for batch in batches:
        shared, rest = [], []
        for x, h in zip(batch.column("hx").to_pylist(), batch.column("hy").to_pylist()):
            x = np.frombuffer(x, np.int64)
            there = np.isin(x, np.frombuffer(h, np.int64), assume_unique=True)
            shared.append(int(there.sum()))
            rest.append(x[~there])
        cols = [*(batch.column(c) for c in ("hub", "rep", "n", "rank")), pa.array(shared, pa.int64()), pa.array(rest, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["hub", "rep", "n", "rank", "both", "outside"])


def _verdicts(percent: int):
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("hx").to_pylist(), batch.column("hy").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    linked.append(False)
                    continue
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                linked.append(100 * both >= percent * (len(z) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])
            common.release()

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, rows: int = 3, miss: float = 1e-4,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Documents whose ``words``-word shingle sets (A-Z folded) have ``100 * intersection >= percent * union`` are
    linked; a component has its smallest id. Texts without words (null, empty, white space) have an empty set and
    link with nothing; a text of fewer words is one shingle. Rows with a null id are kept, link with
    nothing and have a null component. Repeated rows are copies of each other under one id. Other columns are not read. An empty table
    gives no rows; a text is hashed whole, 4096 shingles at a time. The result is a table in the shared folder, the steps' own are dropped.
    """
    spark = docs.sparkSession
    common.ship(spark)
    m = half_keys_needed(percent, rows, miss)
    paths: list[str] = []

    def made(label: str, df: DataFrame) -> DataFrame:
        paths.append(common.write_table(df, label))
        return spark.read.schema(df.schema).parquet(paths[-1])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = made("signed", narrow.mapInArrow(_signatures(common.new_run(), m, rows, words), _SIGNED_ROWS))
    some = signed.where("doc_id is not null and n_shingles > 0")
    first = some.groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "left_keys", "right_keys")).alias("x"))
    reps = made("reps", first.select("set_hi", "set_lo", F.col("x.doc_id").alias("rep"), "x.left_keys", "x.right_keys"))
    rows_ = reps.select("rep", F.posexplode("left_keys").alias("i", "a"), "right_keys").select("rep", "i", "a", F.posexplode("right_keys").alias("j", "b"))
    keyed = rows_.select(F.xxhash64("i", "a", "j", "b").alias("key"), "rep")
    # The ends of a bucket are aggregated, combined before the shuffle; its rows come by a join whose skew is split.
    ends = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top").select("key")
    buckets = made("buckets", keyed.select("key", "rep").join(ends, "key"))
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = made("sets", narrow.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, hashes binary"))

    # A shingle that no other candidate has is in no intersection: ``own`` of them bound what a document can share.
    once = sets.mapInArrow(_exploded, "h long, doc_id long").groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep = top")
    own = once.groupBy("rep").agg(F.count("*").alias("own"))
    sized = sets.select(F.col("doc_id").alias("rep"), (F.octet_length("hashes") / 8).cast("long").alias("n")).distinct()
    sized = sized.join(own, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("may")).where(100 * F.col("may") >= percent * F.col("n"))
    able = made("able", buckets.join(sized, "rep"))
    hubs = able.groupBy("key").agg(F.min(F.struct((-F.col("may") / F.col("n")).alias("rank"), "rep", "n", "may")).alias("h"), F.count("*").alias("k")).where("k > 1")
    of_hub = able.join(hubs, "key").select("rep", "n", "may", F.col("h.rep").alias("hub"), "h.rank", F.col("h.n").alias("hn"), F.col("h.may").alias("hmay"))
    members = made("members", of_hub.distinct())

    def could(n, may, hn, hmay):
        both = F.least(F.col(may), F.col(hmay))
        return 100 * both >= percent * (F.col(n) + F.col(hn) - both)

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("hx")), sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("hy"))
        both = pairs.join(x, "u").join(y, "v").select("u", "v", "hx", "hy")
        return made("verdicts", both.mapInArrow(_verdicts(percent), "u long, v long, linked boolean"))

    def with_component(df: DataFrame, col: str, out: str) -> DataFrame:
        c = found.select(F.col("node").alias(col), F.col("component").alias("_c"))
        return df.join(c, col, "left").withColumn(out, F.coalesce("_c", F.col(col))).drop("_c")

    # 1. Each member against the most central hub of its buckets, the one with the least share of shingles of its own.
    spokes = members.where("rep <> hub").where(could("n", "may", "hn", "hmay"))
    tested = verify(spokes.groupBy("rep").agg(F.min(F.struct("rank", "hub")).alias("h")).select(F.col("rep").alias("u"), F.col("h.hub").alias("v")))
    found = components(tested.where("linked").select("u", "v"))
    # 2. Members against the hub of every bucket, where not yet in one component.
    open_ = with_component(with_component(spokes.select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct(), "u", "cu"), "v", "cv")
    more = verify(open_.where("cu <> cv").select("u", "v").join(tested.select("u", "v"), ["u", "v"], "left_anti"))
    tested = tested.unionByName(more)
    found = components(_edges(found).unionByName(more.where("linked").select("u", "v")))
    # 3. Members whose component is not their hub's are not linked to it. They meet others of the hub on what the hub lacks, or by size.
    def parted(df: DataFrame) -> DataFrame:
        return with_component(with_component(df, "rep", "c"), "hub", "ch")

    far_hubs = parted(members.select("hub", "rep")).where("c <> ch").select("hub").distinct()
    mixed = members.join(far_hubs, "hub").select("hub", "rep", "n", (-F.col("may") / F.col("n")).alias("rank"))
    x, y = sets.select(F.col("doc_id").alias("rep"), F.col("hashes").alias("hx")), sets.select(F.col("doc_id").alias("hub"), F.col("hashes").alias("hy"))
    outs = made("outside", mixed.join(x, "rep").join(y, "hub").select("hub", "rep", "n", "rank", "hx", "hy").mapInArrow(_outside, _OUTSIDE))

    def strangers(df: DataFrame) -> DataFrame:
        """Rows of (hub, shingle) groups that hold more than one component, with c and ch."""
        df = parted(df.drop("c", "ch"))
        several = df.groupBy("hub", "e").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct("rank", "rep")).alias("sub")).where("lo <> hi")
        return df.join(several.select("hub", "e", "sub"), ["hub", "e"])

    met = made("met", strangers(outs.select("hub", "rep", "n", "rank", "both", F.explode("outside").alias("e"))))
    done = made("done", tested.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    ordered = lambda df, p, q: df.select(F.greatest(p, q).alias("u"), F.least(p, q).alias("v")).distinct().join(done, ["u", "v"], "left_anti")
    to_sub = met.select("rep", F.col("sub.rep").alias("sub")).where("rep <> sub").distinct()
    apart = with_component(with_component(to_sub, "rep", "cu"), "sub", "cv").where("cu <> cv")
    more = verify(ordered(apart, "rep", "sub"))
    found = components(_edges(found).unionByName(more.where("linked").select("u", "v")))
    done = done.unionByName(more.select("u", "v"))

    left = made("left", strangers(met.drop("sub")).drop("sub"))
    shares = left.groupBy("hub", "rep").agg(F.count("*").alias("ns"))
    left = left.join(shares, ["hub", "rep"])
    enough = lambda both, n: both * (100 + percent) >= percent * n
    fx = left.where("c <> ch").select("hub", "e", F.col("rep").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("both").alias("bx"), F.col("ns").alias("sx"))
    by_shingle = left.join(fx, ["hub", "e"]).where((F.col("c") != F.col("cx")) & enough(F.least("both", "bx") + F.least("ns", "sx"), F.col("n") + F.col("nx")))
    known = parted(outs.select("hub", "rep", "n", "both"))
    low, high = F.ceil(F.col("n") * percent / 100), F.least(F.floor(F.col("both") * (100 + percent) / percent) - F.col("n"), F.floor(F.col("n") * 100 / percent))
    sizes = known.where("c <> ch").where(low <= high).select("hub", F.col("rep").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("both").alias("bx"), F.explode(F.sequence(low, high)).alias("n"))
    by_size = known.join(sizes, ["hub", "n"]).where((F.col("c") != F.col("cx")) & enough(F.least("both", "bx"), F.col("n") + F.col("nx")))
    more = verify(ordered(by_shingle.select("x", "rep").unionByName(by_size.select("x", "rep")), "x", "rep"))
    found = components(_edges(found).unionByName(more.where("linked").select("u", "v")))

    named = with_component(reps.select("set_hi", "set_lo", "rep"), "rep", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_hi", "set_lo").join(named, ["set_hi", "set_lo"], "left")
    mine = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), mine).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = common.table(out, "near_duplicates")
    for p in paths:
        common.drop_table(spark, p)
    return out


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("u"), F.col("component").alias("v"))

"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

A text's shingle hashes are binned once by their high bits; a bin keeps its least hash. An empty bin takes the value of the
first bin with one along its own pseudo-random probe sequence, the same for all texts (optimal densification). Four low bits of
each of the ``BINS`` values are kept, a hexadecimal digit each. All of it is built-in functions; arrays are sorted as primitive longs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 8
BINS = 1 << BITS
KEPT_BITS = 4
PROBES = 6
WORDS = 5
_RNG = np.random.default_rng(4242)
_PROBE = _RNG.integers(0, BINS, (BINS, PROBES)).tolist()
_LOW = (1 << (63 - BITS)) - 1


def _bin(h: Column) -> Column:
    return F.shiftright(h, 63 - BITS)


def _words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text."""
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: BINS hexadecimal digits, or an empty string for a text without words (null, empty, white space).

    A text of fewer than five words is one shingle. Equal texts, and texts with the same set of shingles, are equal in ``out``.
    """
    w, c, s, b, there = (f"__{out}_{x}" for x in ("words", "count", "sorted", "bins", "there"))
    names = [c for c in df.columns if c != out]
    hashed = df.select(*names, F.transform(_words(F.coalesce(F.col(text), F.lit(""))), lambda x: F.xxhash64(x)).alias(w))
    n = F.size(w)
    mask = F.lit((1 << 63) - 1)
    many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(WORDS)]).bitwiseAND(mask))
    few = F.array(F.xxhash64(F.col(w)).bitwiseAND(mask))
    ends = F.expr(f"transform(sequence(0L, {BINS - 1}L), i -> shiftleft(i, {63 - BITS}) + {_LOW}L)")
    hashes = F.when(n >= WORDS, many).otherwise(few)
    binned = hashed.select(*names, n.alias(c), F.sort_array(F.concat(hashes, ends)).alias(s))
    least = F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(s), i - 1))))
    binned = binned.select(*names, c, least.alias(b))
    probes = F.array(*[F.array(*[F.lit(p) for p in row]) for row in _PROBE])
    empty = lambda x: x.bitwiseAND(F.lit(_LOW)) == _LOW
    binned = binned.select(*names, c, b, F.filter(F.transform(b, lambda x, i: F.when(empty(x), F.lit(-1)).otherwise(i)), lambda i: i >= 0).alias(there))

    def borrow(i):
        quick = F.get(F.filter(F.get(probes, i), lambda p: ~empty(F.get(F.col(b), p))), F.lit(0))
        # The probe sequence goes on through all bins, in the order of a hash of both bins.
        slow = F.array_min(F.transform(F.col(there), lambda j: F.struct(F.xxhash64(i, j).alias("h"), j.alias("j"))))["j"]
        # A borrowed value is hashed with its bin, else a text of one shingle would have the same digit everywhere.
        return F.xxhash64(F.get(F.col(b), F.coalesce(quick, slow)), i)

    dense = F.transform(b, lambda x, i: F.when(empty(x), borrow(i)).otherwise(x))
    digits = F.array_join(F.transform(dense, lambda x: F.lower(F.hex(x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1))))), "")
    return binned.select(*names, F.when(F.col(c) > 0, digits).otherwise(F.lit("")).alias(out))


def _longs(digits: Column) -> list[Column]:
    per = 64 // KEPT_BITS
    return [F.conv(F.substring(digits, 1 + per * k, per), 16, -10).cast("long") for k in range(BINS // per)]


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal digits, freed of the equality that chance gives.

    Two empty fingerprints are alike (1), an empty and another are not (0). Digits are compared 16 at once as longs.
    """
    differ = F.lit(0)
    for x, y in zip(_longs(a), _longs(b)):
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 1 / (1 << KEPT_BITS)
    est = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((BINS - differ) / F.lit(BINS) - chance) / (1 - chance)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(est)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``key``, by bisection in a literal array; null is 0."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
        F.when(F.get(array, F.shiftright(s["lo"] + s["hi"], 1)) <= key, F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi"))
        )
    )
    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), ends, step)["lo"]


def with_next(docs: DataFrame, id_col: str, cols: list[str], prepare=lambda df: df, bucket_rows: int = 1000, most_buckets: int = 131_072) -> DataFrame:
    """``prepare(docs)`` with next_<c> for each of ``cols``: the value of the next row in descending id; the first row follows the last.

    Rows go once to buckets of consecutive ids, as many as there are ``bucket_rows`` up to ``most_buckets``, beyond which buckets grow and
    are sorted with spilling; a bucket's neighbour row is sent along. ``prepare`` may add columns, row by row; it is applied to the neighbour
    rows alone where they are copied, not to all rows again. Null ids come last; equal ids are ordered by the columns. The driver
    gets the buckets' bounds.
    """
    key = F.col(id_col).cast("long")
    n = docs.count()
    k = min(most_buckets, max(1, n // bucket_rows))
    cuts = docs.agg(F.percentile_approx(key, [i / k for i in range(1, k)] or [0.5], F.lit(max(10_000, 4 * k)))).first()[0] or []
    bounds = sorted(set(cuts)) if k > 1 else []
    marked = docs.withColumn("__bucket", _bucket(key, bounds))
    tops = dict(marked.groupBy("__bucket").agg(F.max(key)).where(F.col("__bucket").isNotNull()).collect())
    present = sorted(b for b, top in tops.items() if top is not None)
    below = {b: tops[present[i - 1]] for i, b in enumerate(present)}  # the lowest bucket is followed by the highest
    if 0 in tops and tops[0] is None and present:  # only null ids in the lowest bucket
        below = {b: tops[present[i - 1]] if i else None for i, b in enumerate(present)} | {0: tops[present[-1]]}
    pairs = [(b, t) for b, t in below.items() if t is not None]
    w = Window.partitionBy("__bucket").orderBy("__ghost", key.desc_nulls_last(), *cols)
    both = marked.withColumn("__ghost", F.lit(0))
    if pairs:
        to = docs.sparkSession.createDataFrame(pairs, "__to int, __top long")
        ghosts = docs.join(F.broadcast(to), key == F.col("__top")).drop("__top").withColumnRenamed("__to", "__bucket").withColumn("__ghost", F.lit(1))
        both = both.unionByName(ghosts)
    led = prepare(both).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols], F.lead(F.lit(1)).over(w).alias("__has"))
    fill = [F.when(F.col("__has").isNotNull(), F.col(f"next_{c}")).otherwise(F.col(c)).alias(f"next_{c}") for c in cols]
    own = [c for c in led.columns if c not in ("__ghost", "__bucket", "__has", *(f"next_{x}" for x in cols))]
    return led.where("__ghost = 0").select(*own, *fill)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``.

    The edited text has the last half of the code points replaced by the first as many of the next text in descending id.
    Null texts are empty; a single row is its own next. Rows with equal ids follow each other in the order of their texts; repeated rows
    are rows of their own. An empty table gives no rows. Other columns are not read. A text of any length is one row, with its words as an array.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    led = with_next(rows, "doc_id", ["text", "fingerprint"], lambda df: with_fingerprint(df, "text", "fingerprint"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    made = led.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    made = with_fingerprint(made, "edited", "edited_fingerprint")
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

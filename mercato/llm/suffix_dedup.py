"""Removal of bytes that a long string starting earlier in the corpus already covers.

How suffix arrays are spread over a cluster: from every ``length``-byte string the leftmost least hash of its
``GRAM``-byte substrings picks an anchor, so equal strings pick the same anchor at the same offset. Anchors go
through one shuffle as narrow rows; of those with one context in a batch only the first goes on. Of an anchor that occurs
once nothing can repeat. Occurrences whose whole context (all strings that could pick the anchor) equals an earlier one's are
covered outright. What is left, the first occurrence of each distinct context of an anchor with several, is put end to end, and the
suffix array of that text (``suffix_array``) brings equal strings together: of a run of suffixes with ``length`` common bytes only
the earliest start stays.

No suffix array gets more than ``most_contexts`` contexts. A larger group is split by content, not by chance: its strings are those
with ``lo`` to ``hi`` bytes before the anchor; the half with at most the middle of that shares more bytes behind the anchor,
the other half more bytes before it, and each half is parted by what its strings must have in common. Equal parts of contexts are
one, so a group whose strings are all equal is done, and groups end in suffix arrays again. A context gives two rows a level at most and
no two contexts are ever paired.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .suffix_array import suffix_array

GRAM = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(77)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)


class _Roll:
    """Hashes of substrings by prefix sums of a polynomial modulo 2 ** 64 over random byte values."""

    def __init__(self, raw: bytes):
        n = len(raw)
        self.up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * self.up[:n], out=self.sums[1:])

    def each(self, start, end):
        return common.mix64((self.sums[end] - self.sums[start]) * self.down[start])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = common.held("powers", None, list)
    if not both or len(both[0]) < n:
        size = max(n, 1 << 17)
        both[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            both.append(np.multiply.accumulate(x))
    return both[0][:n], both[1][:n]


_PLACE = 24


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their hashes and the hashes of their contexts."""
    n, most = len(raw), 1 << (_PLACE - 1)
    if n < length:
        none = np.empty(0, np.uint64)
        return none.astype(np.int64), none, none
    roll = _Roll(raw)
    grams = n - GRAM + 1
    h = common.mix64((roll.sums[GRAM:] - roll.sums[:grams]) * roll.down[:grams])
    w = length - GRAM + 1
    picked = []
    for a in range(0, grams - w + 1, most):  # each part has whole windows; a place in it fits in the low bits
        part = h[a : a + most + w - 1]
        low = (part >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span < w:  # low[i]: least of part[i : i + span], on equal hashes the leftmost
            step = min(span, w - span)
            low = np.minimum(low[: len(low) - step], low[step:])
            span += step
        place = low & np.uint64((1 << _PLACE) - 1)
        picked.append(place[np.concatenate([[True], place[1:] != place[:-1]])].astype(np.int64) + a)
    at = picked[0] if len(picked) == 1 else np.unique(np.concatenate(picked))
    start = np.maximum(at - (length - GRAM), 0)
    return at, h[at], roll.each(start, np.minimum(at + length, n)) + common.mix64((at - start).astype(np.uint64))


#: A place is a long: below bit 32 the byte, above it which of its id's texts it is in (``_told_apart``), 0 nearly always.
_TEXT_BITS = 32
_LOW = (1 << _TEXT_BITS) - 1
_ANCHORS = "ah long, ch long, doc_id long, pos long, late boolean"


def _find_anchors(run_id: str, length: int):
    """Anchors of all texts. What has the context of an earlier anchor of the batch is late: it gets an anchor of its own, so nothing meets it.

    Rows that are equal are one document: their anchors are the same places, of which one goes on.
    """

    def run(batches):
        common.only(run_id)
        for batch in batches:
            found = []
            for doc_id, text, which in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                at, ah, ch = anchors((text.as_py() or "").encode(), length)
                found.append((ah.view(np.int64), ch.view(np.int64), np.full(len(at), doc_id, np.int64), at + (which << _TEXT_BITS)))
            ah, ch, doc_id, pos = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64) for _ in range(4))
            key = common.mix64(ah.view(np.uint64) ^ common.mix64(ch.view(np.uint64)))
            order = np.lexsort((pos, doc_id, key))
            late = np.zeros(len(key), bool)
            late[order[1:]] = key[order][1:] == key[order][:-1]
            again = np.zeros(len(key), bool)
            again[order[1:]] = late[order[1:]] & (doc_id[order][1:] == doc_id[order][:-1]) & (pos[order][1:] == pos[order][:-1])
            if again.any():
                ah, ch, doc_id, pos, late, key = (x[~again] for x in (ah, ch, doc_id, pos, late, key))
            own = common.mix64(common.mix64(doc_id.view(np.uint64)) ^ pos.astype(np.uint64)).view(np.int64)
            for a in range(0, len(key), 1 << 16):
                cols = [pa.array(x[a : a + (1 << 16)]) for x in (np.where(late, own, ah), ch, doc_id, pos, late)]
                yield pa.RecordBatch.from_arrays(cols, names=["ah", "ch", "doc_id", "pos", "late"])
        common.release()

    return run


_CONTEXTS = "ah long, k int, doc_id long, start long, off int, context binary"


def _cut_contexts(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
                raw = text.encode()
                for w in wanted:
                    at = w["pos"] & _LOW
                    a = max(0, at - (length - GRAM))
                    rows.append((w["ah"], w["k"], doc_id, w["pos"] - (at - a), at - a, raw[a : at + length]))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays(cols, names=["ah", "k", "doc_id", "start", "off", "context"])

    return run


def _longest_shared(parts: list[bytes]) -> list[int]:
    """How long a prefix of each part some other part has."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = len(os.path.commonprefix([parts[i], parts[j]]))
        best[i] = max(best[i], n)
        best[j] = n
    return best


#: No UTF-8 text has these bytes: no common string goes beyond a context's end, and the anchor, which all strings of a context hold at the
#: same place if they are equal, is one symbol.
_END, _ANCHOR = b"\xff", b"\xfe"


def repeats(contexts: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int]]:
    """(document, start) of each ``length``-byte string around one anchor that also starts earlier around it.

    A context is (document, start, the anchor's place in it, bytes). What no other context shares to the left or right of the anchor is
    left out; the rest, end to end, is the suffix array's text.
    """
    left = _longest_shared([c[:off][::-1] for _, _, off, c in contexts])
    right = _longest_shared([c[off + GRAM :] for _, _, off, c in contexts])
    parts, origin, symbols = [], [], length - GRAM + 1
    for (doc_id, start, off, c), a, b in zip(contexts, left, right):
        m = a + GRAM + b - length + 1
        if m < 1:
            continue
        parts.append(c[off - a : off] + _ANCHOR + c[off + GRAM : off + GRAM + b])
        origin += [(doc_id, start + off - a + j) for j in range(m)]
        origin += [None] * symbols  # starts with too few bytes before the end
    if not parts:
        return []
    text = _END.join(parts) + _END
    late, run, last = [], [], b""
    for s in suffix_array(text):
        if origin[s] is None:
            continue
        if (this := text[s : s + symbols]) != last:
            late += sorted(set(run))[1:]
            run, last = [], this
        run.append(origin[s])
    return late + sorted(set(run))[1:]


def _spans(late: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """Covered runs (document, start, size); sizes stay under twice ``length`` where starts are close."""
    late = sorted(set(late))
    i = 0
    while i < len(late):
        d, a = late[i]
        b = a
        while i + 1 < len(late) and late[i + 1][0] == d and late[i + 1][1] <= b + length and late[i + 1][1] - a < length:
            i += 1
            b = late[i][1]
        yield d, a, b - a + length
        i += 1


_COVER = "doc_id long, start long, size int"


def _cover_batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "start", "size"])


def _rows(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _settle_groups(length: int):
    """Over rows sorted by anchor."""

    def run(batches):
        out = []
        for _, rows in groupby(_rows(batches, ("ah", "doc_id", "start", "off", "context")), key=lambda r: r[0]):
            contexts = sorted({r[1:] for r in rows})
            if len(contexts) > 1:
                out.extend(_spans(repeats(contexts, length), length))
            if len(out) > 5000:
                yield _cover_batch(out)
                out = []
        yield _cover_batch(out)

    return run


def _halves(groups: DataFrame, length: int) -> DataFrame:
    """Each context of a group in the two halves of the group's strings, with the new group and a hash of the context's part in it."""
    back = length - GRAM
    halves = F.array(F.struct("lo", F.col("mid").alias("hi")), F.struct((F.col("mid") + 1).alias("lo"), "hi"))
    rows = groups.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")).withColumn("half", F.explode(halves))
    rows = rows.select("g", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"), "doc_id", "pos", "off", "context")
    behind = F.octet_length("context") - F.col("off") - GRAM
    rows = rows.withColumn("a", F.least("hi", "off")).withColumn("b", F.least(back - F.col("lo"), behind)).where((F.col("a") + F.col("b") >= back) & (F.col("a") >= F.col("lo")) & (F.col("b") >= back - F.col("hi")))
    cut = lambda before, after: F.substring("context", F.col("off") - before + 1, before + GRAM + after)
    same = F.xxhash64("g", "lo", cut(F.col("lo"), back - F.col("hi")))
    return rows.withColumn("g", same).withColumn("part", F.xxhash64("a", "b", cut(F.col("a"), F.col("b"))))


def _refined(spark, crowd: DataFrame, length: int, most: int, drop: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs that equal parts of contexts cover, and groups of at most ``most`` contexts, of groups that are larger."""
    covers, small = [], []

    def kept(df: DataFrame, label: str) -> DataFrame:
        drop.append(common.write_table(df, label))
        return spark.read.schema(df.schema).parquet(drop[-1])

    crowd = kept(crowd, "crowd")
    while not crowd.isEmpty():
        parts = kept(_halves(crowd, length), "halves")
        firsts = parts.groupBy("g", "part").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
        sizes = firsts.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        told = parts.join(firsts, ["g", "part"])
        is_first = F.struct("doc_id", "pos") == F.col("first")
        covers.append(kept(told.where(~is_first).select("doc_id", (F.col("pos") - F.col("a")).cast("long").alias("start"), (F.col("a") + GRAM + F.col("b")).cast("int").alias("size")), "equal"))
        some = kept(told.where(is_first).drop("first", "part").join(sizes, "g"), "firsts")
        text = F.substring("context", F.col("off") - F.col("a") + 1, F.col("a") + GRAM + F.col("b"))
        small.append(some.where(F.col("n") <= most).select(F.col("g").alias("ah"), "doc_id", (F.col("pos") - F.col("a")).cast("long").alias("start"), F.col("a").cast("int").alias("off"), text.alias("context")))
        crowd = some.where(F.col("n") > most).select("g", "lo", "hi", "doc_id", "pos", "off", "context")
    return covers, small


def _told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text, which: the number of the text among the different texts of its id, by their digests; and whether any id comes twice at all."""
    some = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    often = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if often.isEmpty():
        return some.withColumn("which", F.lit(0)), False
    texts = some.join(often, "doc_id").select("doc_id", F.md5("text").alias("digest")).distinct()
    texts = texts.withColumn("which", F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")) - 1).where("which > 0")
    return some.withColumn("digest", F.md5("text")).join(texts, ["doc_id", "digest"], "left").select("doc_id", "text", F.coalesce("which", F.lit(0)).alias("which")), True


def covered(docs: DataFrame, length: int = 100, most_contexts: int = 512) -> DataFrame:
    """doc_id, which, start, size of byte runs to remove; their union is exactly the covered bytes.

    ``docs``: doc_id, text (rows with a null have none), which (the number of the text among those of its id; without it all are 0).
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.col("which") if "which" in docs.columns else F.lit(0).alias("which"))
    spark = docs.sparkSession
    drop: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        drop.append(common.write_table(df, label))
        return spark.read.schema(df.schema).parquet(drop[-1])

    found = docs.mapInArrow(_find_anchors(common.new_run(), length), _ANCHORS)
    found = found.repartition(F.col("ah")).sortWithinPartitions("ah", "ch", "doc_id", "pos")
    group, context = Window.partitionBy("ah"), Window.partitionBy("ah", "ch").orderBy("doc_id", "pos")
    first = F.first(F.struct("doc_id", "pos")).over(context)
    rows = found.select("*", (first == F.struct("doc_id", "pos")).alias("is_first"), (F.row_number().over(context) == 1).cast("int").alias("new"))
    rows = rows.select("doc_id", "pos", "ah", "late", "is_first", "new", F.sum("new").over(group).alias("k"), F.count("*").over(group).alias("n"))
    rows = rows.where("late or n > 1 and (not is_first or (k > 1 and new = 1))")
    rows = kept(rows.select("doc_id", "pos", F.when(F.col("is_first") & ~F.col("late"), F.col("ah")).alias("ah"), F.col("k").cast("int").alias("k")), "anchors")
    back = length - GRAM
    before = F.least(F.col("pos").bitwiseAND(F.lit(_LOW)), F.lit(back))
    whole = rows.where("ah is null").select("doc_id", (F.col("pos") - before).alias("start"), (F.col("pos") + length).alias("end"))
    whole = whole.select("doc_id", "start", (F.col("end") - F.col("start")).cast("int").alias("size"))

    wanted = rows.where("ah is not null").groupBy("doc_id", F.shiftright("pos", _TEXT_BITS).cast("int").alias("which")).agg(F.collect_list(F.struct("ah", "k", "pos")).alias("wanted"))
    cut = kept(docs.join(wanted, ["doc_id", "which"]).mapInArrow(_cut_contexts(length), _CONTEXTS), "contexts")
    usual = cut.where(F.col("k") <= most_contexts).select("ah", "doc_id", "start", "off", "context")
    crowd = cut.where(F.col("k") > most_contexts).select(F.col("ah").alias("g"), F.lit(0).alias("lo"), F.lit(back).alias("hi"), "doc_id", (F.col("start") + F.col("off")).alias("pos"), "off", "context")
    covers, small = _refined(spark, crowd, length, most_contexts, drop)
    for part in small:
        usual = usual.unionByName(part)
    settled = usual.repartition(F.col("ah")).sortWithinPartitions("ah").mapInArrow(_settle_groups(length), _COVER)
    for part in covers:
        whole = whole.unionByName(part)
    runs = whole.unionByName(settled).select("doc_id", F.shiftright("start", _TEXT_BITS).cast("int").alias("which"), F.col("start").bitwiseAND(F.lit(_LOW)).alias("start"), "size")
    out = common.table(runs, "covers")
    for path in drop:
        common.drop_table(spark, path)
    return out


_TEXTS = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept binary"


def remove(raw: bytes, runs: list[int]) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the runs (start * 2 ** 20 + size), the bytes removed and the maximal runs."""
    kept, at, removed, spans, upto = [], 0, 0, 0, -1
    for x in sorted(runs):
        a, b = x >> 20, min((x >> 20) + (x & 1048575), len(raw))
        if a > upto:
            spans += 1
        a = max(a, at)
        if b > a:
            kept.append(raw[at:a])
            removed += b - a
            at = b
        upto = max(upto, b)
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def _removed(decode: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = [remove((t or "").encode(), r or []) for t, r in zip(texts, batch.column("runs").to_pylist())]
            left = [None if t is None else g[0].decode(errors="ignore") if g[1] else t for t, g in zip(texts, got)] if decode else [g[0] for g in got]
            cols = [batch.column("row"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array(left, pa.string() if decode else pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def cut_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, decode: bool = False) -> DataFrame:
    """row (a struct of all columns of ``docs``, whatever their names), n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay).

    Texts are UTF-8 bytes, judged as they come in; matches never cross documents. Earlier means a smaller id, or in
    one document a smaller start. With ``decode`` kept is a text, without bytes that are no character any more, null for a null text.
    Null texts are empty. A row with a null id is left as it is and covers nothing. Rows with the same id and text are one
    document, and each keeps what it keeps; different texts of one id are documents of their own, in the order of their MD5 digests.
    An empty table gives no rows. Ties are settled by document and start. A text of any length is read whole:
    the memory of its task is about a hundred times the text.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told, repeated = _told_apart(rows)
    runs = covered(told, length).groupBy("doc_id", "which").agg(F.collect_list(F.shiftleft("start", 20) + F.col("size")).alias("runs"))
    if not repeated:
        rows = rows.join(runs.select("doc_id", "runs"), "doc_id", "left")
    else:  # covers of one text are not those of another with its id
        of = told.select("doc_id", "which", F.md5("text").alias("digest")).distinct().join(runs, ["doc_id", "which"]).select("doc_id", "digest", "runs")
        rows = rows.withColumn("digest", F.md5("text")).join(of, ["doc_id", "digest"], "left")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.StringType() if decode else T.BinaryType())])
    return rows.select("row", "text", "runs").mapInArrow(_removed(decode), schema)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, decode: bool = False) -> DataFrame:
    """``docs`` with _n_bytes, _n_removed, _n_spans and _kept, or with ``decode`` _new in its place: ``cut_rows`` in flat columns.

    A column of ``docs`` with one of these five names is replaced; any other name does no harm.
    """
    given = {"_n_bytes": "n_bytes", "_n_removed": "n_removed", "_n_spans": "n_spans", "_new" if decode else "_kept": "kept"}
    cut = cut_rows(docs, id_col, text_col, length, decode)
    return cut.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in {*given, "_kept", "_new"}], *[F.col(c).alias(n) for n, c in given.items()])

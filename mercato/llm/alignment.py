"""How the tokens of two vocabularies lie on each other: groups, links between them and how usual each link is.

Both vocabularies cut the same bytes. Where both end a token, a group ends; within a group no cut is common, so its links follow from its
ids alone. Texts are aligned a slice at a time: what leaves a slice is one row for each distinct group with its frequency
there (the slice's dictionary) and, for each document, places in that dictionary. Dictionaries are interned over the whole corpus by group key,
links are expanded once for each distinct group and weighed by frequency, and what the links of a group come to is joined back by
key to the slices' dictionaries and from there to their documents. A group that is everywhere is one row for each slice.
"""

from __future__ import annotations

import hashlib
import json
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .chunked_tokens import ChunkEncoder, gather, slices
from .lexicon import byte_symbols
from .score_pieces import PieceEncoder

_DOCS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, slice long, places array<int>, times array<int>, key long, a array<int>, b array<int>, n long, is_doc boolean"


class Aligner:
    """Two encoders, and the bytes of their ids."""

    def __init__(self, byte_path: str, piece_path: str, most: int = 250_000):
        self.left, self.right = ChunkEncoder(byte_path, most), PieceEncoder(piece_path, most)
        self.left.library.encode_special_tokens = True  # their strings in a text are plain text
        self.left.specials = []
        back = byte_symbols()
        raw = {i: bytes(back[c] for c in t) for t, i in json.loads(Path(byte_path).read_text())["model"]["vocab"].items() if all(c in back for c in t)}
        raw = [raw.get(i, b"") for i in range(len(self.left.bytes_of))]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array):
        """Flat ids of both sides and where each text's begin; a text whose tokens do not give back a space and itself has none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        sides = []
        ok = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        want = spaced.cast(pa.large_binary()).to_pylist()
        for enc, of, raw, begin, size in ((self.left, spaced, self.raw, self.at, self.size), (self.right, texts, self.right.vocabulary.raw, self.right.vocabulary.at, self.right.vocabulary.bytes_of)):
            flat, at = enc.encode_flat(of)
            sizes = size[flat]
            data, ends = gather(raw, begin[flat], sizes).tobytes(), np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
            ok &= np.fromiter((data[a:b] == w for a, b, w in zip(ends, ends[1:], want)), bool, len(want))
            sides.append((flat, at, sizes))
        out = []
        for flat, at, sizes in sides:
            if not ok.all():
                keep = np.repeat(ok, np.diff(at))
                at = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(at), 0))])
                flat, sizes = flat[keep], sizes[keep]
            out.append((flat, at, np.cumsum(sizes)))
        return out


_RNG = np.random.default_rng(4242)
_AT_ONCE = 1 << 16  # groups
_SIDE = _RNG.integers(1, 2**63, 2, dtype=np.uint64)


def _hashes(flat: np.ndarray, first: np.ndarray, size: np.ndarray, side: int, seed: int) -> np.ndarray:
    """Of each run a sum of hashes of its ids and their places."""
    out = np.empty(len(first), np.uint64)
    for a in range(0, len(first), _AT_ONCE):
        runs, sizes = first[a : a + _AT_ONCE], size[a : a + _AT_ONCE]
        low, high = int(runs[0]), int(runs[-1] + sizes[-1])
        place = np.arange(low, high) - np.repeat(runs, sizes)
        x = common.mix64((flat[low:high].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)) ^ _SIDE[side] ^ np.uint64(seed))
        out[a : a + _AT_ONCE] = np.add.reduceat(x, runs - low)
    return out


def aligned(a: tuple, b: tuple, seed: int = 0):
    """Groups of two sides (ids, ends of tokens in bytes): first token and number of tokens on each side, and a key of the ids."""
    (ids_a, ends_a), (ids_b, ends_b) = a, b
    total = int(ends_a[-1]) if len(ends_a) else 0
    ended = np.zeros(total + 1, bool)
    ended[ends_b] = True
    last_a = np.flatnonzero(ended[ends_a])
    common_ends = np.zeros(total + 1, bool)
    common_ends[ends_a[last_a]] = True
    last_b = np.flatnonzero(common_ends[ends_b])
    del ended, common_ends
    sides = []
    for last in (last_a, last_b):
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        sides.append((first, last - first + 1))
    (first_a, size_a), (first_b, size_b) = sides
    key = common.mix64(_hashes(ids_a, first_a, size_a, 0, seed) + _hashes(ids_b, first_b, size_b, 1, seed) * np.uint64(3)).view(np.int64)
    return first_a, size_a, first_b, size_b, key


def _lists(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(gather(flat, first, size).astype(np.int32)))


def _spelled(ids: pa.Array) -> list[str]:
    joined = pc.binary_join(ids.cast(pa.list_(pa.string())), ",")
    return joined.to_pylist()


def _sliced(aligner: Aligner, part: pa.RecordBatch, number: int, seed: int) -> tuple[dict, dict]:
    """Columns of a slice's documents and of its dictionary. Arrays over its tokens are dropped as soon as they are used."""
    m = part.num_rows
    (ids_a, at_a, ends_a), (ids_b, at_b, ends_b) = aligner.encode(part.column(1))
    common.release()
    first_a, size_a, first_b, size_b, key = aligned((ids_a, ends_a), (ids_b, ends_b), seed)
    del ends_a, ends_b
    of_doc = np.searchsorted(first_a, at_a)  # a document's groups begin where its tokens do
    keys, where, place, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    del key
    left, right = _lists(ids_a, first_a[where], size_a[where]), _lists(ids_b, first_b[where], size_b[where])
    del ids_a, ids_b, first_a, size_a, first_b, size_b, where
    spelled = [f"{x}|{y}" for x, y in zip(_spelled(left), _spelled(right))]
    shas = [hashlib.sha256(";".join([spelled[p] for p in place[a:b].tolist()]).encode()).hexdigest() if b > a else "" for a, b in zip(of_doc.tolist(), of_doc[1:].tolist())]
    del spelled
    both, times = np.unique(np.repeat(np.arange(m), np.diff(of_doc)) << 32 | place, return_counts=True)
    bounds = pa.array(np.searchsorted(both, np.arange(m + 1) << 32).astype(np.int32))
    places, times = (pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (both & 0xFFFFFFFF, times))
    docs = dict(doc_id=part.column(0), n_a=pa.array(np.diff(at_a)), n_b=pa.array(np.diff(at_b)), n_groups=pa.array(np.diff(of_doc)), groups_sha256=pa.array(shas), places=places, times=times)
    groups = dict(key=pa.array(keys), a=left, b=right, n=pa.array(n))
    return tuple(x | dict(slice=pa.array(np.full(k, number)), is_doc=pa.array(np.full(k, d))) for x, k, d in ((docs, m, True), (groups, len(keys), False)))


def _align(run_id: str, paths: tuple[str, str], seed: int):
    def run(batches):
        common.only(run_id)
        aligner = common.held("aligner", paths, lambda: Aligner(*paths))
        names = [f.split()[0] for f in _DOCS.split(", ")]
        numbers = count(TaskContext.get().partitionId() << 32)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.bool_())

        def rows(rows_of: int, **given):
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows_of, t) for c, t in zip(names, types)], names=names)

        # What is made of a slice goes with its call: between slices a worker holds only what the encoders know.
        for part in slices(batches, most_bytes=4 << 20):
            for given in _sliced(aligner, part, next(numbers), seed):
                yield rows(len(given["slice"]), **given)
            del given
            common.release()

    return run


_LINKS = "key long, a int, b int, m long, n long"


def overlaps(sizes_a: list[int], sizes_b: list[int]) -> list[tuple[int, int]]:
    """Places of the tokens of two sides whose byte ranges overlap; both sides have the same bytes."""
    out, i, j, x, y = [], 0, 0, 0, 0
    while i < len(sizes_a) and j < len(sizes_b):
        out.append((i, j))
        end_a, end_b = x + sizes_a[i], y + sizes_b[j]
        if end_a <= end_b:
            i, x = i + 1, end_a
        if end_b <= end_a:
            j, y = j + 1, end_b
    return out


def _expand(run_id: str, paths: tuple[str, str]):
    """The links of each distinct group: id pairs and how often the group has them."""

    def run(batches):
        common.only(run_id)
        aligner = common.held("aligner", paths, lambda: Aligner(*paths))
        size_a, size_b = aligner.size, aligner.right.vocabulary.bytes_of
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for key, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "n"))):
                if len(a) == 1 or len(b) == 1:
                    pairs = [(x, y) for x in a for y in b]
                else:
                    pairs = [(a[i], b[j]) for i, j in overlaps(size_a[a].tolist(), size_b[b].tolist())]
                found: dict[tuple[int, int], int] = {}
                for p in pairs:
                    found[p] = found.get(p, 0) + 1
                for (x, y), m in found.items():
                    for column, v in zip(out, (key, x, y, m, n)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "a", "b", "m", "n"])

    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sum_up(docs: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one slice: its documents, and what each group of its dictionary comes to."""
    order = np.argsort(groups.column("key").to_numpy())
    best, total = (groups.column(c).to_numpy()[order] for c in ("best", "total"))
    docs = docs.combine_chunks()
    n = docs.num_rows
    sums = []
    where = docs.column("places").combine_chunks()
    place, times = where.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(where).to_numpy())])
    for each in (best, total):
        upto = np.concatenate([[0], np.cumsum(each[place] * times)])
        sums.append(pa.array(upto[bounds[1:]] - upto[bounds[:-1]], pa.int64()))
    links = pc.subtract(pc.add(docs.column("n_a"), docs.column("n_b")), docs.column("n_groups"))
    cols = [docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), docs.column("n_groups"), links, *sums, docs.column("groups_sha256")]
    return pa.table(cols, names=[f.split()[0] for f in _OUT.split(", ")]) if n else pa.table([pa.array([], c.type) for c in cols], names=[f.split()[0] for f in _OUT.split(", ")])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs``.

    A is the byte-level vocabulary over a space and the text, B the piece vocabulary over the text. A null or empty text and one whose tokens
    do not give back a space and the text (it has U+2581) has no tokens: zeros and ''. A pair's count is over all rows,
    repeated ones too. n_best counts links whose count is the highest of their B id; ties are all best. Rows with a null id count like others.
    An empty table gives no rows; further columns are left out. A text of any length is read whole, in a slice of its own.
    """
    spark = docs.sparkSession
    common.ship(spark)
    paths = (byte_path or common.tokenizer_path(), piece_path or common.tokenizer_path("piece_bpe_32k.model"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for seed in count():
        run_id = common.new_run()
        path = common.new_path(spark, "aligned")
        narrow.mapInArrow(_align(run_id, paths, seed), _DOCS).write.parquet(path)
        rows = spark.read.schema(_DOCS).parquet(path)
        entries = rows.where("not is_doc").select("slice", "key", "a", "b", "n")
        # Equal keys of different ids would mix two groups; then all keys are made anew.
        ids = F.struct("a", "b")
        groups = common.table(entries.groupBy("key").agg(F.min(ids).alias("x"), F.max(ids).alias("y"), F.sum("n").alias("n")), "groups")
        if groups.where("x <> y").isEmpty():
            break
        common.drop_table(spark, path)
    links = common.table(groups.select("key", "x.a", "x.b", "n").mapInArrow(_expand(run_id, paths), _LINKS), "links")
    pairs = links.groupBy("a", "b").agg(F.sum(F.col("m") * F.col("n")).alias("count"))
    pairs = pairs.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).cast("long"))
    worth = links.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum(F.col("m") * F.col("best")).alias("best"), F.sum(F.col("m") * F.col("count")).alias("total"))
    said = entries.select(F.col("slice").alias("of"), "key").join(worth, "key")
    mine = rows.where("is_doc").select("slice", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "places", "times")
    return mine.groupBy("slice").cogroup(said.groupBy("of")).applyInArrow(_sum_up, _OUT)

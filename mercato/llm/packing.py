"""Best-fit packing in a hierarchy: partitions pack what they hold, residual bins are packed again as items.

Round 0 cuts documents into pieces of at most ``capacity`` tokens and best-fits the pieces of
one input partition. Bins that are nearly full are final. The rest become items of the next round,
on a fraction of the partitions, until few enough are left for one last task or a round stops paying.
No task holds more than the narrow piece records of its own partition or ``round_items`` bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunked_tokens import encoded

PIECE = np.dtype([("doc_id", "<i8"), ("has_id", "<i4"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
_BINS = "bin_id long, fill int, closed boolean, members binary"
_ARROW = pa.schema([("bin_id", pa.int64()), ("fill", pa.int32()), ("closed", pa.bool_()), ("members", pa.binary())])


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items in each bin. Ties go to the item given first, the bin opened last."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order:
        n = lengths[i]
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _pack(fills: list[int], member, capacity: int, slack: int, round_no: int, last: bool):
    """Rows of ``_BINS`` for items with these fills; ``member(i)`` is the content of item i."""
    from pyspark import TaskContext

    base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
    rows = []
    for k, items in enumerate(best_fit(fills, capacity)):
        fill = sum(fills[i] for i in items)
        rows.append((base + k, fill, last or capacity - fill <= slack, b"".join(map(member, items))))
        if len(rows) == 4096:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _first_round(run_id: str, path: str, end_id: int | None, capacity: int, slack: int):
    def run(batches):
        common.only(run_id)
        parts, rows = [], []
        for doc_id, ids in encoded(batches, path, end_id):
            a, piece, n = 0, 0, len(ids)
            while a < n:
                b = min(n, a + ((n - a) % capacity or capacity))
                rows.append((doc_id or 0, doc_id is not None, piece, a, b - a, zlib.crc32(ids[a:b])))
                a, piece = b, piece + 1
            if len(rows) > 4096:
                parts.append(np.array(rows, PIECE))
                rows = []
        pieces = np.concatenate([*parts, np.array(rows, PIECE)])
        pieces = pieces[np.argsort(-pieces["length"], kind="stable")]
        lengths, raw, size = pieces["length"].tolist(), pieces.tobytes(), PIECE.itemsize
        del parts, pieces
        yield from _pack(lengths, lambda i: raw[size * i : size * i + size], capacity, slack, 0, False)

    return run


def _next_round(run_id: str, capacity: int, slack: int, round_no: int, last: bool):
    def run(batches):
        common.only(run_id)
        items = sorted((f, i, m) for b in batches for i, f, m in zip(*(b.column(c).to_pylist() for c in ("bin_id", "fill", "members"))))
        items.reverse()
        yield from _pack([x[0] for x in items], lambda i: items[i][2], capacity, slack, round_no, last)

    return run


_OUT = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset int"


def _spread(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        blobs = batch.column("members").to_pylist()
        x = np.frombuffer(b"".join(blobs), PIECE)
        per = np.array([len(b) // PIECE.itemsize for b in blobs])
        ends = np.cumsum(x["length"], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        before = (ends - x["length"])[first]
        cols = [
            pa.array(x["doc_id"], mask=x["has_id"] == 0), pa.array(x["piece"]), pa.array(x["start"]), pa.array(x["length"]),
            pa.array(x["crc"].astype(np.int64)), pa.array(np.repeat(batch.column("bin_id").to_numpy(), per)),
            pa.array((ends - x["length"] - np.repeat(before, per)).astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int | None = 0,
    tokenizer: str | None = None, slack: int = 8, round_items: int = 40_000,
) -> DataFrame:
    """Pack every document's ids, with ``end_id`` appended, into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer
    than ``capacity`` are cut; their first piece takes the remainder. A null text is empty and still has its
    end id; with ``end_id=None`` an empty document has no piece. A null id stays null and repeated rows are packed
    as often as they come. An empty table gives no rows. Other columns are not read. A text of any length is encoded whole, in its task's
    memory; pieces of equal length are interchangeable, so ties are settled by nothing that a reader could see but sequence_id.
    """
    spark = docs.sparkSession
    common.ship(spark)
    path = tokenizer or common.tokenizer_path()
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run_id = common.new_run()
    at = common.write_table(narrow.mapInArrow(_first_round(run_id, path, end_id, capacity, slack), _BINS), "pack")
    bins = spark.read.schema(_BINS).parquet(at)
    done = [bins.filter("closed")]
    left, round_no, before = bins.filter("not closed"), 0, None
    while n := left.count():
        round_no += 1
        last = n <= round_items or (before is not None and n > 0.9 * before)
        parts = max(1, -(-n // round_items))
        again = left.select("bin_id", "fill", "members").repartition(parts, F.xxhash64("bin_id"))
        at = common.write_table(again.mapInArrow(_next_round(run_id, capacity, slack, round_no, last), _BINS), "pack")
        bins = spark.read.schema(_BINS).parquet(at)
        done.append(bins.filter("closed"))
        left, before = bins.filter("not closed"), n
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("bin_id", "members").mapInArrow(_spread, _OUT)

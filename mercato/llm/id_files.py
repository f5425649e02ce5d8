"""Token ids of a corpus in files of ``mixing_blocks`` (or, of earlier versions, ``id_coder``) blocks, in ascending order of document.

File: blocks of ``BLOCK`` ids (the last is shorter), then a footer with the documents' ids and lengths, zlib-packed with its crc32, then
``TAIL`` (place and size of the footer, magic). A file is one range of documents; the files' order is that of their ranges.
Files go to the shared folder through pyarrow's file systems, under a name of the task attempt, and only
attempts that Spark reports count, so a repeated task leaves an unused file at worst.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixing_blocks
from .chunked_tokens import encoded
from .id_coder import HEAD, CorruptBlock, decode_block

BLOCK = 1 << 20
TAIL = struct.Struct("<QII4s")
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "<u4"), ("n", "<u4")])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_file(out, documents, vocab: int) -> tuple[int, int]:
    """Write (doc_id, ids as little-endian uint32) pairs; returns documents and ids written."""
    held, size, docs, total, at = [], 0, [], 0, 0

    def flush(least: int) -> None:
        nonlocal held, size, at
        if size < least or not size:
            return
        ids = np.concatenate(held)
        full = len(ids) if least == 1 else len(ids) - len(ids) % BLOCK
        for a in range(0, full, BLOCK):
            at += out.write(mixing_blocks.encode(ids[a : min(a + BLOCK, full)], vocab))
        held, size = [ids[full:]], len(ids) - full

    for doc_id, ids in documents:
        n = len(ids)
        docs.append((doc_id or 0, doc_id is not None, n))
        held.append(ids)
        size, total = size + n, total + n
        flush(BLOCK)
    flush(1)
    footer = zlib.compress(np.array(docs, _DOC).tobytes(), 1)
    out.write(footer)
    out.write(TAIL.pack(at, len(footer), zlib.crc32(footer), b"CMRF"))
    return len(docs), total


def read_file(source):
    """(doc_id, ids) of a file, a block in memory at a time."""
    size = source.size()
    source.seek(size - TAIL.size)
    at, n, crc, magic = TAIL.unpack(source.read(TAIL.size))
    source.seek(at)
    footer = source.read(n)
    if magic != b"CMRF" or zlib.crc32(footer) != crc:
        raise CorruptBlock("the file's footer does not fit")
    source.seek(0)
    rest = np.empty(0, "<u4")
    for doc_id, has_id, n in np.frombuffer(zlib.decompress(footer), _DOC).tolist():
        parts, have = [rest], len(rest)
        while have < n:
            head = source.read(HEAD.size)
            block = head + source.read(HEAD.unpack(head)[4])
            parts.append(mixing_blocks.decode(block) if head.startswith(mixing_blocks.MAGIC) else decode_block(block))
            have += len(parts[-1])
        ids = np.concatenate(parts) if len(parts) > 1 else rest
        rest = ids[n:]
        yield doc_id if has_id else None, ids[:n]


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, tokenizer: str | None = None, vocab: int = 50_257, files: int | None = None) -> list[tuple]:
    """Encode all texts, ``end_id`` after each, into files; returns (path, documents, ids) in ascending order of document.

    Null texts are empty, null ids come first, equal ids are in the order of a hash of their texts, then of the texts. An empty table gives files without documents or none.
    Repeated rows are written as often as they come; other columns are not read. A text of any length is encoded whole, in its task's memory.
    """
    spark = docs.sparkSession
    common.ship(spark)
    path = tokenizer or common.tokenizer_path()
    folder = f"{common.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Spark samples the range's keys on the driver: a hash of the text parts equal ids, never the text itself.
    ordered = narrow.repartitionByRange(*([files] if files else []), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    run_id = common.new_run()

    def run(batches):
        from pyspark import TaskContext

        common.only(run_id)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        store, at = _open(name)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as out:
            n, total = write_file(out, encoded(batches, path, end_id), vocab)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([n]), pa.array([total])], names=["part", "path", "documents", "ids"])

    written = ordered.mapInArrow(run, "part long, path string, documents long, ids long").collect()
    return [tuple(r)[1:] for r in sorted(written)]


def read_ids(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) from files in their order."""
    rows, base = [], 0
    for path, _, ids in files:
        rows.append((path, base))
        base += ids

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = _open(path)
                out = []

                def rows():
                    cols = list(zip(*out)) or [[]] * 4
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

                with store.open_input_file(at) as source:
                    for doc_id, ids in read_file(source):
                        out.append((doc_id, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        if len(out) == 1024:
                            yield rows()
                            out = []
                yield rows()

    paths = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

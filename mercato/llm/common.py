"""What the training-data operators share: shared-folder tables, shipping, worker memory, word splitting."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import drop_table, new_path, shared_dir, table, write_table  # noqa: F401
from ..sources.shipping import ship  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_HELD: dict[str, tuple[object, object]] = {}


def held(kind: str, key, make):
    """One object of a kind in a worker process, made anew when the key is another."""
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD[kind] = (key, make())
    return _HELD[kind][1]


def only(run: str) -> None:
    """A worker process goes from one operator to the next: what it holds of an earlier run goes when ``run`` begins."""
    if _HELD.get("run", (None,))[0] != run:
        _HELD.clear()
        _HELD["run"] = (run, None)
        release()


def release() -> None:
    """Give memory that is free in this process back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_run() -> str:
    return uuid.uuid4().hex


#: ASCII letters are folded by Arrow's ascii_lower, which leaves other letters alone.
def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: a flat array and, per text, the offset of its first word.

    Null and empty texts have no words.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    starts -= starts[0] if len(starts) else 0
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, starts = flat.filter(pa.array(full)), before[starts]
    return flat, starts


_SEED = np.random.default_rng(20240229)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word of the batch is hashed once."""
    import xxhash

    if not len(flat):
        return np.empty(0, np.uint64)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)]


_SHINGLE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``n``-word shingles, A-Z folded.

    A text with fewer words has its whole word sequence as one shingle; one without words has none.
    """
    flat, starts = words_of(texts, lower=True)
    h = word_hashes(flat)
    m = max(0, len(h) - n + 1)
    full = np.full(m, np.uint64(n))
    for j in range(n):
        full += h[j : j + m] * _SHINGLE[j]
    full = mix64(full)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            x = np.uint64((b - a) + int((h[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix64(np.array([x], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Alignment of two vocabularies against all pairs of overlapping tokens, by the libraries' own ids."""

import hashlib
import random
import weakref
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from mercato.llm import alignment, chunked_tokens, common
from mercato.llm.lexicon import byte_symbols
from mercato.llm.op_queries import QUERIES

RND = random.Random(8)
ODD = ["", None, " ", "  a", "a ", "x▁y", "▁", "\x00a", "<0x41>", "<|endoftext|> </s> <unk>", "🙂 x é漢", "\n\n x\n", " \n ", "x. y, (z) a--b -c", "a" * 300, " " * 70 + "x", "the end", "the end", "漢字かな交じり文 ﬁ Å", "🏳️‍🌈🇩🇪 é"]
TEXTS = ODD + ["".join(RND.choice(["the ", "ing", "tion", " ", "é", "X", "\n", "12", ". ", "schön ", "漢"]) for _ in range(RND.randint(1, 60))) for _ in range(80)]


def by_hand(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(common.tokenizer_path())
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    back = byte_symbols()

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], defaultdict(int)
    for t in texts:
        t = t or ""
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        raw_a, raw_b = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        want = (" " + t).encode()
        if not t or b"".join(raw_a) != want or b"".join(raw_b) != want:
            docs.append(([], [], [], ""))
            continue

        def ranges(ids, raws):
            at, out = 0, []
            for i, r in zip(ids, raws):
                out.append((i, at, at + len(r)))
                at += len(r)
            return out

        ra, rb = ranges(ids_a, raw_a), ranges(ids_b, raw_b)
        links = [(x[0], y[0]) for x in ra for y in rb if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in ra} & {y[2] for y in rb})
        groups = [",".join(str(i) for i, s, e in ra if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in rb if lo <= s and e <= hi) for lo, hi in zip([0, *ends], ends)]
        for p in links:
            counts[p] += 1
        docs.append((ids_a, ids_b, links, hashlib.sha256(";".join(groups).encode()).hexdigest(), len(groups)))
    high = defaultdict(int)
    for (_, y), n in counts.items():
        high[y] = max(high[y], n)
    return [(len(d[0]), len(d[1]), d[4] if d[0] else 0, len(d[2]), sum(counts[p] == high[p[1]] for p in d[2]), sum(counts[p] for p in d[2]), d[3]) for d in docs]


def test_query(spark, tmp_path):
    rows = list(enumerate(TEXTS)) + [(3, "again"), (3, "again"), (None, "no id"), (999, "lorem ipsum, dolor. " * 30_000)]
    spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, slice int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    few = [r for r in rows if r[0] != 999]
    got = QUERIES["op13_token_alignment"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    long = [r for r in got if r.doc_id == 999][0]
    assert long.n_links == long.n_a + long.n_b - long.n_groups > 100_000
    docs = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(docs).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(few, by_hand([t for _, t in few])))


def test_clashing_keys_are_made_anew(spark, monkeypatch):
    seeds = []

    def clashing(run_id, paths, seed, make=alignment._align):
        seeds.append(seed)
        run = make(run_id, paths, seed)
        if seed:
            return run

        def one_key(batches):
            for b in run(batches):
                at = b.schema.get_field_index("key")
                yield b.set_column(at, "key", pc.multiply(b.column(at), 0))

        return one_key

    monkeypatch.setattr(alignment, "_align", clashing)
    rows = [(1, "a b the ing"), (2, "schön, x")]
    got = sorted(tuple(r) for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert seeds == [0, 1]
    assert got == [(i, *x) for (i, _), x in zip(rows, by_hand([t for _, t in rows]))]


@pytest.mark.parametrize("a, b, want", [([3, 2], [1, 4], [(0, 0), (0, 1), (1, 1)]), ([5], [1, 1, 3], [(0, 0), (0, 1), (0, 2)]), ([1, 3, 1], [2, 3], [(0, 0), (1, 0), (1, 1), (2, 1)])])
def test_overlaps(a, b, want):
    assert alignment.overlaps(a, b) == want


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in one) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_worker_lets_go_of_each_slice(monkeypatch):
    """While a slice is encoded nothing is held of the one before, nor while its rows are handed over."""
    held = []

    class Watched(alignment.Aligner):
        def encode(self, texts):
            assert not [r for r in held if r() is not None]
            out = super().encode(texts)
            held[:] = [weakref.ref(x) for side in out for x in side]
            return out

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(alignment, "Aligner", Watched)
    monkeypatch.setattr(alignment, "TaskContext", Task)
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["doc_id", "text"]) for i, t in enumerate(["the end of it", "a b the ing", "schön, x"])]
    run = alignment._align("slices", (common.tokenizer_path(), common.tokenizer_path("piece_bpe_32k.model")), 0)
    seen = 0
    for out in run(iter(batches)):
        seen += out.num_rows
        assert not [r for r in held if r() is not None]
    assert seen > 6
    common.only("")


def test_gather_in_portions(monkeypatch):
    monkeypatch.setattr(chunked_tokens, "_PLACES", 3)
    rng = np.random.default_rng(3)
    values = rng.integers(0, 99, 50)
    for n in (0, 1, 40):
        starts, sizes = rng.integers(0, 40, n), rng.integers(0, 8, n)
        want = [x for a, k in zip(starts, sizes) for x in values[a : a + k]]
        assert chunked_tokens.gather(values, starts, sizes).tolist() == want


def test_hashes_in_portions(monkeypatch):
    flat, size = np.arange(100, 130), np.array([1, 3, 2, 4, 1, 9, 10])
    first = np.cumsum(size) - size
    whole = alignment._hashes(flat, first, size, 1, 5)
    monkeypatch.setattr(alignment, "_AT_ONCE", 2)
    assert alignment._hashes(flat, first, size, 1, 5).tolist() == whole.tolist()
    assert len(alignment._hashes(flat[:0], first[:0], size[:0], 0, 0)) == 0

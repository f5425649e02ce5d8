"""Ids of merge-type vocabularies against the sentencepiece library: whole texts, odd white space, unknown characters, long parts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from mercato.llm import common
from mercato.llm.op_queries import QUERIES
from mercato.llm.score_pieces import PieceEncoder, encode_decode

PATH = common.tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a", "a ", "▁a", "\x00a", "<0x41>", "</s> <unk>", "🙂 x", "\n\n x\n", "a\n b", " \n ", "\t\tx", "▁▁ ▁x", "x. y, (z) a--b -c", "漢字かな", "ﬁ Å é", "a\rb", "a" * 700, " " * 70 + "x", "x" * 3000 + "é" * 40]


def drawn(n, alphabet, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def enc():
    return PieceEncoder(PATH)


@pytest.mark.parametrize("alphabet", ["ab \n▁é漢\x00<s>0😀.,-", "ab \né漢<s>0😀.,-", "the ing. on"])
def test_ids_and_text_are_the_library_s(enc, alphabet):
    rows = ODD + drawn(2000, alphabet, 3)
    flat, at = enc.encode_flat(pa.array(rows, pa.string()))
    want = enc.vocabulary.library.encode([t or "" for t in rows])
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert enc.decode_flat(flat, at) == enc.vocabulary.library.decode(want)


def test_one_part_by_the_heap_and_many_by_rounds_agree(enc):
    v = enc.vocabulary
    parts = ["▁" + w for w in drawn(500, "abcdefghinorst", 5) if w] + ["▁▁▁▁▁", "é漢x", "▁" + "ab" * 40]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.segment_many(parts)] == [v.segment(p) for p in parts] == v.by_library(parts)


def test_ids_that_no_text_has_decode_as_in_the_library(enc):
    rows = [[0, 5], [200, 201], [3], [259, 259], []]
    flat = np.array([i for r in rows for i in r], "<u4")
    assert enc.decode_flat(flat, np.cumsum([0, *map(len, rows)])) == [enc.vocabulary.library.decode(r) for r in rows]


def test_what_is_forgotten_and_learnt_again_is_the_same():
    enc = PieceEncoder(PATH, most=3)
    rows = pa.array(drawn(300, "ab cd. e\n", 9))
    first, second = enc.encode_flat(rows), enc.encode_flat(rows)
    assert (first[0] == second[0]).all() and (first[1] == second[1]).all()


def test_query(spark, enc, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "twice"), (1, "twice"), (None, "no id"), (99, "lorem ipsum. " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, decoded long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_agenda_pieces"](spark, str(tmp_path)).collect())
    lib, sha = enc.vocabulary.library, lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_eos=True)
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert got == sorted(want)


def test_empty_table_and_no_end(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(docs).collect() == []
    one = encode_decode(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), end=False).collect()
    assert {r.doc_id: (list(r.ids), r.decoded) for r in one} == {1: (PieceEncoder(PATH).vocabulary.library.encode("a b"), "a b"), 2: ([], "")}

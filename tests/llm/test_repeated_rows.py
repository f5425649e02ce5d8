"""Suffix dedup where ids come again, and where the caller's columns have the helpers' names; a lexicon whose counts are all equal."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from mercato.llm.lexicon import frequent_pieces
from mercato.llm.suffix_dedup import cut_rows, deduplicate

RND = random.Random(12)
SAY = lambda n: "".join(RND.choice("abcdefghij klmno") for _ in range(n))
T, U, V = SAY(600), SAY(500), SAY(300)
#: equal rows; a text that begins with another document's; two texts of one id that share a passage; a passage twice in one text
CASES = [
    [(1, T), (1, T), (2, U)],
    [(0, T[:150]), (1, T), (1, U)],
    [(1, T + V), (1, U + V), (2, V), (2, V)],
    [(3, V + U + V), (3, V + U + V), (3, U), (4, SAY(200) + V[:160])],
    [(5, None), (5, T), (None, T), (6, ""), (6, T[100:400]), (6, T[100:400])],
]


def by_hand(rows, length=100):
    """Equal rows are one document; different texts of one id come in the order of their digests."""
    seen, left = set(), {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda r: (r[0], hashlib.md5(r[1].encode()).hexdigest())):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            if w in seen:
                gone[a : a + length] = True
            seen.add(w)
        left[d, t] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return sorted((str(d), left.get((d, t), (t or "").encode())) for d, t in rows)


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_ids_that_come_again(spark, case, parts):
    rows = CASES[case]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted((str(r.row.doc_id), bytes(r.kept)) for r in cut_rows(docs).collect()) == by_hand(rows)


NAMES = ("_runs", "_kept", "_new", "_n_bytes", "row", "which", "kept", "runs", "digest", "_of")


def test_the_stage_keeps_equal_rows_and_any_names(spark):
    rows = [(1, T), (1, T), (2, U + T[50:350]), (3, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in NAMES)
    docs = spark.createDataFrame([(i, t, "l", "s", 0, *NAMES) for i, t in rows], columns).repartition(2)
    out = corpus_pipeline.suffix_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in out.collect())
    assert got == [(1, T, 600), (1, T, 600), (2, U, 500), (3, "", None)]
    assert all(tuple(r[n] for n in NAMES) == NAMES for r in out.collect())
    flat = deduplicate(docs).first()
    assert (flat._runs, flat.digest, flat.row) == ("_runs", "digest", "row") and isinstance(flat._n_bytes, int)


@pytest.mark.parametrize("most", [0, 700, 1500, 5000])
def test_lexicon_of_equal_counts_is_filled_up(spark, most):
    words = [f"w{i:x}" for i in range(1000)]
    docs = spark.createDataFrame([(i, " ".join(["", *words, "often"] if i < 3 else ["", *words])) for i in range(6)], "doc_id long, text string").repartition(3)
    got = frequent_pieces(docs, "text", most, [])
    assert len(got) == len(set(got)) == min(most, len(frequent_pieces(docs, "text", 10_000, [])))
    assert got == frequent_pieces(docs.repartition(2), "text", most, [])

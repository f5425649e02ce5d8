"""The filter audit against applying every order to every document."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from mercato.llm.interactions import audit, failure_counts
from mercato.llm.op_queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (0, LONG, "a"), (1, LONG, "a"), (2, LONG, "b"), (3, LONG, None), (3, LONG, "a"), (4, None, "a"), (5, "", "b"), (6, " \t\x0b\n ", "b"), (7, LONG.upper(), "a"), (8, LONG + " #", None), (9, "same " * 80, "a"),
    (10, "same " * 80, "b"), (11, "É" * 3, "c"), (12, "A" + "é" * 19, "c"), (13, "A" + "é" * 18, "c"), (14, LONG + "\x0b" + LONG, "a"), (None, LONG, "a"), (None, "few", "a"), (15, "few", "c"), (0, LONG, "a"), (16, "x y|z " * 40_000, "b"), (17, " ".join("ab" for _ in range(70)), "b"),
]
LABELS = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, 1, 0), (3, 0, 1), (9, 1, 0), (14, None, 1), (77, 1, 1), (None, 1, 1)]


def by_hand(rows, labels):
    said = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            said[i] = [max(said[i][0], int(q == 1)), max(said[i][1], int(t == 1))]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.append((part or "", fails, *(said[i] if i is not None else (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                early = [d for d in mine if d[1][x] and not any(d is y for y in gone)]
                alone = [d for d in mine if d[1][x] and sum(d[1].values()) == 1]
                left = [d for d in left if not d[1][x]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(early), len(alone), sum(d[2] for d in gone), sum(d[3] for d in gone), x]
        for (p, order, step), v in out.items():
            if p == part:
                v[-1] = total[v[-1]]
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("audit")
    docs = [(i, t, s, 0, "n", "digest") for i, t, s in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n int, part string, digest string").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_query_is_all_orders_by_hand(spark, tables):
    want = by_hand(ROWS, LABELS)
    df = QUERIES["op12_filter_interactions"](spark, tables)
    assert got(df) == want and len(want) == 600 * 4
    assert df.count() == 600 * 4


def test_two_filters_and_all_or_nothing_survive(spark):
    rows = [("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 1), ("q", True, True, 5, 5, 5)]
    counts = spark.createDataFrame(rows, "part string, A boolean, B boolean, n long, good long, toxic long")
    out = got(audit(counts, "AB"))
    assert out["p", "AB", 1] == [0, 5, 0, 3, 1, 1, 5 + 3] and out["p", "AB", 2] == [0, 0, 2, 0, 0, 0, 2]
    assert out["p", "BA", 1] == [3, 2, 0, 0, 0, 1, 2] and out["p", "BA", 2] == [0, 3, 2, 3, 1, 0, 8]
    assert out["q", "AB", 2] == [0, 0, 5, 0, 0, 0, 5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(failure_counts(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    assert len(audit(failure_counts(one, labels)).collect()) == 600

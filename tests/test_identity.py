"""Rules as data, names by a ladder, clusters with a tri-state, one-way catalogues, links that move only for a better fit."""

import pytest
from pyspark.sql import functions as F

from mercato.functions.rewrite import RULES, normalise, read_rules, variants
from mercato.operators.clusters import components, ties
from mercato.operators.identity import identity, relink, resolve, upsert_products

LADDER = [("seller", "noise", "short"), ("noise",)]


def rules(spark, rows):
    return read_rules(spark.createDataFrame(rows, RULES))


def names(spark, titles, table, ladder=LADDER, least=3):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    return [tuple(r.n) for r in df.select("i", normalise(F.col("t"), table, ladder, least).alias("n")).orderBy("i").collect()]


def test_another_table_gives_other_names(spark):
    titles = ["Luma 12 Pro sold by Shop", "sold by Luma 12 of Shop", "NEW", None, "70"]
    first = rules(spark, [(1, "seller", "cut", r"sold by.*$", " "), (2, "noise", "replace", r"(?i)\bnew\b", " "), (3, "short", "words", "2", "")])
    assert names(spark, titles, first, least=2) == [("Luma 12", 1), ("sold by", 1), ("NEW", 0), ("", 0), ("70", 1)]
    second = rules(spark, [(2, "noise", "replace", r"(?i)\b(pro|sold|by|of|shop)\b", " ")])
    assert [n for n, _ in names(spark, titles[:2], second)] == ["Luma 12", "Luma 12"]


def test_rungs_are_tried_in_order(spark):
    table = rules(spark, [(1, "seller", "replace", ".*", ""), (2, "noise", "replace", "x+", "")])
    assert names(spark, ["xxabc", "xxx", "ab"], table, [("seller",), ("noise",)]) == [("abc", 2), ("xxx", 0), ("ab", 0)]


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError):
        read_rules(spark.createDataFrame([(i, "s", "cut", "a", "") for i in range(5)], RULES), most=4)


def test_variants(spark):
    df = spark.createDataFrame([("a b  c",), ("",)], "n string")
    assert [r[0] for r in df.select(variants(F.col("n"))).collect()] == [["a b c", "a b", "a"], [""]]


TABLE = [
    (1, "noise", "replace", r"\bsale\b", " "), (10, "s", "sku", r"(?i)\bslate\b", "Slate"), (20, "Slate", "refine", r"(?i)\bslate (m[0-9]+)", "Slate $1"), (30, "s", "accessory", r"(?i)^case\b", "a case"),
    (31, "s", "attached", r"(?i)\bfilm for\b", "a film"), (40, "s", "bucket", r"^[a-z]+$", "series"),
]


def test_identity(spark):
    titles = ["Slate M10 sale", "Slate sale", "case for Slate", "film for slate", "Nova 5 sale", None, "!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", identity(F.col("t"), rules(spark, TABLE), [("noise",)]).alias("x"))
    got = [(r.x.model, r.x.key, r.x.source, r.x.kind, r.x.is_bucket, r.x.conflict) for r in df.orderBy("i").collect()]
    assert got == [
        ("Slate M10", "slatem10", "rule/refined", "device", False, False), ("Slate", "slate", "rule", "device", True, False), (None, None, "rule", "accessory", False, False), ("Slate", "slate", "rule", "accessory", True, True),
        ("Nova 5", "nova5", "name", "device", False, False), ("", None, "name", "device", False, False), ("!!", None, "name", "device", False, False),
    ]


def test_ties_are_linear_and_chains_are_one_cluster(spark):
    evidence = spark.createDataFrame([(i, "hot") for i in range(50)] + [(1, None), (None, "hot"), (3, "hot")], "record long, key string")
    assert ties(evidence).count() == 49
    chain = spark.createDataFrame([(i, f"k{i}") for i in range(60)] + [(i + 1, f"k{i}") for i in range(60)], "record long, key string")
    assert {r.record: r.cluster for r in components(ties(chain)).collect()} == {i: 0 for i in range(1, 61)}
    assert components(ties(chain.where("false"))).collect() == []


def test_resolve(spark):
    records = [(1, "a", None, False), (2, "aaa", "X", False), (3, "aa", None, True), (4, "b", "X", False), (5, "b", "Y", False), (6, "b", None, False), (7, None, "Y", None), (8, "alone", None, False), (9, "cc", None, False), (10, "cc", None, False)]
    evidence = [(1, "k1"), (2, "k1"), (3, "k1"), (4, "k2"), (5, "k2"), (6, "k2"), (7, "k3"), (5, "k3"), (9, "k4"), (10, "k4")]
    got = {r.record: (r.product, r.state, r.survivor) for r in resolve(spark.createDataFrame(records, "record long, name string, authoritative string, verified boolean"), spark.createDataFrame(evidence, "record long, key string")).collect()}
    assert got == {
        1: (1, "sure", 3), 2: (1, "sure", 3), 3: (1, "sure", 3), 4: (4, "conflict", 4), 5: (5, "conflict", 5), 6: (6, "conflict", 6), 7: (5, "conflict", 5), 8: (8, "open", 8), 9: (9, "open", 9), 10: (9, "open", 9),
    }


SHAPE = "brand string, category string, key string, name string, verified boolean, is_bucket boolean"


def test_catalogue_marks_go_one_way(spark):
    have = spark.createDataFrame([("b", "c", "k1", "official", True, False), ("b", "c", "k2", "guess", False, True), ("b", "c", "k3", "guess", False, False)], SHAPE)
    batch = spark.createDataFrame([("b", "c", "k1", "other", True, True), ("b", "c", "k2", "zz", True, False), ("b", "c", "k2", "aa", False, True), ("b", "c", "k3", "xx", False, True), ("b", "c", "k4", "new", False, True), ("b", "c", None, "none", False, False)], SHAPE)
    got = {r.key: (r.name, r.verified, r.is_bucket, r.is_new) for r in upsert_products(have, batch).collect()}
    assert got == {"k1": ("official", True, False, False), "k2": ("zz", True, False, False), "k3": ("guess", False, False, False), "k4": ("new", False, True, True)}
    again = upsert_products(upsert_products(have, batch).select(*have.columns), batch)
    assert again.where("is_new").count() == 0


def test_links_move_only_to_a_better_fit(spark):
    products = spark.createDataFrame([(1, "b", "c", "Nova 5 Pro", "nova5pro", False), (2, "b", "c", "Nova 5 Pro Plus", "nova5proplus", False), (3, "b", "c", "Slate", "slate", True), (4, "b", "c", "Nova 5", "nova5", False)], "product long, brand string, category string, name string, key string, is_bucket boolean")
    links = [(1, "Nova 5 Pro Plus", "nova5proplus", 1), (2, "Nova 5 Pro Plus", "nova5pro", 2), (3, "Nova 5", "nova5", 4), (4, "Nova 9", "nova9", 4), (5, "Slate x", "slate", 4), (6, "any", "nova5", 3), (7, "?", None, 4)]
    df = spark.createDataFrame([(i, "b", "c", t, k, p) for i, t, k, p in links], "link long, brand string, category string, title string, key string, product long")
    got = {r.link: (r.after, r.verdict) for r in relink(df, products, ("pro", "plus")).collect()}
    assert got == {1: (2, "move"), 2: (2, "no_better"), 3: (4, "same"), 4: (4, "missing"), 5: (4, "bucket"), 6: (3, "held"), 7: (4, "unknown")}

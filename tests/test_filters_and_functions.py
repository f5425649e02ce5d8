from datetime import date

import pytest
from pyspark.sql import functions as F

from mercato.functions import price as pr
from mercato.functions import spec as sp
from mercato.functions import text as tx
from mercato.operators import filters as flt
from mercato.operators.state import append_archive, insert_only, protect, upsert_latest
from mercato.plans.series import fold_chain


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


@pytest.mark.parametrize(
    "raw, currency, want",
    [("$ 1.299.990", "CLP", 1299990.0), ("R$ 1.299,90", "BRL", 1299.9), ("$1,299.90", "MXN", 1299.9), ("$12,50", "PEN", 12.5), ("ask", "MXN", None), (None, "MXN", None)],
)
def test_parse_price(spark, raw, currency, want):
    assert one(spark, p=pr.parse_price(F.lit(raw).cast("string"), F.lit(currency)))["p"] == want


def test_discount_is_null_when_unknown_and_zero_when_none(spark):
    d = lambda a, b: one(spark, d=pr.discount(F.lit(a).cast("double"), F.lit(b).cast("double")))["d"]
    assert d(None, 5) is None and d(10, None) is None and d(10, 10) == 0 and d(10, 8) == pytest.approx(20)


def test_ram_rom(spark):
    r = lambda t: one(spark, m=sp.ram_rom(F.lit(t)))["m"].asDict()
    assert r("Nova 8/256GB") == {"ram": 8, "rom": 256}
    assert r("Nova 12 GB + 1 TB") == {"ram": 12, "rom": 1024}
    assert r("Nova 128GB black") == {"ram": None, "rom": 128}
    assert r("Nova") == {"ram": None, "rom": None}


def test_text_functions(spark):
    got = one(
        spark, a=tx.as_text(F.lit(" N/A ")), b=tx.strip_badges(F.lit("NEW Sale Nova 12 - hot")), c=tx.strip_badges(F.lit("new")), d=tx.parse_date(F.lit("02/01/2024")),
        e=tx.relative_date(F.lit("2 weeks ago"), F.lit("2024-01-20").cast("date")), f=tx.json_object(F.lit('sure: {"a": {"b": 1}} ok')), g=tx.event_kind(F.lit("Launch sale")), h=tx.tokens(F.lit("Nova 手机壳")),
    )
    assert got["a"] is None and got["b"] == "Nova 12" and got["c"] == "new" and got["d"] == date(2024, 1, 2) and got["e"] == date(2024, 1, 6)
    assert got["f"] == '{"a": {"b": 1}}' and got["g"] == "promo" and got["h"] == ["nova", "手机", "机壳"]


def test_null_category_passes_and_loose_filter_keeps_unknown(spark):
    df = spark.createDataFrame([("a", None, "unknown"), ("a", "b", "device"), ("a", "a", "accessory")], "l string, r string, product_kind string")
    assert df.where(flt.same_category("l", "r")).count() == 2
    assert df.where(flt.not_accessory()).count() == 2


def test_scope():
    assert flt.scope("all") == {"country": None, "category": None}
    assert flt.scope("MX:phone") == {"country": "MX", "category": "phone"} and flt.scope(":phone")["country"] is None


def test_chain_is_immune_to_composition():
    a = {m: 10.0 for m in "abcd"}
    dear = {m: 10.0 for m in "abcd"} | {"x": 900.0, "y": 900.0}
    assert [v for _, v in fold_chain([1, 2, 3], [a, dear, a])] == [100.0, 100.0, 100.0]
    up = {m: 11.0 for m in "abcd"}
    assert fold_chain([1, 2], [a, up])[1][1] == pytest.approx(110.0)
    assert fold_chain([1, 2, 3], [a, {"a": 20.0}, up])[1] == (1, None)
    assert fold_chain([1, 2, 3], [a, {"a": 20.0}, up])[2][1] == pytest.approx(110.0)


def test_state_operators(spark):
    t = spark.createDataFrame([("a", 1, "old"), (None, 1, "null")], "k string, d int, v string")
    b = spark.createDataFrame([("a", 2, "new"), ("b", 1, "b"), ("b", 1, "b"), (None, 1, "again")], "k string, d int, v string")
    assert sorted((r.k or "", r.v) for r in insert_only(t, b, ["k"]).collect()) == [("", "null"), ("a", "old"), ("b", "b")]
    assert {r.k: r.v for r in upsert_latest(t, b, ["k"], "d").collect()} == {"a": "new", "b": "b", None: "again"}
    assert {r.v for r in protect(b.where("k is not null"), t.where("k = 'a'"), ["k"]).collect()} == {"old", "b"}
    have = spark.createDataFrame([("p1", 10), ("p2", 5)], "part string, rows_ long")
    now = spark.createDataFrame([("p1", 9), ("p2", 6), ("p3", 1)], "part string, rows_ long")
    assert {r.part for r in append_archive(have, now, "part").collect()} == {"p2", "p3"}

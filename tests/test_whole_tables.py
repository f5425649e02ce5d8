"""Queries over small tables whose every row must count, held against plain Python."""

from collections import Counter
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest

from mercato.plans import registry

COUNTRIES = {1: ("NATION_1", "ASIA"), 2: ("NATION_2", "EUROPE")}
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
LINE = "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables; ``put(name, rows, schema)`` adds one."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def star(put, parts, lines):
    """The star schema of ``lines``: (part, supplier, day, price); supplier k is in country k."""
    put("nation", [(k, n, k) for k, (n, _) in COUNTRIES.items()], "n_nationkey int, n_name string, n_regionkey int")
    put("region", [(k, r) for k, (_, r) in COUNTRIES.items()], "r_regionkey int, r_name string")
    put("supplier", [(k, k) for k in COUNTRIES], "s_suppkey long, s_nationkey int")
    put("part", parts, PART)
    return put("lineitem", [(p, s, 1, 2.0, 2 * price, 0.0, 0.0, "N", "O", day) for p, s, day, price in lines], LINE)


def test_archive_manifest_counts_every_partition(spark, tables):
    days = [datetime(y, m, d) for y in (1995, 1998, 2000, 2001, 2024) for m in (1, 12) for d in (1, 28)]
    lines = [(1, 1 + i % 2, d, 100.0) for i, d in enumerate(days * 3)]
    got = registry.queries()["archive_manifest"](spark, star(tables, [(1, "red widget", "Brand#1", "A", 1, 1.0)], lines)).collect()
    want = Counter((*COUNTRIES[s], d.strftime("%Y-%m-01")) for _, s, d, _ in lines)
    assert {(r.country, r.currency, r.part): r.rows_ for r in got} == want and len(got) == len(want)


def test_model_key_join_links_products_of_every_size(spark, tables):
    names = ["Nova red ring", "Luma red ring", "Nova Red-Ring", "Luma blue box", "Nova x", None]
    parts = [(i, names[i % 6], "Brand#1" if i % 5 < 2 else f"Brand#{i % 5}", "A", 1 + 7 * i % 50, 1.0) for i in range(60)]

    def keys(name):
        words = (name or "").lower().split()
        return {k for k in ("".join(c for c in "".join(w) if c.isalnum()) for w in (words, words[1:])) if len(k) >= 3}

    got = registry.queries()["model_key_join"](spark, tables("part", parts, PART)).collect()
    want = {(a[0], b[0]): min(keys(a[1]) & keys(b[1])) for a in parts for b in parts if a[2] == "Brand#1" != b[2] and keys(a[1]) & keys(b[1])}
    assert {(r.mine, r.rival): r.key for r in got} == want and len(got) == len(want)


def test_brand_category_coverage_counts_every_product_and_shows_zeros(spark, tables):
    parts = [(i, "red ring", f"Brand#{i % 4}", "ABC"[i // 4 % 2 if i % 4 else 2], 1 + i % 50, 1.0) for i in range(100)]
    got = registry.queries()["brand_category_coverage"](spark, tables("part", parts, PART)).collect()
    n = Counter((b, c) for _, _, b, c, _, _ in parts)
    want = {(b, c): n[b, c] for b in {k[0] for k in n} for c in {k[1] for k in n}}
    assert 0 in want.values() and {(r.brand, r.category): r.products for r in got} == want and len(got) == len(want)


def test_alert_scan_watches_every_product(spark, tables):
    parts = [(i, "red ring", "Brand#1", "A", i, 1.0) for i in range(1, 7)]
    prices = [100.0, 104.0, 104 * 1.06, 104 * 1.06 * 1.12, 104 * 1.06 * 1.12 * 1.9]  # moves of 4, 6, 12 and 90 percent
    lines = [(p[0], 1, datetime(2000, 1, 1 + d), v) for p in parts for d, v in enumerate(prices)]
    got = registry.queries()["alert_scan"](spark, star(tables, parts, lines)).collect()
    want = {(i, c) for i in range(1, 7) for c in (4, 6, 12) if c >= (3, 5, 10)[i % 3]}
    assert {(r.product_id, round(r.change_pct)) for r in got} == want and len(got) == len(want)


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_series_follow_the_days_of_the_events(spark, tables):
    days = [(1, date(2023, 12, 20), 10.0), (2, date(2023, 12, 30), 7.0), (1, date(2024, 2, 10), 20.0), (2, date(2024, 1, 15), 14.0)]
    at = lambda d: datetime(d.year, d.month, d.day, 12)
    sf_dir = tables("events", [(i, at(d), u, "view", v) for i, (u, d, v) in enumerate(days)] + [(9, at(date(2024, 2, 12)), 1, "error", 1.0), (10, None, 1, "error", 1.0)], EVENT)
    want, first = {}, {}
    for u in (1, 2):
        price = None
        for k in range((date(2024, 2, 12) - date(2023, 12, 20)).days + 1):
            d = date(2023, 12, 20) + timedelta(k)
            new = [v for w, e, v in days if (w, e) == (u, d)]
            price = new[0] if new else price
            first.setdefault(u, price) if price else None
            want[u, d] = (price, price is not None and not new)
    q = registry.queries()
    assert {(r.user_id, r.day): (r.price, r.is_filled) for r in q["locf_series"](spark, sf_dir).collect()} == want
    index = {(r.user_id, r.day): r.index_100 for r in q["index_series"](spark, sf_dir).collect()}
    assert index == {(u, d): pytest.approx(100 * p / first[u]) for (u, d), (p, _) in want.items() if p}


def test_channel_health_takes_the_last_week_of_the_events(spark, tables):
    rows = [(i, datetime(2025, 3, 1 + i % 20, 23), i % 3, "error" if i % 4 else "purchase", 1.0) for i in range(120)]
    got = registry.queries()["channel_health"](spark, tables("events", rows, EVENT)).collect()
    week = [r for r in rows if r[1].date() > date(2025, 3, 13)]
    assert {(r.channel_id, r.attempts, r.failed, r.ok) for r in got} == {(c, len(x), sum(e[3] == "error" for e in x), sum(e[3] == "purchase" for e in x)) for c in range(3) for x in [[e for e in week if e[2] == c]]}


def test_sound_moves_round_what_is_shown_as_the_sql_does(spark, tables):
    import duckdb

    cents = lambda x: int(abs(x) * 100 + 0.5) / 100 * (-1 if x < 0 else 1)
    digits = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))

    def sound(a, b, shown):
        return abs(shown((b - a) / a * 100) - (shown(b) - shown(a)) / shown(a) * 100) <= 0.01

    odd = [(64.195, 132.265), (65.835, 158.515), (66.575, 18.025), (126.915, 145.795), (18.935, 13.445)]
    assert [sound(a, b, cents) for a, b in odd] == [True, True, True, False, False] == [not sound(a, b, digits) for a, b in odd]
    lines = [(k, 1, datetime(2000, 1, d), p) for k, pair in enumerate(odd) for d, p in zip((1, 2), pair)]
    sf_dir = star(tables, [(k, "old widget", "Brand#1", "SMALL", 1, 1.0) for k in range(len(odd))], lines)
    con = duckdb.connect()
    for t in ("nation", "region", "supplier", "part", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["sound_moves"]).fetchall()
    assert [(r.n, r.products) for r in registry.queries()["sound_moves"](spark, sf_dir).collect()] == [r[1:3] for r in want]
    assert want[0][1] == sum(sound(a, b, cents) for a, b in odd) != sum(sound(a, b, digits) for a, b in odd)

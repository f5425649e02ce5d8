"""The spread chained index against the fold by hand, on series with bad coverage, breaks and members that come and go."""

import random
from datetime import date, timedelta

import pytest

from mercato.operators.chains import base_pairs, chain_index
from mercato.plans.series import fold_chain


@pytest.mark.parametrize("seed", range(4))
def test_against_the_fold(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], {}
    for series in range(5):
        members = list(range(rnd.randint(3, 12)))
        share = rnd.choice([0.9, 0.5, 0.3])
        prices, days = [], []
        for k in range(25):
            here = {m: rnd.choice([0.0, 10.0, 12.5, 8.0, 20.0]) for m in members if rnd.random() < (share if k % 5 else 0.15)}
            if here:
                days.append(date(2024, 1, 1) + timedelta(days=k))
                prices.append(here)
        size = len({m for p in prices for m in p})
        for d, (pairs, value) in zip(days, fold_chain(days, prices, can_rebase=lambda t: len(t) >= 0.5 * size)):
            want[series, d] = (pairs, value)
        rows += [(series, d, m, v) for d, p in zip(days, prices) for m, v in p.items()]
    df = spark.createDataFrame([*rows, (0, date(2024, 1, 9), 999, None)], "series long, day date, member long, v double")
    got = {(r.series, r.day): (r.pairs, r.chain_index) for r in chain_index(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == (None if want[k][1] is None else pytest.approx(want[k][1])) for k in want)


def test_candidates_are_the_run_back_to_the_last_covered_day(spark):
    days = [(1, date(2024, 1, k), k in (2, 3, 6)) for k in range(1, 9)]
    got = sorted((r.day.day, r.base.day) for r in base_pairs(spark.createDataFrame(days, "series int, day date, covered boolean")).collect())
    assert got == [(2, 1), (3, 2), (4, 3), (5, 3), (5, 4), (6, 3), (6, 4), (6, 5), (7, 6), (8, 6), (8, 7)]


def test_empty(spark):
    assert chain_index(spark.createDataFrame([], "series long, day date, member long, v double")).collect() == []

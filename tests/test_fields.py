"""What fields of rivals come to, read from sorted prices, against all pairs; pairs are never made."""

import math

import numpy as np
import pytest

from mercato.operators import fields
from mercato.operators.fields import SEP, Field, matched, middles, nearest, places, stretch, sums
from mercato.plans import registry

RND = np.random.default_rng(4)


def field(n_own, n_rivals, ties):
    n = n_own + n_rivals
    price = RND.choice([100.0, 70.0, 130.0, 100 * 1.3, 91.0, 0.1 * 1000 / 1.3], n) if ties else np.round(RND.lognormal(5, 0.4, n), 2)
    cols = {"own": np.arange(n) < n_own, "id": RND.permutation(n) * 3, "price": price, "ram": RND.choice([np.nan, 2.0, 4.0, 10.0], n), "lrom": np.log(RND.choice([64.0, 128.0, 512.0], n)), "avail": RND.choice([0.5875, 0.7, 1.0], n)}
    cols |= {"cuts": RND.integers(0, 4, n), "worst": RND.normal(0, 9, n)}
    return Field(SEP.join(("NATION_1", "ASIA", "SMALL")), cols)


def pairs(f):
    """own row, rival row, spec, total, by the formula."""
    for i in range(len(f.own["id"])):
        for j in range(len(f.rival["id"])):
            m, r = ({k: float(x[k][y]) for k in ("price", "ram", "lrom", "avail")} for x, y in ((f.own, i), (f.rival, j)))
            off = abs(r["price"] / m["price"] - 1)
            sure = 0.6 if math.isnan(m["ram"]) or math.isnan(r["ram"]) else 1.0
            ram = 0.0 if sure < 1 else 0.4 * max(0.0, 1 - abs(m["ram"] - r["ram"]) / 8.0)
            spec = (ram + 0.6 * max(0.0, 1 - abs(m["lrom"] - r["lrom"]) / math.log(8))) / sure
            if off <= 0.3:
                yield i, j, spec, (0.85 if sure < 1 else 1.0) * (0.45 * spec + 0.35 * (1 - off / 0.3) + 0.2 * r["avail"])


@pytest.mark.parametrize("size", [(0, 5), (1, 1), (7, 90), (40, 300)])
@pytest.mark.parametrize("ties", [False, True])
def test_fields_against_all_pairs(size, ties):
    f = field(*size, ties)
    every = list(pairs(f))
    for least, least_spec in ((0.6, 0.0), (0.6, 0.55), (0.8, 0.55), (0.3, 0.0)):
        ok = [p for p in every if p[3] >= least and p[2] >= least_spec]
        (cuts,), worst = sums(f, least, least_spec, ("cuts",), "worst")
        assert cuts.tolist() == [sum(int(f.rival["cuts"][j]) for i, j, *_ in ok if i == k) for k in range(size[0])]
        assert worst.tolist() == [min((f.rival["worst"][j] for i, j, *_ in ok if i == k), default=np.inf) for k in range(size[0])]
        want = []
        for k in range(size[0]):
            best = sorted(((-math.floor(t * 1e9 + 0.5), f.rival["id"][j]) for i, j, _, t in ok if i == k))[:5]
            want += [(k, r) for _, r in best]
        for at_once in (1, 7, 10_000):
            got = [(i, j) for own, rival in fields.pairs(f, least, at_once) for i, j in zip(own.tolist(), rival.tolist())]
            assert sorted(got) == sorted((i, j) for i, j, _, t in every if t >= least)
        own, rival, _ = nearest(f, 5, least, least_spec)
        assert sorted(zip(own.tolist(), f.rival["id"][rival].tolist())) == sorted((k, int(r)) for k, r in want)
        if size[0] and least_spec == 0:
            assert set(np.flatnonzero(matched(f, least)).tolist()) == {j for _, j, *_ in ok}
    n, mid = middles(f)
    for k in range(size[0]):
        near = sorted(f.rival["price"][j] for i, j, *_ in every if i == k)
        assert n[k] == len(near) and (np.isnan(mid[k]) if not near else mid[k] == pytest.approx(np.median(near)))


def test_stretches_end_where_the_score_ends_however_poor_the_guess():
    prices = np.sort(RND.uniform(50, 200, 400))
    at = RND.uniform(60, 180, 50)
    for low, high in ((at, at), (at * 0 + 1, at * 0 + 999), (at * 0.7, at * 1.3)):
        lo, hi = stretch(prices, at, low, high, lambda r, p: np.abs(p / at[r] - 1) <= 0.3)
        assert [(a, b) for a, b in zip(lo, hi)] == [(int(np.argmax(g)), int(np.argmax(g) + g.sum())) for g in (np.abs(prices / x - 1) <= 0.3 for x in at)]


@pytest.mark.parametrize("name", ["competitor_match", "my_position", "deviation_mix", "weekly_alerts", "move_threats", "match_invariant", "own_vs_rivals", "spec_similarity", "protected_matches"])
def test_no_pairs_are_joined(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "rrom" not in plan and "rival#" not in plan.split("MapInArrow", 1)[1].split("\n", 1)[1]


def test_places():
    x = np.array([0.00005, -0.00005, 1.23455, -2.5, 0.1 + 0.2, -1e-12, np.nan])
    assert str(places(x).tolist()) == str([0.0001, -0.0, 1.2346, -2.5, 0.3, 0.0, math.nan])

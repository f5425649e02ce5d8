"""Revocation to a fixpoint: chains, diamonds, cycles, and nothing else."""

import random

from mercato.operators.provenance import reachable, revoke

EDGE = "derived long, premise long"


def closure(edges, start):
    found, todo = set(), set(start)
    while todo:
        x = todo.pop()
        for d, p in edges:
            if p == x and d not in found:
                found.add(d)
                todo.add(d)
    return found


def test_reachable(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)] + [(100 + i + 1, 100 + i) for i in range(25)] + [(200, 201), (201, 200), (None, 1), (3, None)]
    start = [1, 7, 100, 200, None]
    got = {r.fact for r in reachable(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in start], "fact long")).collect()}
    assert got == closure([e for e in edges if None not in e], [x for x in start if x is not None])
    none = spark.createDataFrame([], "fact long")
    assert reachable(spark.createDataFrame(edges, EDGE), none).count() == 0


def test_revoke_takes_back_what_came_from_the_change_and_nothing_else(spark):
    facts = spark.createDataFrame([(1, 8, "source"), (2, 8, "inferred"), (3, 8, "inferred"), (4, 12, "source"), (5, 12, "inferred"), (6, 8, "inferred"), (7, 3, "source")], "fact long, value int, origin string")
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (6, 3), (6, 4), (7, 3)], EDGE)
    got = {r.fact: (r.value, r.origin) for r in revoke(facts, edges, spark.createDataFrame([(1,)], "fact long")).collect()}
    assert got == {1: (8, "source"), 2: (None, "revoked"), 3: (None, "revoked"), 4: (12, "source"), 5: (12, "inferred"), 6: (None, "revoked"), 7: (3, "source")}

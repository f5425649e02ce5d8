from collections import Counter

import numpy as np
import pytest

from mercato.llm import sharding


@pytest.mark.parametrize("n", [3, 2000])
def test_small_tables_are_dealt_from_several_sources(spark, monkeypatch, n):
    drawn = []

    def matrix(sources, parts, seed, draw=sharding.communication_matrix):
        drawn.append((sources, parts, [r.copy() for r in draw(sources, parts, seed)]))
        return iter(drawn[-1][2])

    monkeypatch.setattr(sharding, "communication_matrix", matrix)
    rows = spark.range(n).selectExpr("id as doc_id", "id * 3 as size")
    got = sharding.shuffle_into_shards(rows, 8).collect()
    ((sources, parts, cells),) = drawn
    assert len(sources) >= 8 and max(sources) < n and sum(sources) == n == sum(parts)
    assert [int(r.sum()) for r in cells] == sources and np.sum(cells, axis=0).tolist() == parts
    per = Counter(r.shard for r in got)
    assert sorted(r.doc_id for r in got) == list(range(n)) and [per[s] for s in range(8)] == parts
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(m)) for s, m in per.items())

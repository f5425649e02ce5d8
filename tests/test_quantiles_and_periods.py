import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from mercato.functions import listing as ls
from mercato.operators.asof import price_changes
from mercato.operators.quantiles import at_ranks, interpolated
from mercato.plans import registry
from mercato.plans.periods import token
from mercato.streaming.incremental import EVENTS, run_available
from mercato.streaming.incremental import price_changes as stream_changes


def test_spread_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, v) for k in ("a", "b", None) for v in [None, 0.0, -3.5, *(round(rng.lognormvariate(3, 2), 2) * rng.choice((1, -1, 1)) for _ in range(rng.randint(1, 400)))]]
    rows += [("same", 7.0)] * 50 + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    con = duckdb.connect()
    con.execute("create table t (k varchar, v double)")
    con.executemany("insert into t values (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute("select k, count(v), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.9) from t group by k having count(v) > 0").fetchall()}
    got = {r.k: (r.n, r.a, r.b, r.c) for r in interpolated(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    low = {r.k: r.x for r in at_ranks(df, ["k"], "v", {"x": "1"}).collect()}
    assert low == {k: min(v for q, v in rows if q == k and v is not None) for k in want}


def test_zero_prices_divide_nothing(spark):
    day = datetime(2024, 1, 1).date()
    df = spark.createDataFrame([("a", day + timedelta(i), p) for i, p in enumerate((0.0, 5.0, 0.0, 10.0))], "k string, obs_date date, price double")
    assert [r.change_pct for r in price_changes(df, ["k"], 30, 2.0).collect()] == [-100.0]


def test_series_of_zero_events(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 4), i % 3, "view", float(i % 4)) for i in range(24)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("product_chain_index", "index_series", "basket_level"):
        assert registry.queries()[name](spark, str(tmp_path)).count() > 0


def test_window_tokens(spark):
    day = F.lit("2024-06-30").cast("date")
    got = spark.range(1).select(token("$cur.start-90d", day).alias("a"), token("prev.end", day).alias("b")).first()
    assert (str(got.a), str(got.b)) == ("2024-03-19", "2024-06-16")
    with pytest.raises(ValueError):
        token("$next.start", day)


def test_a_stream_of_changes_ends_and_late_rows_replace_nothing(spark, tmp_path):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [(1, at(1), 7, "view", 10.0, ""), (2, at(1, 2), 7, "view", 10.1, ""), (3, at(2), 7, "view", 20.0, ""), (4, at(1, 1), 8, "view", 5.0, ""), (5, at(2), 7, "view", 0.0, ""), (6, at(3), 7, "error", 99.0, "")]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = run_available(stream_changes(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"))).collect()
    assert [(r.user_id, r.prev_price, r.curr_price) for r in got] == [(7, 10.1, 20.0)]


@pytest.mark.parametrize(
    "title, kind",
    [("Funda para Nova phone", "accessory"), ("Nova phone + case", "device"), ("Case Nova phone", "accessory"), ("Phone for phone", "unknown"), ("Nova", "unknown"), (None, "unknown"), ("", "unknown")],
)
def test_product_kind(spark, title, kind):
    assert spark.range(1).select(ls.product_kind(F.lit(title).cast("string")).alias("k")).first().k == kind


def test_without_the_training_data_folders(tmp_path):
    """The entry point lives without the optional folder, also where the pipeline's module is still there."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True).returncode == 0

"""Time series: calendar spine, carry-forward, indices, chained matched-pair index, first sightings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators.asof import carry_forward, spine
from ..operators.chains import chain_index
from ..operators.quantiles import interpolated
from ..sources.tables import observations, over_obs, read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)

DAILY = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS v FROM events WHERE event_type IN ('purchase', 'view') GROUP BY ALL),
    sp AS (SELECT user_id, unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT date_trunc('day', max(ts)) FROM events), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM d)),
    l AS (SELECT sp.user_id, sp.day, d.v, last_value(d.v IGNORE NULLS) OVER (PARTITION BY sp.user_id ORDER BY sp.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM sp LEFT JOIN d ON sp.user_id = d.user_id AND sp.day = d.day)"""


def member_days(spark, sf_dir):
    """Daily price of each member: the events' least value of a user's day."""
    ev = read(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    return ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("value").alias("v"))


def carried(spark, sf_dir):
    """Every member on every day from the first to the last of the events, with its last price so far."""
    d = member_days(spark, sf_dir)
    day = F.to_date("ts")
    ends = read(spark, sf_dir, "events").agg(F.min(day).alias("start"), F.max(day).alias("end"))
    axis = spine(d.select("user_id").distinct().crossJoin(F.broadcast(ends)), ["user_id"])
    rows = axis.join(d, ["user_id", "day"], "left")
    last, filled = carry_forward("v", ["user_id"])
    return rows.select("user_id", "day", "v", last.alias("price"), filled.alias("is_filled"))


@query(DAILY + " SELECT user_id, day, round(filled + 1e-9, 4) AS price, v IS NULL AND filled IS NOT NULL AS is_filled FROM l")
def locf_series(spark, sf_dir):
    """Carry the last price forward over the calendar, never back."""
    return carried(spark, sf_dir).select("user_id", "day", r4(F.col("price")).alias("price"), "is_filled")


@query(DAILY + ", f AS (SELECT *, first_value(filled IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM l) SELECT user_id, day, round(100 * filled / nullif(base, 0) + 1e-9, 4) AS index_100 FROM f WHERE filled IS NOT NULL")
def index_series(spark, sf_dir):
    """Each line against its own first price = 100."""
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = carried(spark, sf_dir).withColumn("base", F.first("price", ignorenulls=True).over(w))
    return rows.where("price is not null").select("user_id", "day", r4(F.try_divide(100 * F.col("price"), F.col("base"))).alias("index_100"))


PAIRS = """, g AS (SELECT user_id % 10 AS series, user_id, day, filled FROM l WHERE filled IS NOT NULL),
    p AS (SELECT series, day, filled / nullif(lag(filled) OVER (PARTITION BY user_id ORDER BY day), 0) AS ratio FROM g),
    m AS (SELECT series, day, median(ratio) AS step, count(ratio) AS pairs FROM p GROUP BY series, day)"""


@query(DAILY + PAIRS + " SELECT series, day, pairs, round(100 * exp(sum(coalesce(ln(CASE WHEN pairs >= 3 AND step > 0 THEN step END), 0)) OVER (PARTITION BY series ORDER BY day)) + 1e-9, 4) AS chain_index FROM m")
def product_chain_index(spark, sf_dir):
    """The chained matched-pair index on carried lines: the product of daily median ratios of members present on both days. Members that enter or leave do not move it."""
    g = carried(spark, sf_dir).where("price is not null").withColumn("series", F.col("user_id") % 10)
    ratio = F.try_divide(F.col("price"), F.lag("price").over(Window.partitionBy("user_id").orderBy("day")))
    ratios = g.select("series", "day", ratio.alias("ratio"))
    steps = interpolated(ratios, ["series", "day"], "ratio", {"step": 0.5}).withColumnRenamed("n", "pairs")
    m = g.select("series", "day").distinct().join(steps, ["series", "day"], "left").na.fill(0, ["pairs"])
    w = Window.partitionBy("series").orderBy("day")
    step = F.coalesce(F.ln(F.when((F.col("pairs") >= 3) & (F.col("step") > 0), F.col("step"))), F.lit(0.0))
    return m.select("series", "day", "pairs", r4(100 * F.exp(F.sum(step).over(w))).alias("chain_index"))


def _fixed_basket(spark, sf_dir):
    """Members seen on at least max(2, 60 percent of their series' active days)."""
    d = member_days(spark, sf_dir).withColumn("series", F.col("user_id") % 10)
    active = d.groupBy("series").agg(F.countDistinct("day").alias("active"))
    seen = d.groupBy("series", "user_id").agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(2), F.floor(F.col("active") * 0.6))
    members = seen.join(active, "series").where(F.col("n") >= need).select("user_id")
    return d.join(members, "user_id", "left_semi")


@query(
    DAILY + """, b AS (SELECT d.*, user_id % 10 AS series FROM d), act AS (SELECT series, count(DISTINCT day) AS active FROM b GROUP BY series),
    mem AS (SELECT b.series, user_id FROM b JOIN act USING (series) GROUP BY b.series, user_id, active HAVING count(*) >= greatest(2, floor(active * 0.6))),
    sz AS (SELECT series, count(*) AS members FROM mem GROUP BY series)
    SELECT b.series, b.day, count(*) AS present, CASE WHEN count(*) >= 0.5 * members THEN round(median(b.v) + 1e-9, 4) END AS level FROM b JOIN mem ON b.user_id = mem.user_id JOIN sz ON sz.series = b.series GROUP BY b.series, b.day, members"""
)
def basket_level(spark, sf_dir):
    """The median of a fixed basket, null on days when under half of it is present."""
    d = _fixed_basket(spark, sf_dir)
    size = d.groupBy("series").agg(F.countDistinct("user_id").alias("members"))
    day = d.groupBy("series", "day").agg(F.count("*").alias("present")).join(interpolated(d, ["series", "day"], "v", {"m": 0.5}).drop("n"), ["series", "day"], "left")
    return day.join(size, "series").select("series", "day", "present", F.when(F.col("present") >= 0.5 * F.col("members"), r4(F.col("m"))).alias("level"))


def fold_chain(days: list, prices: list[dict], min_pairs: int = 3, can_rebase=None) -> list[tuple]:
    """The chained index of one short series by hand: (pairs, index) for each day. ``operators.chains`` spreads the same rule.

    A day with at least ``min_pairs`` members of the base day moves the index by the median of their ratios and becomes the base. A day with
    fewer has no index (a break); it still becomes the base if ``can_rebase`` says its coverage is good, and the
    chain goes on from the last index.
    """
    from statistics import median

    out, base, level = [], None, 100.0
    for today in prices:
        if base is None:
            pairs, value = 0, 100.0 if today else None
            base = today or None
        else:
            ratios = [today[m] / base[m] for m in today if base.get(m)]
            pairs, value = len(ratios), None
            if pairs >= min_pairs:
                level *= median(ratios)
                base, value = today, level
            elif can_rebase and can_rebase(today):
                base = today
        out.append((pairs, value))
    return out


@query(
    DAILY.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + """, b AS (SELECT d.*, user_id % 10 AS series FROM d), act AS (SELECT series, count(DISTINCT day) AS active FROM b GROUP BY series),
    mem AS (SELECT b.series, user_id FROM b JOIN act USING (series) GROUP BY b.series, user_id, active HAVING count(*) >= greatest(2, floor(active * 0.6))),
    k AS (SELECT b.series, b.user_id, day, v FROM b JOIN mem ON b.user_id = mem.user_id WHERE v IS NOT NULL), sz AS (SELECT series, count(DISTINCT user_id) AS members FROM k GROUP BY series),
    dy AS (SELECT k.series, day, count(*) >= 0.5 * members AS covered, row_number() OVER (PARTITION BY k.series ORDER BY day) AS rn FROM k JOIN sz USING (series) GROUP BY k.series, day, members),
    pr AS (SELECT a.series, a.day AS base, c.day, count(*) AS pairs, median(c.v / a.v) AS step FROM k a JOIN k c ON c.series = a.series AND c.user_id = a.user_id AND c.day > a.day WHERE a.v <> 0 GROUP BY ALL),
    f AS (SELECT series, rn, day, day AS base, CAST(100 AS DOUBLE) AS level, CAST(0 AS BIGINT) AS pairs, CAST(100 AS DOUBLE) AS chain_index FROM dy WHERE rn = 1
      UNION ALL SELECT n.series, n.rn, n.day, CASE WHEN coalesce(pr.pairs, 0) >= 3 OR n.covered THEN n.day ELSE f.base END, CASE WHEN coalesce(pr.pairs, 0) >= 3 THEN f.level * pr.step ELSE f.level END, coalesce(pr.pairs, 0), CASE WHEN coalesce(pr.pairs, 0) >= 3 THEN f.level * pr.step END
      FROM f JOIN dy n ON n.series = f.series AND n.rn = f.rn + 1 LEFT JOIN pr ON pr.series = f.series AND pr.base = f.base AND pr.day = n.day)
    SELECT series, day, pairs, round(chain_index + 1e-9, 4) AS chain_index FROM f"""
)
def basket_chain_index(spark, sf_dir):
    """The chained index of fixed baskets, with breaks and re-basing on well covered days."""
    d = _fixed_basket(spark, sf_dir).select("series", "day", F.col("user_id").alias("member"), "v")
    return chain_index(d).select("series", "day", "pairs", r4(F.col("chain_index")).alias("chain_index"))


@query(
    over_obs(""", f AS (SELECT product_id, country, min(obs_date) AS first_seen FROM obs WHERE product_kind <> 'accessory' GROUP BY ALL)
    SELECT product_id, country, first_seen, CAST(rank() OVER (PARTITION BY product_id ORDER BY first_seen) AS INTEGER) AS country_rank, CAST(date_diff('day', min(first_seen) OVER (PARTITION BY product_id), first_seen) AS INTEGER) AS days_after_global FROM f""")
)
def first_seen_new(spark, sf_dir):
    """First sighting by product and country, its rank among the countries and its lag behind the first."""
    f = observations(spark, sf_dir).where(flt.not_accessory()).groupBy("product_id", "country").agg(F.min("obs_date").alias("first_seen"))
    w = Window.partitionBy("product_id")
    return f.select("product_id", "country", "first_seen", F.rank().over(w.orderBy("first_seen")).alias("country_rank"), F.datediff("first_seen", F.min("first_seen").over(w)).alias("days_after_global"))


@query(
    over_obs(""", c AS (SELECT product_id, country, currency, min(obs_date) AS d FROM obs GROUP BY ALL), r AS (SELECT product_id, currency, min(d) AS region_first, count(*) AS countries FROM c GROUP BY ALL)
    SELECT c.product_id, c.country, c.currency, c.d AS country_first, r.region_first, r.countries FROM c JOIN r USING (product_id, currency) WHERE c.d > (SELECT max(obs_date) FROM obs) - INTERVAL 365 DAY""")
)
def launch_cards(spark, sf_dir, days=365):
    """First sightings by country and by region; the minimum is taken before the window."""
    obs = observations(spark, sf_dir)
    now = obs.agg(F.max("obs_date").alias("m"))
    c = obs.groupBy("product_id", "country", "currency").agg(F.min("obs_date").alias("country_first"))
    w = Window.partitionBy("product_id", "currency")
    rows = c.select("*", F.min("country_first").over(w).alias("region_first"), F.count("*").over(w).alias("countries"))
    return rows.crossJoin(F.broadcast(now)).where(F.col("country_first") > F.date_sub("m", days)).select("product_id", "country", "currency", "country_first", "region_first", "countries")


@query(
    over_obs(""", t AS (SELECT country, category, currency, product_id, median(sale_price) AS p FROM obs WHERE product_kind = 'device' GROUP BY ALL),
    k AS (SELECT *, count(*) OVER c AS n, rank() OVER (PARTITION BY country, category, currency ORDER BY p) AS r FROM t WINDOW c AS (PARTITION BY country, category, currency))
    SELECT country, category, currency, product_id, n, CASE WHEN n >= 8 THEN round((r - 1) / n + 1e-9, 4) END AS pct_rank FROM k""")
)
def percentile_rank_cohort(spark, sf_dir):
    """Share of the cohort that is strictly cheaper; cohorts under 8 have none."""
    t = observations(spark, sf_dir).where("product_kind = 'device'").groupBy("country", "category", "currency", "product_id").agg(F.median("sale_price").alias("p"))
    c = Window.partitionBy("country", "category", "currency")
    n = F.count("*").over(c)
    k = t.select("*", n.alias("n"), F.rank().over(c.orderBy("p")).alias("r"))
    return k.select("country", "category", "currency", "product_id", "n", F.when(F.col("n") >= 8, r4((F.col("r") - 1) / F.col("n"))).alias("pct_rank"))

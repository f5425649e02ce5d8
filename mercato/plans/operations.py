"""Operational queries: tiles, options, health, price search, intel, launches, set algebra, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..sources.tables import observations, over_obs, read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)


@query(over_obs(" SELECT count(*) AS obs, count(DISTINCT product_id) AS products, count(DISTINCT channel_id) AS channels, count(DISTINCT country) AS countries, min(obs_date) AS first_day, max(obs_date) AS last_day, count(CASE WHEN audit_status = 'pending' THEN 1 END) AS pending FROM obs"))
def overview_tiles(spark, sf_dir):
    return observations(spark, sf_dir).agg(
        F.count("*").alias("obs"), F.countDistinct("product_id").alias("products"), F.countDistinct("channel_id").alias("channels"), F.countDistinct("country").alias("countries"),
        F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.count(F.when(F.col("audit_status") == "pending", 1)).alias("pending"),
    )


@query(over_obs(" SELECT 'brand' AS kind, brand AS value, count(*) AS n FROM obs GROUP BY brand UNION ALL SELECT 'category', category, count(*) FROM obs GROUP BY category UNION ALL SELECT 'country', country, count(*) FROM obs GROUP BY country"))
def filter_options(spark, sf_dir):
    """Values to filter by with their counts: one scan, grouping sets."""
    g = observations(spark, sf_dir).groupingSets([["brand"], ["category"], ["country"]], "brand", "category", "country").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 3, "brand").when(F.col("gid") == 5, "category").otherwise("country")
    return g.select(kind.alias("kind"), F.coalesce("brand", "category", "country").alias("value"), "n")


@query("SELECT b.p_brand AS brand, t.p_type AS category, count(p.p_partkey) AS products FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) t LEFT JOIN part p ON p.p_brand = b.p_brand AND p.p_type = t.p_type GROUP BY ALL")
def brand_category_coverage(spark, sf_dir):
    """All products of each brand and category, zero rows included."""
    p = read(spark, sf_dir, "part")
    grid = p.select(F.col("p_brand").alias("brand")).distinct().crossJoin(F.broadcast(p.select(F.col("p_type").alias("category")).distinct()))
    n = p.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("category")).agg(F.count("*").alias("products"))
    return grid.join(n, ["brand", "category"], "left").na.fill(0, ["products"])


@query(over_obs(""" SELECT country, CASE WHEN title LIKE '%ring%' THEN 'ring' WHEN title LIKE '%widget%' THEN 'widget' ELSE 'unnamed' END AS family, count(*) AS n, count(CASE WHEN discount_pct >= 8 THEN 1 END) AS important FROM obs GROUP BY ALL"""))
def intel_by_country(spark, sf_dir):
    """Counts with a bucket of their own for what names nothing known."""
    t = F.col("title")
    family = F.when(t.contains("ring"), "ring").when(t.contains("widget"), "widget").otherwise("unnamed")
    return observations(spark, sf_dir).groupBy("country", family.alias("family")).agg(F.count("*").alias("n"), F.count(F.when(F.col("discount_pct") >= 8, 1)).alias("important"))


@query(over_obs(""", f AS (SELECT product_id, brand, country, min(obs_date) AS d FROM obs GROUP BY ALL) SELECT product_id, brand, count(*) AS countries, min(d) AS global_launch, CAST(date_diff('day', min(d), max(d)) AS INTEGER) AS rollout_days, count(*) < 6 AS pending FROM f GROUP BY product_id, brand HAVING count(*) >= 2"""))
def launch_board(spark, sf_dir):
    f = observations(spark, sf_dir).groupBy("product_id", "brand", "country").agg(F.min("obs_date").alias("d"))
    return f.groupBy("product_id", "brand").agg(F.count("*").alias("countries"), F.min("d").alias("global_launch"), F.datediff(F.max("d"), F.min("d")).alias("rollout_days"), (F.count("*") < 6).alias("pending")).where("countries >= 2")


@query("""WITH h AS (SELECT user_id AS channel_id, count(*) AS attempts, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS ok, max(CAST(ts AS DATE)) AS last_day FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - INTERVAL 7 DAY GROUP BY ALL)
    SELECT channel_id, attempts, failed, ok, CASE WHEN attempts < 5 THEN 'thin' WHEN failed >= 0.5 * attempts THEN 'pause' WHEN failed >= 0.25 * attempts THEN 'slow_down' WHEN ok = 0 THEN 'check' ELSE 'keep' END AS verdict FROM h""")
def channel_health(spark, sf_dir):
    """The last week's outcomes by channel, without the fan-out of joining raw history, and the first verdict that applies."""
    rows = flt.recent(read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), 7, "day")
    n, bad, ok = F.count("*"), F.count(F.when(F.col("event_type") == "error", 1)), F.count(F.when(F.col("event_type") == "purchase", 1))
    verdict = F.when(n < 5, "thin").when(bad >= 0.5 * n, "pause").when(bad >= 0.25 * n, "slow_down").when(ok == 0, "check").otherwise("keep")
    return rows.groupBy(F.col("user_id").alias("channel_id")).agg(n.alias("attempts"), bad.alias("failed"), ok.alias("ok"), verdict.alias("verdict"))


@query(over_obs(""" SELECT title, country, brand, seller_kind, round(sale_price + 1e-9, 4) AS sale_price, obs_date, channel_id FROM obs WHERE lower(title) LIKE '%ring%' AND country = 'NATION_3' AND discount_pct > 0 AND sale_price BETWEEN 100 AND 3000 ORDER BY sale_price, obs_date DESC, channel_id, title LIMIT 50"""))
def price_search(spark, sf_dir, keyword="ring", country="NATION_3", brand=None, seller_kind=None, low=100, high=3000, discounted=True, limit=50):
    """Search with optional filters; the caller fills values in, never SQL."""
    rows = observations(spark, sf_dir).where(flt.optional(country=country, brand=brand, seller_kind=seller_kind) & flt.contains_any_case("title", keyword) & F.col("sale_price").between(low, high))
    rows = rows.where("discount_pct > 0") if discounted else rows
    return rows.orderBy("sale_price", F.desc("obs_date"), "channel_id", "title").limit(limit).select("title", "country", "brand", "seller_kind", r4(F.col("sale_price")).alias("sale_price"), "obs_date", "channel_id")


@query(over_obs(""" SELECT max(obs_date) AS last_audited FROM (SELECT obs_date FROM obs GROUP BY obs_date HAVING count(CASE WHEN audit_status = 'pending' THEN 1 END) <= 8 AND count(CASE WHEN audit_status = 'accepted' THEN 1 END) > 8)"""))
def last_audited_day(spark, sf_dir):
    s = lambda k: F.count(F.when(F.col("audit_status") == k, 1))
    return observations(spark, sf_dir).groupBy("obs_date").agg(s("pending").alias("p"), s("accepted").alias("a")).where("p <= 8 and a > 8").agg(F.max("obs_date").alias("last_audited"))


SETS = ", a AS (SELECT DISTINCT product_id FROM obs WHERE country = 'NATION_1'), b AS (SELECT DISTINCT product_id FROM obs WHERE country = 'NATION_2')"


def _two(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return tuple(obs.where(F.col("country") == c).select("product_id").distinct() for c in ("NATION_1", "NATION_2"))


@query(over_obs(SETS + " SELECT product_id FROM a UNION SELECT product_id FROM b"))
def set_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.unionByName(b).distinct()


@query(over_obs(SETS + " SELECT product_id FROM a INTERSECT SELECT product_id FROM b"))
def set_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


@query(over_obs(SETS + " SELECT product_id FROM a EXCEPT SELECT product_id FROM b"))
def set_except(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.exceptAll(b)


@query(over_obs(""", s AS (SELECT DISTINCT country, brand, category FROM obs WHERE discount_pct > 9), n AS (SELECT country, count(*) AS n FROM s GROUP BY country), i AS (SELECT x.country AS a, y.country AS b, count(*) AS shared FROM s x JOIN s y ON x.brand = y.brand AND x.category = y.category AND x.country < y.country GROUP BY ALL)
    SELECT a, b, round(shared / (na.n + nb.n - shared) + 1e-9, 4) AS jaccard FROM i JOIN n na ON na.country = a JOIN n nb ON nb.country = b"""))
def set_jaccard(spark, sf_dir):
    """Jaccard similarity of countries' promoted assortments."""
    s = observations(spark, sf_dir).where("discount_pct > 9").groupBy("country").agg(F.collect_set(F.struct("brand", "category")).alias("s"))
    x, y = s.select(F.col("country").alias("a"), F.col("s").alias("sa")), s.select(F.col("country").alias("b"), F.col("s").alias("sb"))
    # 25 countries with a closed assortment of brand x category each: the side is small at any scale.
    both = x.join(F.broadcast(y), F.col("a") < F.col("b")).withColumn("i", F.size(F.array_intersect("sa", "sb"))).where("i > 0")
    return both.select("a", "b", r4(F.col("i") / (F.size("sa") + F.size("sb") - F.col("i"))).alias("jaccard"))


@query(over_obs(""" SELECT country, currency, part, rows_, md5(CAST(rows_ AS VARCHAR) || '|' || country) AS stamp FROM (SELECT country, currency, CAST(CAST(date_trunc('month', obs_date) AS DATE) AS VARCHAR) AS part, count(*) AS rows_ FROM obs GROUP BY ALL)"""))
def archive_manifest(spark, sf_dir):
    """Rows of each archive partition of the whole fact, the figure that a later export must not fall below."""
    g = observations(spark, sf_dir).groupBy("country", "currency", F.to_date(F.date_trunc("month", "obs_date")).cast("string").alias("part")).agg(F.count("*").alias("rows_"))
    return g.withColumn("stamp", F.md5(F.concat_ws("|", F.col("rows_").cast("string"), "country")))


@query("""WITH e AS (SELECT user_id, event_type, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM e)
    SELECT user_id, sum(new) AS sessions, count(*) AS events, round(sum(value) + 1e-9, 4) AS value FROM s GROUP BY user_id""")
def run_rollup(spark, sf_dir):
    """Runs by session window with their totals."""
    e = read(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), r4(F.sum("v")).alias("value"))

"""Weekly facts: overview, gaps, silent channels, comparable specifications, focus lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import OWN_BRAND, observations, over_obs
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)
WEEK = "CAST(date_trunc('week', obs_date) AS DATE)"
week = lambda c="obs_date": F.to_date(F.date_trunc("week", c))


@query(over_obs(f""", f AS (SELECT product_id, country, min(obs_date) AS d FROM obs GROUP BY ALL), n AS (SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(DISTINCT product_id) AS new_products FROM f GROUP BY ALL)
    SELECT w.*, coalesce(new_products, 0) AS new_products FROM (SELECT {WEEK} AS week, count(*) AS obs, count(DISTINCT product_id) AS products, count(DISTINCT channel_id) AS channels, count(DISTINCT country) AS countries, count(CASE WHEN audit_status = 'pending' THEN 1 END) AS pending,
      count(CASE WHEN brand = '{OWN_BRAND}' THEN 1 END) AS own_obs, round(avg(discount_pct) + 1e-9, 4) AS avg_discount FROM obs GROUP BY ALL) w LEFT JOIN n ON n.week = w.week"""))
def weekly_overview(spark, sf_dir):
    obs = observations(spark, sf_dir)
    new = obs.groupBy("product_id", "country").agg(F.min("obs_date").alias("d")).groupBy(week("d").alias("week")).agg(F.countDistinct("product_id").alias("new_products"))
    w = obs.groupBy(week().alias("week")).agg(
        F.count("*").alias("obs"), F.countDistinct("product_id").alias("products"), F.countDistinct("channel_id").alias("channels"), F.countDistinct("country").alias("countries"),
        F.count(F.when(F.col("audit_status") == "pending", 1)).alias("pending"), F.count(F.when(F.col("brand") == OWN_BRAND, 1)).alias("own_obs"), r4(F.avg("discount_pct")).alias("avg_discount"),
    )
    return w.join(new, "week", "left").withColumn("new_products", F.coalesce("new_products", F.lit(0)))


@query(over_obs(""", m AS (SELECT max(obs_date) AS m FROM obs), s AS (SELECT unnest(generate_series(CAST(m - INTERVAL 29 DAY AS TIMESTAMP), CAST(m AS TIMESTAMP), INTERVAL 1 DAY))::DATE AS day FROM m)
    SELECT c.country, s.day FROM (SELECT DISTINCT country FROM obs) c CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.country = c.country AND o.obs_date = s.day)"""))
def weekly_gaps(spark, sf_dir, days=30):
    """Countries' days without an observation in the last 30: an anti join from the full calendar."""
    obs = observations(spark, sf_dir)
    axis = obs.agg(F.max("obs_date").alias("m")).select(F.explode(F.sequence(F.date_sub("m", days - 1), "m")).alias("day"))
    grid = obs.select("country").distinct().crossJoin(F.broadcast(axis))
    return grid.join(observations(spark, sf_dir, days).select("country", F.col("obs_date").alias("day")), ["country", "day"], "left_anti")


@query(over_obs(""" SELECT channel_id, country, max(obs_date) AS last_seen, CAST(date_diff('day', max(obs_date), (SELECT max(obs_date) FROM obs)) AS INTEGER) AS silent_days FROM obs GROUP BY channel_id, country HAVING max(obs_date) <= (SELECT max(obs_date) FROM obs) - INTERVAL 7 DAY"""))
def silent_channels(spark, sf_dir, days=7):
    obs = observations(spark, sf_dir)
    now = F.broadcast(obs.agg(F.max("obs_date").alias("m")))
    g = obs.groupBy("channel_id", "country").agg(F.max("obs_date").alias("last_seen")).crossJoin(now)
    return g.where(F.col("last_seen") <= F.date_sub("m", days)).select("channel_id", "country", "last_seen", F.datediff("m", "last_seen").alias("silent_days"))


@query(over_obs(f""", w AS (SELECT product_id, country, currency, {WEEK} AS week, count(DISTINCT obs_date) AS days FROM obs GROUP BY ALL)
    SELECT product_id, country, currency, count(*) AS weeks, sum(days) AS days, count(CASE WHEN days >= 2 THEN 1 END) AS comparable_weeks FROM w GROUP BY product_id, country, currency HAVING count(*) >= 2"""))
def comparable_skus(spark, sf_dir):
    w = observations(spark, sf_dir).groupBy("product_id", "country", "currency", week().alias("week")).agg(F.countDistinct("obs_date").alias("days"))
    return w.groupBy("product_id", "country", "currency").agg(F.count("*").alias("weeks"), F.sum("days").alias("days"), F.count(F.when(F.col("days") >= 2, 1)).alias("comparable_weeks")).where("weeks >= 2")


@query(over_obs(""" SELECT DISTINCT country, category FROM obs WHERE obs_date <= (SELECT max(obs_date) FROM obs) - INTERVAL 30 DAY EXCEPT SELECT country, category FROM obs WHERE obs_date > (SELECT max(obs_date) FROM obs) - INTERVAL 30 DAY"""))
def lost_pairs(spark, sf_dir, days=30):
    """Country and category pairs seen before, not in the window."""
    obs = observations(spark, sf_dir)
    return obs.select("country", "category").distinct().join(observations(spark, sf_dir, days).select("country", "category"), ["country", "category"], "left_anti")


@query(over_obs(""", g AS (SELECT country, category, count(*) AS obs, count(DISTINCT obs_date) AS days, count(DISTINCT product_id) AS products FROM obs WHERE obs_date > (SELECT max(obs_date) FROM obs) - INTERVAL 30 DAY GROUP BY ALL)
    SELECT c.country, k.category, coalesce(obs, 0) AS obs, coalesce(days, 0) AS days, coalesce(products, 0) AS products FROM (SELECT DISTINCT country FROM obs) c CROSS JOIN (SELECT DISTINCT category FROM obs) k LEFT JOIN g ON g.country = c.country AND g.category = k.category"""))
def coverage30(spark, sf_dir, days=30):
    """Coverage of the last 30 days over the full grid, empty cells included."""
    obs = observations(spark, sf_dir)
    g = observations(spark, sf_dir, days).groupBy("country", "category").agg(F.count("*").alias("obs"), F.countDistinct("obs_date").alias("days"), F.countDistinct("product_id").alias("products"))
    grid = obs.select("country").distinct().crossJoin(F.broadcast(obs.select("category").distinct()))
    return grid.join(g, ["country", "category"], "left").na.fill(0, ["obs", "days", "products"])


@query(over_obs(""", t AS (SELECT country, category, currency, product_id, count(*) AS n, median(sale_price) AS mid FROM obs WHERE obs_date > (SELECT max(obs_date) FROM obs) - INTERVAL 365 DAY GROUP BY ALL)
    SELECT country, category, product_id, n, round(mid + 1e-9, 4) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY country, category, currency ORDER BY n DESC, product_id) AS r FROM t) WHERE r <= 3"""))
def top_products(spark, sf_dir, each=3):
    t = observations(spark, sf_dir, 365).groupBy("country", "category", "currency", "product_id").agg(F.count("*").alias("n"), F.median("sale_price").alias("mid"))
    w = Window.partitionBy("country", "category", "currency").orderBy(F.desc("n"), "product_id")
    return t.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("country", "category", "product_id", "n", r4(F.col("mid")).alias("mid"))


@query(over_obs(""", f AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN obs_date > m - INTERVAL 90 DAY THEN 0 ELSE 1 END, CASE WHEN obs_date > m - INTERVAL 90 DAY THEN -discount_pct ELSE 0 END, obs_date DESC, sale_price, channel_id) AS r FROM obs, (SELECT max(obs_date) AS m FROM obs) WHERE discount_pct > 0)
    SELECT product_id, country, obs_date, round(discount_pct + 1e-9, 4) AS discount_pct FROM f WHERE r = 1"""))
def focus_list(spark, sf_dir, days=90):
    """A product's deepest cut within the period, else its latest."""
    obs = observations(spark, sf_dir)
    rows = obs.crossJoin(F.broadcast(obs.agg(F.max("obs_date").alias("m")))).where("discount_pct > 0").withColumn("inside", F.col("obs_date") > F.date_sub("m", days))
    w = Window.partitionBy("product_id").orderBy(F.desc("inside"), F.when(F.col("inside"), -F.col("discount_pct")).otherwise(0.0), F.desc("obs_date"), "sale_price", "channel_id")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("product_id", "country", "obs_date", r4(F.col("discount_pct")).alias("discount_pct"))

"""Boards over observations: price bands, discount heat, seller spread, matrices, trends, promotions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators.quantiles import at_ranks, interpolated
from ..sources.tables import OWN_BRAND, observations, over_obs, read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)
CLEAN = "product_kind = 'device' AND condition = 'new' AND is_bundle = 0"
OFFICIAL = "seller_kind IN ('self_operated', 'brand_official')"


@query(
    over_obs(f""", clean AS (SELECT * FROM obs WHERE {CLEAN} AND audit_status = 'accepted' AND obs_date > (SELECT max(obs_date) FROM obs) - INTERVAL 720 DAY),
    band AS (SELECT currency, category, brand, count(*) AS n, quantile_cont(sale_price, 0.25) AS p25, quantile_cont(sale_price, 0.5) AS p50, quantile_cont(sale_price, 0.75) AS p75 FROM clean GROUP BY ALL HAVING count(*) >= 5),
    market AS (SELECT currency, category, median(sale_price) AS mid FROM clean GROUP BY ALL)
    SELECT currency, category, brand, n, round(p25 + 1e-9, 4) AS p25, round(p50 + 1e-9, 4) AS p50, round(p75 + 1e-9, 4) AS p75, brand <> '{OWN_BRAND}' AND p50 < 0.15 * mid AS suspect
    FROM band JOIN market USING (currency, category)""")
)
def price_band(spark, sf_dir, days=720, min_n=5):
    """Quartiles of clean prices for each brand, one currency at a time; a brand far under its market's median is suspect, our own never."""
    clean = observations(spark, sf_dir, days).where(flt.clean_device() & flt.audited())
    band = interpolated(clean, ["currency", "category", "brand"], "sale_price", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).where(F.col("n") >= min_n)
    market = interpolated(clean, ["currency", "category"], "sale_price", {"mid": 0.5}).drop("n")
    return band.join(market, ["currency", "category"]).select(
        "currency", "category", "brand", "n", r4(F.col("p25")).alias("p25"), r4(F.col("p50")).alias("p50"), r4(F.col("p75")).alias("p75"),
        ((F.col("brand") != OWN_BRAND) & (F.col("p50") < 0.15 * F.col("mid"))).alias("suspect"),
    )


@query(
    over_obs(""", cells AS (SELECT country, category, count(*) AS n, avg(discount_pct) AS d FROM obs WHERE product_kind <> 'accessory' AND audit_status = 'accepted' AND obs_date > (SELECT max(obs_date) FROM obs) - INTERVAL 180 DAY GROUP BY ALL),
    centre AS (SELECT sum(d * n) / sum(n) AS c FROM cells)
    SELECT c.country, k.category, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN round(d + 1e-9, 4) END AS avg_discount, round((SELECT c FROM centre) + 1e-9, 4) AS centre
    FROM (SELECT DISTINCT country FROM obs) c CROSS JOIN (SELECT DISTINCT category FROM obs) k LEFT JOIN cells ON cells.country = c.country AND cells.category = k.category""")
)
def discount_heat(spark, sf_dir, days=180, min_n=5):
    """Mean discount on the dense country x category grid; a thin cell is null, not zero. The centre uses the cells' own filter."""
    obs = observations(spark, sf_dir)
    rows = observations(spark, sf_dir, days).where(flt.not_accessory() & flt.audited())
    cells = rows.groupBy("country", "category").agg(F.count("*").alias("n"), F.avg("discount_pct").alias("d"))
    # 25 countries and a closed list of categories: both sides of the grid have a fixed size.
    grid = obs.select("country").distinct().crossJoin(F.broadcast(obs.select("category").distinct()))
    centre = cells.agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("c"))
    out = grid.join(cells, ["country", "category"], "left").crossJoin(F.broadcast(centre))
    return out.select("country", "category", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= min_n, r4(F.col("d"))).alias("avg_discount"), r4(F.col("c")).alias("centre"))


@query(
    over_obs(f""" SELECT product_id, country, currency, ram_gb, rom_gb, round(min(CASE WHEN {OFFICIAL} THEN sale_price END) + 1e-9, 4) AS official, round(min(CASE WHEN seller_kind = 'third_party' THEN sale_price END) + 1e-9, 4) AS third,
    round(min(CASE WHEN {OFFICIAL} THEN sale_price END) - min(CASE WHEN seller_kind = 'third_party' THEN sale_price END) + 1e-9, 4) AS gap
    FROM obs WHERE {CLEAN} AND audit_status = 'accepted' GROUP BY product_id, country, currency, ram_gb, rom_gb
    HAVING count(CASE WHEN {OFFICIAL} THEN 1 END) > 0 AND count(CASE WHEN seller_kind = 'third_party' THEN 1 END) > 0""")
)
def seller_spread(spark, sf_dir):
    """Lowest official against lowest third-party price of a specification, where both exist."""
    best = observations(spark, sf_dir).where(flt.clean_device() & flt.audited()).groupBy("product_id", "country", "currency", "ram_gb", "rom_gb").agg(
        F.min(F.when(flt.official(), F.col("sale_price"))).alias("o"), F.min(F.when(F.col("seller_kind") == "third_party", F.col("sale_price"))).alias("t")
    )
    both = best.where("o is not null and t is not null")
    return both.select("product_id", "country", "currency", "ram_gb", "rom_gb", r4(F.col("o")).alias("official"), r4(F.col("t")).alias("third"), r4(F.col("o") - F.col("t")).alias("gap"))


def _matrix_sql(grain: str) -> str:
    return over_obs(f""", base AS (SELECT CAST(date_trunc('{grain}', obs_date) AS DATE) AS period, * FROM obs WHERE product_kind <> 'accessory' AND obs_date > (SELECT max(obs_date) FROM obs) - INTERVAL 90 DAY),
    acc AS (SELECT period, country, category, count(*) AS obs, count(DISTINCT product_id) AS products, count(DISTINCT channel_id) AS channels, avg(CASE WHEN discount_pct > 0 THEN discount_pct END) AS d,
      sum(CASE WHEN discount_pct > 0 THEN 1 ELSE 0 END) AS promos, sum(CASE WHEN {OFFICIAL} THEN 1 ELSE 0 END) AS officials FROM base WHERE audit_status = 'accepted' GROUP BY ALL),
    pend AS (SELECT period, country, category, count(*) AS pending FROM base WHERE audit_status = 'pending' GROUP BY ALL),
    fresh AS (SELECT CAST(date_trunc('{grain}', d) AS DATE) AS period, country, category, count(*) AS new_products FROM (SELECT product_id, country, category, min(obs_date) AS d FROM obs WHERE product_kind <> 'accessory' GROUP BY ALL) GROUP BY ALL)
    SELECT coalesce(a.period, p.period) AS period, coalesce(a.country, p.country) AS country, coalesce(a.category, p.category) AS category, coalesce(a.obs, 0) AS obs, coalesce(a.products, 0) AS products, coalesce(a.channels, 0) AS channels,
      round(a.d + 1e-9, 4) AS avg_discount, coalesce(a.promos, 0) AS promos, coalesce(a.officials, 0) AS officials, coalesce(p.pending, 0) AS pending, coalesce(f.new_products, 0) AS new_products
    FROM acc a FULL OUTER JOIN pend p ON a.period = p.period AND a.country = p.country AND a.category = p.category
    LEFT JOIN fresh f ON f.period = coalesce(a.period, p.period) AND f.country = coalesce(a.country, p.country) AND f.category = coalesce(a.category, p.category)""")


def dashboard_matrix(spark, sf_dir, grain, days=90):
    """Period x country x category: accepted and pending counts meet in a full outer join, so a cell with pending rows only is shown. First sightings are taken before the window."""
    all_rows = observations(spark, sf_dir).where(flt.not_accessory())
    key = ["period", "country", "category"]
    period = lambda c: F.to_date(F.date_trunc(grain, c)).alias("period")
    base = observations(spark, sf_dir, days).where(flt.not_accessory()).withColumn("period", period("obs_date"))
    promo = F.col("discount_pct") > 0
    acc = base.where(flt.audited()).groupBy(*key).agg(
        F.count("*").alias("obs"), F.countDistinct("product_id").alias("products"), F.countDistinct("channel_id").alias("channels"), F.avg(F.when(promo, F.col("discount_pct"))).alias("d"),
        F.sum(promo.cast("int")).alias("promos"), F.sum(flt.official().cast("int")).alias("officials"),
    )
    pending = base.where("audit_status = 'pending'").groupBy(*key).agg(F.count("*").alias("pending"))
    fresh = all_rows.groupBy("product_id", "country", "category").agg(F.min("obs_date").alias("d0")).groupBy(period("d0"), "country", "category").agg(F.count("*").alias("new_products"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = acc.join(pending, key, "full_outer").join(fresh, key, "left")
    return out.select(*key, zero("obs"), zero("products"), zero("channels"), r4(F.col("d")).alias("avg_discount"), zero("promos"), zero("officials"), zero("pending"), zero("new_products"))


@query(_matrix_sql("day"))
def dashboard_matrix_day(spark, sf_dir):
    return dashboard_matrix(spark, sf_dir, "day")


@query(_matrix_sql("week"))
def dashboard_matrix_week(spark, sf_dir):
    return dashboard_matrix(spark, sf_dir, "week")


@query(_matrix_sql("month"))
def dashboard_matrix_month(spark, sf_dir):
    return dashboard_matrix(spark, sf_dir, "month")


@query(
    over_obs(f""", g AS (SELECT * FROM obs WHERE product_kind <> 'accessory' AND audit_status = 'accepted' AND obs_date > (SELECT max(obs_date) FROM obs) - INTERVAL 365 DAY)
    SELECT country, category, count(*) AS obs, count(DISTINCT brand) AS brands, count(DISTINCT product_id) AS products, round(median(sale_price) + 1e-9, 4) AS median_price, round(sum(CASE WHEN {OFFICIAL} THEN 1.0 ELSE 0.0 END) / count(*) + 1e-9, 4) AS official_share, max(obs_date) AS last_seen
    FROM g GROUP BY ALL""")
)
def country_category_summary(spark, sf_dir, days=365):
    rows = observations(spark, sf_dir, days).where(flt.not_accessory() & flt.audited())
    g = rows.groupBy("country", "category").agg(
        F.count("*").alias("obs"), F.countDistinct("brand").alias("brands"), F.countDistinct("product_id").alias("products"),
        r4(F.sum(flt.official().cast("double")) / F.count("*")).alias("official_share"), F.max("obs_date").alias("last_seen"),
    )
    mid = interpolated(rows, ["country", "category"], "sale_price", {"mid": 0.5}).select(F.col("country").alias("c"), F.col("category").alias("k"), r4(F.col("mid")).alias("median_price"))
    return g.join(mid, F.col("country").eqNullSafe(F.col("c")) & F.col("category").eqNullSafe(F.col("k")), "left").drop("c", "k")


@query(
    over_obs(""", daily AS (SELECT product_id, country, currency, obs_date, min(sale_price) AS lo, max(sale_price) AS hi, count(*) AS n FROM obs WHERE audit_status <> 'rejected' AND product_kind <> 'accessory' GROUP BY ALL)
    SELECT product_id, country, currency, count(*) AS days, sum(n) AS obs, round(arg_min(lo, obs_date) + 1e-9, 4) AS first_price, round(arg_max(lo, obs_date) + 1e-9, 4) AS last_price, round(min(lo) + 1e-9, 4) AS lowest, round(max(hi) + 1e-9, 4) AS highest,
      CASE WHEN count(*) > 1 THEN round((arg_max(lo, obs_date) - arg_min(lo, obs_date)) / nullif(arg_min(lo, obs_date), 0) * 100 + 1e-9, 4) END AS change_pct
    FROM daily GROUP BY product_id, country, currency""")
)
def price_trend_lines(spark, sf_dir):
    """A line per product, country and currency from daily lows; change needs two days."""
    daily = observations(spark, sf_dir).where(flt.audited("not_rejected") & flt.not_accessory()).groupBy("product_id", "country", "currency", "obs_date").agg(
        F.min("sale_price").alias("lo"), F.max("sale_price").alias("hi"), F.count("*").alias("n")
    )
    first, last = F.min_by("lo", "obs_date"), F.max_by("lo", "obs_date")
    return daily.groupBy("product_id", "country", "currency").agg(
        F.count("*").alias("days"), F.sum("n").alias("obs"), r4(first).alias("first_price"), r4(last).alias("last_price"), r4(F.min("lo")).alias("lowest"), r4(F.max("hi")).alias("highest"),
        F.when(F.count("*") > 1, r4(F.try_divide(last - first, first) * 100)).alias("change_pct"),
    )


@query(
    over_obs(""" SELECT product_id, count(DISTINCT obs_date) AS days, count(DISTINCT country) AS countries, count(DISTINCT channel_id) AS channels FROM obs WHERE audit_status = 'accepted'
    GROUP BY product_id HAVING count(DISTINCT obs_date) >= 2 ORDER BY days DESC, countries DESC, channels DESC, product_id LIMIT 50""")
)
def trackable_products(spark, sf_dir, limit=50):
    """The report of products best suited to tracking."""
    return observations(spark, sf_dir).where(flt.audited()).groupBy("product_id").agg(
        F.countDistinct("obs_date").alias("days"), F.countDistinct("country").alias("countries"), F.countDistinct("channel_id").alias("channels")
    ).where("days >= 2").orderBy(F.desc("days"), F.desc("countries"), F.desc("channels"), "product_id").limit(limit)


_PROMO = """, w AS (SELECT *, obs_date > m - INTERVAL 360 DAY AS is_after FROM obs, (SELECT max(obs_date) AS m FROM obs) WHERE obs_date > m - INTERVAL 720 DAY AND product_kind = 'device' AND condition = 'new' AND is_bundle = 0 AND audit_status = 'accepted'),
    u AS (SELECT brand, currency, product_id, avg(CASE WHEN NOT is_after THEN CAST(discount_pct > 5 AS INTEGER) END) AS b, avg(CASE WHEN is_after THEN CAST(discount_pct > 5 AS INTEGER) END) AS a FROM w GROUP BY ALL)"""


@query(
    over_obs(
        _PROMO
        + """ SELECT brand, currency, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS basket, round(avg(a) - avg(b) + 1e-9, 4) AS raw_delta,
    CASE WHEN count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) >= 12 THEN round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a - b END) + 1e-9, 4) END AS matched_delta FROM u GROUP BY brand, currency"""
    )
)
def promo_shrink(spark, sf_dir, half=360, min_basket=12):
    """Share of promoted products before and after, raw and over the basket seen in both halves: what differs between the two is composition."""
    obs = observations(spark, sf_dir)
    now = obs.agg(F.max("obs_date").alias("m"))
    rows = obs.crossJoin(F.broadcast(now)).where((F.col("obs_date") > F.date_sub("m", 2 * half)) & flt.clean_device() & flt.audited()).withColumn("after", F.col("obs_date") > F.date_sub("m", half))
    promoted = (F.col("discount_pct") > 5).cast("int")
    u = rows.groupBy("brand", "currency", "product_id").agg(F.avg(F.when(~F.col("after"), promoted)).alias("b"), F.avg(F.when(F.col("after"), promoted)).alias("a"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    n = F.count(F.when(both, 1))
    return u.groupBy("brand", "currency").agg(n.alias("basket"), r4(F.avg("a") - F.avg("b")).alias("raw_delta"), F.when(n >= min_basket, r4(F.avg(F.when(both, F.col("a") - F.col("b"))))).alias("matched_delta"))


@query(
    over_obs(""" SELECT country, channel_id, product_id, obs_date, round(sale_price + 1e-9, 4) AS sale_price FROM (
    SELECT *, rank() OVER (PARTITION BY country, channel_id, product_id ORDER BY obs_date DESC) AS r FROM obs WHERE audit_status <> 'rejected') WHERE r = 1""")
)
def current_price(spark, sf_dir):
    """The latest observation of each country, channel and product; ties stay."""
    w = Window.partitionBy("country", "channel_id", "product_id").orderBy(F.desc("obs_date"))
    rows = observations(spark, sf_dir).where(flt.audited("not_rejected")).withColumn("r", F.rank().over(w)).where("r = 1")
    return rows.select("country", "channel_id", "product_id", "obs_date", r4(F.col("sale_price")).alias("sale_price"))


_RANKED = """, f AS (SELECT currency, category, sale_price FROM obs WHERE product_kind = 'device' AND audit_status = 'accepted'),
    q AS (SELECT *, row_number() OVER (PARTITION BY currency, category ORDER BY sale_price) AS rn, count(*) OVER (PARTITION BY currency, category) AS n FROM f)"""


@query(
    over_obs(
        _RANKED
        + """ SELECT currency, category, max(n) AS n, round(avg(CASE WHEN rn IN ((n + 1) // 2, (n + 2) // 2) THEN sale_price END) + 1e-9, 4) AS median, round(max(CASE WHEN rn = (n + 3) // 4 THEN sale_price END) + 1e-9, 4) AS p25, round(max(CASE WHEN rn = (3 * n + 3) // 4 THEN sale_price END) + 1e-9, 4) AS p75 FROM q GROUP BY currency, category"""
    )
)
def promo_board_quantiles(spark, sf_dir):
    """Quantiles by integer rank (the median is the mean of the middle, quartiles are elements): not the interpolated ones of the price band."""
    q = observations(spark, sf_dir).where((F.col("product_kind") == "device") & flt.audited()).select("currency", "category", "sale_price")
    out = at_ranks(q, ["currency", "category"], "sale_price", {"lo": "(n + 1) div 2", "hi": "(n + 2) div 2", "a": "(n + 3) div 4", "b": "(3 * n + 3) div 4"})
    return out.select("currency", "category", "n", r4((F.col("lo") + F.col("hi")) / 2).alias("median"), r4(F.col("a")).alias("p25"), r4(F.col("b")).alias("p75"))


@query(
    over_obs(""" SELECT rom_gb, currency, count(*) AS n, round(list_sort(list(sale_price))[least(CAST(floor(count(*) * 0.05) AS BIGINT) + 1, count(*))] + 1e-9, 4) AS p5, round(list_sort(list(sale_price))[least(CAST(floor(count(*) * 0.5) AS BIGINT) + 1, count(*))] + 1e-9, 4) AS p50 FROM obs WHERE product_kind = 'device' GROUP BY rom_gb, currency""")
)
def price_by_storage(spark, sf_dir):
    """Quantiles by floor index, the third definition, for before/after comparisons of repairs."""
    q = observations(spark, sf_dir).where("product_kind = 'device'").select("rom_gb", "currency", "sale_price")
    out = at_ranks(q, ["rom_gb", "currency"], "sale_price", {"p5": "least(floor(n * 0.05D) + 1, n)", "p50": "least(floor(n * 0.5D) + 1, n)"})
    return out.select("rom_gb", "currency", "n", r4(F.col("p5")).alias("p5"), r4(F.col("p50")).alias("p50"))


@query(over_obs(""" SELECT country, category, audit_status, count(*) AS n FROM obs WHERE product_kind = 'device' GROUP BY GROUPING SETS ((country, audit_status), (category, audit_status))"""))
def blocked_counts(spark, sf_dir):
    """How many rows the audit gate lets through and blocks, by country and by category, from the board's own filter."""
    rows = observations(spark, sf_dir).where("product_kind = 'device'")
    return rows.groupingSets([["country", "audit_status"], ["category", "audit_status"]], "country", "category", "audit_status").agg(F.count("*").alias("n"))

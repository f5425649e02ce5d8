"""Price moves: as-of change detection, tiers, histograms, rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.price import TIER_BANDS, move_tier
from ..operators import filters as flt
from ..operators.asof import daily_prices, price_changes
from ..operators.quantiles import interpolated
from ..sources.tables import observations, over_obs
from .identity import IDENT_SQL, identified_parts
from .registry import query

KEYS = ["product_id", "country", "currency", "brand", "category"]
r4 = lambda c: F.round(c + 1e-9, 4)

MOVES = """, daily AS (SELECT product_id, country, currency, brand, category, obs_date, coalesce(min(CASE WHEN seller_kind IN ('self_operated', 'brand_official') THEN sale_price END), min(sale_price)) AS price,
      CAST(max(CASE WHEN seller_kind IN ('self_operated', 'brand_official') THEN 1 ELSE 0 END) AS INTEGER) AS is_official
      FROM obs WHERE product_kind <> 'accessory' AND coalesce(price_scope, 'public') <> 'card' AND audit_status <> 'rejected' AND is_bundle = 0 GROUP BY ALL),
    lagged AS (SELECT *, lag(price) OVER w AS prev_price, lag(obs_date) OVER w AS prev_date FROM daily WINDOW w AS (PARTITION BY product_id, country, currency, brand, category ORDER BY obs_date)),
    moves AS (SELECT *, price AS curr_price, date_diff('day', prev_date, obs_date) AS days_span, (price - prev_price) / prev_price * 100 AS change_pct FROM lagged
      WHERE date_diff('day', prev_date, obs_date) <= 400 AND prev_price > 0 AND abs((price - prev_price) / prev_price * 100) >= 2)"""


def moves(spark, sf_dir, lookback=400, noise_pct=2.0):
    return price_changes(daily_prices(observations(spark, sf_dir), KEYS), KEYS, lookback, noise_pct)


@query(over_obs(MOVES + " SELECT product_id, country, currency, obs_date AS move_date, prev_date, round(prev_price + 1e-9, 4) AS prev_price, round(curr_price + 1e-9, 4) AS curr_price, round(change_pct + 1e-9, 4) AS change_pct, CAST(days_span AS INTEGER) AS days_span, is_official FROM moves"))
def price_moves(spark, sf_dir):
    """Change detection: the latest earlier day in the same currency, within the lookback, beyond 2 percent."""
    return moves(spark, sf_dir).select("product_id", "country", "currency", F.col("obs_date").alias("move_date"), "prev_date", r4(F.col("prev_price")).alias("prev_price"), r4(F.col("curr_price")).alias("curr_price"), r4(F.col("change_pct")).alias("change_pct"), "days_span", "is_official")


@query(over_obs(MOVES + ", " + IDENT_SQL.removeprefix("WITH ") + """ SELECT m.country, count(*) AS n, count(DISTINCT m.product_id) AS products, round(min(change_pct) + 1e-9, 4) AS deepest FROM moves m JOIN ident i ON i.p_partkey = m.product_id
    WHERE NOT i.is_bucket AND (m.category = i.category OR i.category IS NULL) AND abs(round(change_pct, 2) - (round(curr_price, 2) - round(prev_price, 2)) / nullif(round(prev_price, 2), 0) * 100) <= 0.01 GROUP BY m.country"""))
def sound_moves(spark, sf_dir):
    """Moves of single products in their own category whose shown percentage agrees with their two shown prices.

    Shown is the double that is nearest to a hundred times the value, rounded: a decimal's own digits would be rounded otherwise at halves.
    """
    cents = lambda c: F.round(F.col(c) * 100) / 100
    shown = moves(spark, sf_dir).select("product_id", "country", "category", "change_pct", *[cents(c).alias(c) for c in ("curr_price", "prev_price")])
    own = identified_parts(spark, sf_dir).select(F.col("p_partkey").alias("product_id"), F.col("category").alias("own_category"), F.col("is_bucket").cast("int").alias("is_bucket"))
    rows = shown.join(own, "product_id").where(flt.not_bucket() & flt.same_category("category", "own_category"))
    sound = rows.withColumn("exact", F.col("change_pct")).withColumn("change_pct", cents("change_pct")).where(flt.self_consistent(0.01))
    return sound.groupBy("country").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("products"), r4(F.min("exact")).alias("deepest"))


@query(
    over_obs(""", d AS (SELECT product_id, currency, ram_gb, rom_gb, obs_date, min(sale_price) AS price FROM obs GROUP BY ALL)
    SELECT product_id, currency, ram_gb, rom_gb, obs_date, round(price + 1e-9, 4) AS price, round(lag(price) OVER (PARTITION BY product_id, currency, ram_gb, rom_gb ORDER BY obs_date) + 1e-9, 4) AS prev_price FROM d""")
)
def price_moves_null_safe(spark, sf_dir):
    """The previous price with unknown specifications as a value of their own (window keys are null-safe)."""
    d = observations(spark, sf_dir).groupBy("product_id", "currency", "ram_gb", "rom_gb", "obs_date").agg(F.min("sale_price").alias("price"))
    w = Window.partitionBy("product_id", "currency", "ram_gb", "rom_gb").orderBy("obs_date")
    return d.select("product_id", "currency", "ram_gb", "rom_gb", "obs_date", r4(F.col("price")).alias("price"), r4(F.lag("price").over(w)).alias("prev_price"))


#: The bands by category of the test tables, whose categories stand for phones, wearables and audio.
BANDS = {"ECONOMY": TIER_BANDS["phone"], "SMALL": TIER_BANDS["wearable"], "PROMO": TIER_BANDS["audio"]}


def tier():
    """Credibility of a move by its category's bands."""
    return move_tier(F.col("change_pct"), F.col("category"), BANDS)


TIER = "CASE WHEN abs(change_pct) < CASE category WHEN 'ECONOMY' THEN 8 WHEN 'SMALL' THEN 12 WHEN 'PROMO' THEN 15 ELSE 10 END THEN 'credible' WHEN abs(change_pct) < CASE category WHEN 'ECONOMY' THEN 20 WHEN 'SMALL' THEN 30 WHEN 'PROMO' THEN 40 ELSE 25 END THEN 'suspect' ELSE 'implausible' END"


@query(
    over_obs(MOVES + f""" SELECT category, currency, {TIER} AS tier, CASE WHEN change_pct < 0 THEN 'down' ELSE 'up' END AS direction, count(*) AS n, round(avg(change_pct) + 1e-9, 4) AS avg_pct, count(DISTINCT product_id) AS products FROM moves GROUP BY ALL""")
)
def moves_tiered(spark, sf_dir):
    rows = moves(spark, sf_dir).withColumn("tier", tier()).withColumn("direction", F.when(F.col("change_pct") < 0, "down").otherwise("up"))
    return rows.groupBy("category", "currency", "tier", "direction").agg(F.count("*").alias("n"), r4(F.avg("change_pct")).alias("avg_pct"), F.countDistinct("product_id").alias("products"))


@query(
    over_obs(MOVES + """ SELECT country, CASE WHEN abs(change_pct) < 5 THEN '02-05' WHEN abs(change_pct) < 10 THEN '05-10' WHEN abs(change_pct) < 20 THEN '10-20' WHEN abs(change_pct) < 30 THEN '20-30' WHEN abs(change_pct) < 50 THEN '30-50' ELSE '50+' END AS bin,
    count(CASE WHEN change_pct < 0 THEN 1 END) AS down, count(CASE WHEN change_pct > 0 THEN 1 END) AS up FROM moves GROUP BY ALL""")
)
def moves_histogram(spark, sf_dir):
    a = F.abs("change_pct")
    edges = ((5, "02-05"), (10, "05-10"), (20, "10-20"), (30, "20-30"), (50, "30-50"))
    bin_ = F.when(a < edges[0][0], edges[0][1])
    for top, name in edges[1:]:
        bin_ = bin_.when(a < top, name)
    return moves(spark, sf_dir).groupBy("country", bin_.otherwise("50+").alias("bin")).agg(F.count(F.when(F.col("change_pct") < 0, 1)).alias("down"), F.count(F.when(F.col("change_pct") > 0, 1)).alias("up"))


@query(over_obs(MOVES + f" SELECT product_id, country, currency, obs_date, round(change_pct + 1e-9, 4) AS change_pct FROM moves WHERE {TIER} = 'credible' ORDER BY abs(change_pct) DESC, product_id, country, currency, obs_date LIMIT 100"))
def movers_topk(spark, sf_dir, limit=100):
    """The report of the largest credible moves."""
    top = moves(spark, sf_dir).where(tier() == "credible").orderBy(F.desc(F.abs("change_pct")), "product_id", "country", "currency", "obs_date").limit(limit)
    return top.select("product_id", "country", "currency", "obs_date", r4(F.col("change_pct")).alias("change_pct"))


@query(
    over_obs(MOVES + """ SELECT brand, obs_date, count(*) AS n, count(DISTINCT product_id) AS products, count(DISTINCT country) AS countries, string_agg(DISTINCT country, ',' ORDER BY country) AS where_, round(avg(change_pct) + 1e-9, 4) AS avg_pct
    FROM moves WHERE change_pct < 0 GROUP BY brand, obs_date HAVING count(DISTINCT product_id) >= 2""")
)
def brand_cluster(spark, sf_dir):
    """Days on which a brand cut several products at once."""
    rows = moves(spark, sf_dir).where("change_pct < 0").groupBy("brand", "obs_date").agg(
        F.count("*").alias("n"), F.countDistinct("product_id").alias("products"), F.countDistinct("country").alias("countries"), F.array_join(F.sort_array(F.collect_set("country")), ",").alias("where_"), r4(F.avg("change_pct")).alias("avg_pct")
    )
    return rows.where("products >= 2")


@query(over_obs(MOVES + " SELECT category, CAST(date_trunc('month', obs_date) AS DATE) AS month, count(DISTINCT brand) AS brands, count(*) AS cuts, round(median(change_pct) + 1e-9, 4) AS median_cut FROM moves WHERE change_pct < 0 GROUP BY ALL HAVING count(DISTINCT brand) >= 3"))
def category_war(spark, sf_dir):
    rows = moves(spark, sf_dir).where("change_pct < 0").select("category", F.to_date(F.date_trunc("month", "obs_date")).alias("month"), "brand", "change_pct")
    war = rows.groupBy("category", "month").agg(F.countDistinct("brand").alias("brands")).where("brands >= 3")
    mid = interpolated(rows, ["category", "month"], "change_pct", {"mid": 0.5})
    return mid.join(war, ["category", "month"]).select("category", "month", "brands", F.col("n").alias("cuts"), r4(F.col("mid")).alias("median_cut"))


@query(
    over_obs(MOVES + """, s AS (SELECT *, 10 * least(abs(change_pct), 60) * CASE WHEN brand = 'Brand#1' THEN 2.5 ELSE 1 END * CASE WHEN is_official = 1 THEN 1.5 ELSE 1 END * CASE WHEN days_span <= 30 THEN 1.3 ELSE 1 END AS score FROM moves WHERE change_pct BETWEEN -60 AND 40)
    SELECT product_id, country, currency, obs_date, round(score + 1e-9, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY score DESC, product_id, currency, obs_date) AS r FROM s) WHERE r <= 5""")
)
def move_importance(spark, sf_dir, per_country=5):
    """Importance: size (capped) times matched, official and fresh boosts; moves beyond the hard bounds drop out. Best few of each country."""
    boost = lambda c, x: F.when(c, x).otherwise(1)
    score = 10 * F.least(F.abs("change_pct"), F.lit(60)) * boost(F.col("brand") == "Brand#1", 2.5) * boost(F.col("is_official") == 1, 1.5) * boost(F.col("days_span") <= 30, 1.3)
    rows = moves(spark, sf_dir).where("change_pct between -60 and 40").withColumn("score", score)
    w = Window.partitionBy("country").orderBy(F.desc("score"), "product_id", "currency", "obs_date")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_country).select("product_id", "country", "currency", "obs_date", r4(F.col("score")).alias("score"))


@query(
    over_obs(MOVES + """, nxt AS (SELECT *, lead(price) OVER w AS next_price, lead(obs_date) OVER w AS next_date FROM lagged WINDOW w AS (PARTITION BY product_id, country, currency, brand, category ORDER BY obs_date))
    SELECT m.product_id, m.country, m.currency, m.obs_date, CASE WHEN n.next_date IS NULL THEN 'current' WHEN abs(n.next_price - m.prev_price) <= 0.02 * m.prev_price THEN 'reverted' ELSE 'held' END AS verdict, CAST(date_diff('day', m.obs_date, n.next_date) AS INTEGER) AS days
    FROM moves m JOIN nxt n ON m.product_id = n.product_id AND m.country = n.country AND m.currency = n.currency AND m.obs_date = n.obs_date""")
)
def mover_verdict(spark, sf_dir):
    """What became of a move: back within 2 percent of the old price on the next day with data, held until then, or still current."""
    daily = daily_prices(observations(spark, sf_dir), KEYS)
    w = Window.partitionBy(*KEYS).orderBy("obs_date")
    daily = daily.select("*", F.lead("price").over(w).alias("next_price"), F.lead("obs_date").over(w).alias("next_date"))
    m = price_changes(daily, KEYS, 400, 2.0)
    verdict = F.when(F.col("next_date").isNull(), "current").when(F.abs(F.col("next_price") - F.col("prev_price")) <= 0.02 * F.col("prev_price"), "reverted").otherwise("held")
    return m.select("product_id", "country", "currency", "obs_date", verdict.alias("verdict"), F.datediff("next_date", "obs_date").alias("days"))

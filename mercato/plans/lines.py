"""Lines for charts: by category and brand, compared entities, by channel; and projections and filters of text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.price import percent
from ..operators import filters as flt
from ..operators.quantiles import interpolated
from ..sources.tables import observations, over_obs, read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)
MONTH = "CAST(date_trunc('month', obs_date) AS DATE)"
_month = lambda: F.to_date(F.date_trunc("month", "obs_date")).alias("month")


def _line_sql(entity: str) -> str:
    return over_obs(f""", m AS (SELECT {entity}, currency, {MONTH} AS month, median(sale_price) AS p FROM obs WHERE product_kind = 'device' AND audit_status <> 'rejected' GROUP BY ALL)
    SELECT {entity}, currency, month, round(p + 1e-9, 4) AS price, round(100 * p / nullif(first_value(p) OVER (PARTITION BY {entity}, currency ORDER BY month), 0) + 1e-9, 4) AS index_100 FROM m""")


def line(spark, sf_dir, entity: str):
    """Monthly median price of an entity, one currency at a time, and its index against the first month."""
    rows = observations(spark, sf_dir).where((F.col("product_kind") == "device") & flt.audited("not_rejected")).select(entity, "currency", _month(), "sale_price")
    m = interpolated(rows, [entity, "currency", "month"], "sale_price", {"p": 0.5})
    base = F.first("p").over(Window.partitionBy(entity, "currency").orderBy("month"))
    return m.select(entity, "currency", "month", r4(F.col("p")).alias("price"), r4(F.try_divide(100 * F.col("p"), base)).alias("index_100"))


@query(_line_sql("category"))
def category_line(spark, sf_dir):
    return line(spark, sf_dir, "category")


@query(_line_sql("brand"))
def brand_line(spark, sf_dir):
    return line(spark, sf_dir, "brand")


@query(over_obs(f""", e AS (SELECT product_id FROM obs GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 8), m AS (SELECT product_id, currency, {MONTH} AS month, avg(sale_price) AS p, count(*) AS n, count(CASE WHEN audit_status = 'pending' THEN 1 END) AS pending FROM obs WHERE product_id IN (SELECT product_id FROM e) GROUP BY ALL),
    x AS (SELECT count(DISTINCT currency) > 1 AS mixed FROM m) SELECT product_id, currency, month, round(CASE WHEN mixed THEN 100 * p / nullif(first_value(p) OVER (PARTITION BY product_id, currency ORDER BY month), 0) ELSE p END + 1e-9, 4) AS value, mixed AS is_index, round(100.0 * pending / n + 1e-9, 4) AS pending_pct FROM m, x"""))
def compare_lines(spark, sf_dir, most=8):
    """At most eight entities on one axis. Levels of several currencies are never mixed: then every line is an index, and the caller is told.

    The axis begins with the first month that has a value; how much of each point is not audited yet is said beside it.
    """
    obs = observations(spark, sf_dir)
    chosen = F.broadcast(obs.groupBy("product_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product_id").limit(most).select("product_id"))  # eight rows
    m = obs.join(chosen, "product_id", "left_semi").groupBy("product_id", "currency", _month()).agg(F.avg("sale_price").alias("p"), F.count("*").alias("n"), F.count(F.when(F.col("audit_status") == "pending", 1)).alias("pending"))
    mixed = F.broadcast(m.agg((F.countDistinct("currency") > 1).alias("mixed")))
    base = F.first("p").over(Window.partitionBy("product_id", "currency").orderBy("month"))
    value = F.when(F.col("mixed"), F.try_divide(100 * F.col("p"), base)).otherwise(F.col("p"))
    return m.crossJoin(mixed).select("product_id", "currency", "month", r4(value).alias("value"), F.col("mixed").alias("is_index"), r4(100.0 * F.col("pending") / F.col("n")).alias("pending_pct"))


@query(over_obs(""", d AS (SELECT product_id, channel_id, currency, obs_date, min(sale_price) AS p FROM obs WHERE audit_status <> 'rejected' GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY product_id, channel_id, currency) AS points FROM d) SELECT product_id, channel_id, currency, obs_date, round(p + 1e-9, 4) AS price, points FROM k WHERE points >= 2"""))
def channel_lines(spark, sf_dir, least=2):
    """A product's line in each channel; lines of fewer than two real points are left out."""
    d = observations(spark, sf_dir).where(flt.audited("not_rejected")).groupBy("product_id", "channel_id", "currency", "obs_date").agg(F.min("sale_price").alias("p"))
    k = d.withColumn("points", F.count("*").over(Window.partitionBy("product_id", "channel_id", "currency")))
    return k.where(F.col("points") >= least).select("product_id", "channel_id", "currency", "obs_date", r4(F.col("p")).alias("price"), "points")


#: Phrases that make a title no product of its own.
NOT_A_PRODUCT = ("gift card", "spare part", "large bolt", "small bolt", "hot rod", "cold rod")


@query("SELECT p_brand AS brand, count(*) AS n FROM part WHERE NOT (lower(p_name) LIKE '%gift card%' OR lower(p_name) LIKE '%spare part%' OR lower(p_name) LIKE '%large bolt%' OR lower(p_name) LIKE '%small bolt%' OR lower(p_name) LIKE '%hot rod%' OR lower(p_name) LIKE '%cold rod%') GROUP BY p_brand")
def without_phrases(spark, sf_dir):
    """Titles that have none of the phrases: one alternation over the lower-cased title."""
    return read(spark, sf_dir, "part").where(~F.lower("p_name").rlike("|".join(NOT_A_PRODUCT))).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


GRID = ("p_partkey", "p_name", "p_brand", "p_size")


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def grid_rows(spark, sf_dir, asked=("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", "no_such_column")):
    """Only columns that may be edited reach a grid, whatever is asked for."""
    return read(spark, sf_dir, "part").select(*[c for c in asked if c in GRID])


@query("SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT (starts_with(trim(x), '#') OR starts_with(trim(x), '|'))), lambda x: length(trim(x)))), 0) AS BIGINT) AS body_chars FROM documents WHERE text IS NOT NULL")
def body_lengths(spark, sf_dir):
    """Characters of a text without its headings and tables."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    body = F.filter(lines, lambda x: ~(x.startswith("#") | x.startswith("|")))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.aggregate(body, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("body_chars"))


@query(over_obs(" SELECT country, CASE WHEN avg(discount_pct) IS NULL THEN '-' ELSE printf('%+.1f%%', round(avg(discount_pct), 6)) END AS shown FROM obs GROUP BY country"))
def shown_discounts(spark, sf_dir):
    """Mean discounts as a report writes them."""
    return observations(spark, sf_dir).groupBy("country").agg(percent(F.round(F.avg("discount_pct"), 6)).alias("shown"))

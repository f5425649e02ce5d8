"""Calendars and evidence bundles: ISO periods, promotions, day health, coverage, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..sources.tables import OWN_BRAND, observations, over_obs, read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)


def period_columns(day):
    """The fortnight a day belongs to: it ends on the Sunday of an odd ISO week, and its id names that week."""
    monday = F.to_date(F.date_trunc("week", day))
    end = F.when(F.weekofyear(monday) % 2 == 1, F.date_add(monday, 6)).otherwise(F.date_add(monday, 13))
    # A year of 53 weeks has two odd weeks in a row; the second one is a period of its own week's end.
    year = F.year(F.date_sub(end, 3))
    return F.format_string("%d-W%02d", year, F.weekofyear(end)).alias("period"), F.date_sub(end, 13).alias("window_from"), end.alias("window_to")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), m AS (SELECT day, CAST(date_trunc('week', day) AS DATE) AS monday FROM d), e AS (SELECT day, CASE WHEN week(monday) % 2 = 1 THEN monday + 6 ELSE monday + 13 END AS ends FROM m)
    SELECT day, printf('%d-W%02d', isoyear(ends), week(ends)) AS period, CAST(ends - 13 AS DATE) AS window_from, CAST(ends AS DATE) AS window_to FROM e""")
def periods(spark, sf_dir):
    """The reporting period of each day."""
    day = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return day.select("day", *period_columns(F.col("day")))


def windows(day):
    """The current and the previous fortnight up to ``day``: what tokens such as ``cur.start`` stand for."""
    return {"asOf": day, "cur.end": day, "cur.start": F.date_sub(day, 13), "prev.end": F.date_sub(day, 14), "prev.start": F.date_sub(day, 27)}


def token(text: str, day):
    """``cur.start-90d``: a window's edge and days from it. An unknown token is an error."""
    import re

    m = re.fullmatch(r"\$?([A-Za-z.]+?)(?:([+-]\d+)d)?", text)
    if not m or m[1] not in windows(day):
        raise ValueError(f"unknown token {text!r}")
    return F.date_add(windows(day)[m[1]], int(m[2] or 0))


@query(over_obs(""", a AS (SELECT max(obs_date) AS d FROM obs) SELECT country, count(CASE WHEN obs_date BETWEEN d - 13 AND d THEN 1 END) AS cur, count(CASE WHEN obs_date BETWEEN d - 27 AND d - 14 THEN 1 END) AS prev, count(CASE WHEN obs_date >= d - 103 AND obs_date < d - 13 THEN 1 END) AS before FROM obs, a GROUP BY country"""))
def period_counts(spark, sf_dir):
    """Observations of the current and the previous fortnight and of the 90 days before, by window tokens."""
    obs = observations(spark, sf_dir).select("country", "obs_date")
    now = F.broadcast(obs.agg(F.max("obs_date").alias("d")))  # one row
    at = lambda t: token(t, F.col("d"))
    day = F.col("obs_date")
    n = lambda c: F.count(F.when(c, 1))
    return obs.crossJoin(now).groupBy("country").agg(
        n(day.between(at("cur.start"), at("cur.end"))).alias("cur"), n(day.between(at("prev.start"), at("prev.end"))).alias("prev"), n((day >= at("cur.start-90d")) & (day < at("cur.start"))).alias("before")
    )


_CALENDAR = """SELECT n_name AS country, 'national week' AS promo, 1 + n_nationkey % 12 AS m, 1 + n_nationkey % 28 AS d FROM nation UNION ALL SELECT n_name, r_name || ' sale', 1 + (n_regionkey * 5 + 2) % 12, 15 FROM nation JOIN region ON n_regionkey = r_regionkey"""


def promo_days(spark, sf_dir) -> DataFrame:
    """country, promo, m, d: the calendar of promotions, a row for each day of a country. There is no such table, so it is written from nations and regions."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    own = n.select(F.col("n_name").alias("country"), F.lit("national week").alias("promo"), (1 + F.col("n_nationkey") % 12).alias("m"), (1 + F.col("n_nationkey") % 28).alias("d"))
    zone = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.concat("r_name", F.lit(" sale")).alias("promo"), (1 + (F.col("n_regionkey") * 5 + 2) % 12).alias("m"), F.lit(15).alias("d"))
    return own.unionByName(zone)


def promo_calendar(days: DataFrame, years: DataFrame) -> DataFrame:
    """country, promo, promo_day of each year (column y), and the last Friday of November, which is every country's."""
    fixed = days.join(F.broadcast(years)).select("country", "promo", F.make_date("y", "m", "d").alias("promo_day"))  # a calendar's rows: days of a year times years
    end = F.make_date("y", F.lit(11), F.lit(30))
    friday = F.date_sub(end, F.pmod(F.dayofweek(end) - 6, F.lit(7)))
    return fixed.unionByName(days.select("country").distinct().join(F.broadcast(years)).select("country", F.lit("last friday").alias("promo"), friday.alias("promo_day")))


def next_of(days: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """country, day, promo, days_left: the next promotion of a country within ``horizon`` days, or none. Days meet promotions by country and month."""
    months = F.explode(F.sequence(F.trunc(F.date_sub("promo_day", horizon), "month"), F.trunc("promo_day", "month"), F.expr("interval 1 month")))
    near = calendar.select("country", "promo", "promo_day", months.alias("month"))
    both = days.withColumn("month", F.trunc("day", "month")).join(near, ["country", "month"]).where((F.col("promo_day") >= F.col("day")) & (F.col("promo_day") <= F.date_add("day", horizon)))
    first = both.groupBy("country", "day").agg(F.min(F.struct("promo_day", "promo")).alias("x"))
    return days.join(first, ["country", "day"], "left").select("country", "day", F.col("x.promo").alias("promo"), F.datediff("x.promo_day", "day").alias("days_left"))


@query(f"""WITH d AS (SELECT DISTINCT n_name AS country, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), yrs AS (SELECT DISTINCT y FROM (SELECT year(day) AS y FROM d UNION ALL SELECT year(day) + 1 FROM d)),
    c AS (SELECT country, promo, make_date(y, m, d) AS promo_day FROM ({_CALENDAR}) k, yrs UNION ALL SELECT n_name, 'last friday', make_date(y, 11, 30) - CAST((isodow(make_date(y, 11, 30)) + 2) % 7 AS INTEGER) FROM nation, yrs)
    SELECT d.country, day, min_by(promo, CAST(promo_day AS VARCHAR) || promo) AS promo, CAST(min(promo_day) - day AS INTEGER) AS days_left FROM d LEFT JOIN c ON c.country = d.country AND promo_day >= day AND promo_day <= day + 45 GROUP BY d.country, day""")
def next_promo(spark, sf_dir, horizon=45):
    """The next promotion in the country of each day that has orders there, or none within the horizon."""
    home = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"))
    day = read(spark, sf_dir, "orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select("country", F.to_date("o_orderdate").alias("day")).distinct()
    years = day.select(F.explode(F.array(F.year("day"), F.year("day") + 1)).alias("y")).distinct()
    return next_of(day, promo_calendar(promo_days(spark, sf_dir), years), horizon)


@query(over_obs(" SELECT count(*) AS n_rows, count(DISTINCT obs_date) AS days, min(obs_date) AS first_day, max(obs_date) AS last_day, count(DISTINCT country) AS countries FROM obs"))
def bundle_meta(spark, sf_dir):
    """What a data pack says about its source."""
    return observations(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct("obs_date").alias("days"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.countDistinct("country").alias("countries"))


@query(over_obs(""", g AS (SELECT obs_date, count(*) AS n, count(DISTINCT channel_id) AS channels FROM obs GROUP BY obs_date) SELECT obs_date, n, channels, round(n / avg(n) OVER (ORDER BY obs_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) + 1e-9, 4) AS against_week FROM g"""))
def day_health(spark, sf_dir):
    """Rows of a day against the mean of the seven days with data before it. Days are one row each: the window is a calendar's length."""
    g = observations(spark, sf_dir).groupBy("obs_date").agg(F.count("*").alias("n"), F.countDistinct("channel_id").alias("channels"))
    before = F.avg("n").over(Window.orderBy("obs_date").rowsBetween(-7, -1))
    return g.select("obs_date", "n", "channels", r4(F.try_divide("n", before)).alias("against_week"))


_FLOOR = "CASE currency WHEN 'ASIA' THEN 300 WHEN 'EUROPE' THEN 500 ELSE 100 END"


@query(over_obs(f""", k AS (SELECT * FROM obs WHERE sale_price >= {_FLOOR} AND NOT (lower(title) LIKE '%bolt%' OR lower(title) LIKE '%rod%'))
    SELECT country, category, count(DISTINCT product_id) AS products, count(DISTINCT channel_id) AS channels, count(*) AS n FROM k GROUP BY ALL"""))
def bundle_coverage(spark, sf_dir, floors=(("ASIA", 300), ("EUROPE", 500)), otherwise=100, words=("bolt", "rod")):
    """Coverage above each currency's price floor, without titles that have one of the words: one alternation, not a chain of patterns."""
    floor = F.coalesce(*[F.when(F.col("currency") == c, F.lit(v)) for c, v in floors], F.lit(otherwise))
    rows = observations(spark, sf_dir).where((F.col("sale_price") >= floor) & ~F.lower("title").rlike("|".join(words)))
    return rows.groupBy("country", "category").agg(F.countDistinct("product_id").alias("products"), F.countDistinct("channel_id").alias("channels"), F.count("*").alias("n"))


@query("""SELECT p_brand AS brand, p_type AS category, count(*) AS models, min(p_name) AS first_name, round(avg(p_retailprice) + 1e-9, 4) AS mean_price FROM part GROUP BY ALL""")
def model_catalog(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("category")).agg(F.count("*").alias("models"), F.min("p_name").alias("first_name"), r4(F.avg("p_retailprice")).alias("mean_price"))


@query(over_obs(""", m AS (SELECT max(obs_date) AS d FROM obs) SELECT country, count(DISTINCT obs_date) AS days, count(DISTINCT product_id) AS products FROM obs, m WHERE obs_date <= d - 90 GROUP BY country"""))
def coverage_before(spark, sf_dir, days=90):
    """Days and products seen before the window: what a first sighting in it can be measured against."""
    obs = observations(spark, sf_dir)
    now = F.broadcast(obs.agg(F.max("obs_date").alias("d")))
    return obs.crossJoin(now).where(F.col("obs_date") <= F.date_sub("d", days)).groupBy("country").agg(F.countDistinct("obs_date").alias("days"), F.countDistinct("product_id").alias("products"))


@query(over_obs(""" SELECT country, count(*) AS n, round(100.0 * count(CASE WHEN ram_gb IS NULL THEN 1 END) / count(*) + 1e-9, 4) AS no_ram, round(100.0 * count(CASE WHEN audit_status = 'pending' THEN 1 END) / count(*) + 1e-9, 4) AS pending, round(100.0 * count(CASE WHEN price_scope IS NULL THEN 1 END) / count(*) + 1e-9, 4) AS no_scope, max(obs_date) AS last_day FROM obs GROUP BY country"""))
def data_health(spark, sf_dir):
    share = lambda c: r4(100.0 * F.count(F.when(c, 1)) / F.count("*"))
    return observations(spark, sf_dir).groupBy("country").agg(F.count("*").alias("n"), share(F.col("ram_gb").isNull()).alias("no_ram"), share(F.col("audit_status") == "pending").alias("pending"), share(F.col("price_scope").isNull()).alias("no_scope"), F.max("obs_date").alias("last_day"))


@query(over_obs(f""", f AS (SELECT product_id, min(obs_date) AS d FROM obs GROUP BY 1), m AS (SELECT max(obs_date) AS d FROM obs) SELECT o.country, count(DISTINCT o.product_id) AS products, count(DISTINCT CASE WHEN f.d <= m.d - 90 THEN o.product_id END) AS seen_before
    FROM obs o JOIN f ON f.product_id = o.product_id, m WHERE o.obs_date > m.d - 90 AND o.brand <> '{OWN_BRAND}' GROUP BY o.country"""))
def seen_before(spark, sf_dir, days=90):
    """Products of the last days that were seen before them: a first day joined by equality, not a search through the past."""
    obs = observations(spark, sf_dir)
    first = obs.groupBy("product_id").agg(F.min("obs_date").alias("first_day"))
    rows = observations(spark, sf_dir, days).where(F.col("brand") != OWN_BRAND).select("country", "product_id").distinct().join(first, "product_id")
    now = F.broadcast(obs.agg(F.max("obs_date").alias("d")))
    old = F.when(F.col("first_day") <= F.date_sub("d", days), F.col("product_id"))
    return rows.crossJoin(now).groupBy("country").agg(F.countDistinct("product_id").alias("products"), F.countDistinct(old).alias("seen_before"))

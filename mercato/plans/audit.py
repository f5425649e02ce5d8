"""Price audit: monthly baselines, category floors, the verdict ladder, rehearsal counters, trimming reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.price import rom_bucket
from ..operators import filters as flt
from ..operators.quantiles import interpolated
from ..sources.tables import observations, over_obs
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)
MONTH = "CAST(date_trunc('month', obs_date) AS DATE)"
BASE = f""", base AS (SELECT country, product_id, rom_gb, {MONTH} AS month, median(sale_price) AS base, count(*) AS n FROM obs WHERE product_kind = 'device' AND audit_status <> 'rejected' GROUP BY ALL HAVING count(*) >= 2),
    fl AS (SELECT country, category, currency, CASE WHEN count(CASE WHEN audit_status = 'accepted' THEN 1 END) >= 30 THEN median(CASE WHEN audit_status = 'accepted' THEN sale_price END) WHEN count(*) >= 30 THEN median(sale_price) END AS mid
      FROM obs WHERE product_kind = 'device' AND audit_status <> 'rejected' GROUP BY ALL)"""


def baselines(obs):
    rows = obs.where((F.col("product_kind") == "device") & flt.audited("not_rejected"))
    month = F.to_date(F.date_trunc("month", "obs_date")).alias("month")
    return rows.groupBy("country", "product_id", "rom_gb", month).agg(F.median("sale_price").alias("base"), F.count("*").alias("n")).where("n >= 2")


def floors(obs, least=30):
    rows = obs.where((F.col("product_kind") == "device") & flt.audited("not_rejected"))
    keys = ["country", "category", "currency"]
    every = interpolated(rows, keys, "sale_price", {"all": 0.5})
    ok = interpolated(rows.where(flt.audited()), keys, "sale_price", {"ok": 0.5}).withColumnRenamed("n", "ok_n")
    mid = F.when(F.col("ok_n") >= least, F.col("ok")).when(F.col("n") >= least, F.col("all"))
    return every.join(ok, keys, "left").select(*keys, mid.alias("mid"))


@query(over_obs(BASE + " SELECT country, product_id, rom_gb, month, round(base + 1e-9, 4) AS base, n FROM base"))
def audit_baselines(spark, sf_dir):
    return baselines(observations(spark, sf_dir)).select("country", "product_id", "rom_gb", "month", r4(F.col("base")).alias("base"), "n")


@query(over_obs(BASE + " SELECT country, category, currency, round(mid + 1e-9, 4) AS mid FROM fl"))
def category_floors(spark, sf_dir):
    """The accepted median where there are enough, else the not-rejected one, else none."""
    return floors(observations(spark, sf_dir)).withColumn("mid", r4(F.col("mid")))


VERDICT = "CASE WHEN mid IS NOT NULL AND sale_price < 0.25 * mid THEN 'rejected:floor' WHEN discount_pct > 9 AND seller_kind = 'third_party' THEN 'gray:discount' WHEN base IS NULL THEN 'gray:no_baseline' WHEN abs(sale_price / nullif(base, 0) - 1) <= 0.3 THEN 'accepted' ELSE 'gray:deviation' END"


def verdicts(spark, sf_dir):
    """One pass over pending rows with their month's baseline and their category's floor: hard floor, veto, baseline, deviation."""
    obs = observations(spark, sf_dir)
    rows = obs.where("audit_status = 'pending' and product_kind = 'device'").withColumn("month", F.to_date(F.date_trunc("month", "obs_date")))
    rows = rows.join(baselines(obs).drop("n"), ["country", "product_id", "rom_gb", "month"], "left").join(floors(obs), ["country", "category", "currency"], "left")
    ladder = (
        F.when(F.col("mid").isNotNull() & (F.col("sale_price") < 0.25 * F.col("mid")), "rejected:floor")
        .when((F.col("discount_pct") > 9) & (F.col("seller_kind") == "third_party"), "gray:discount")
        .when(F.col("base").isNull(), "gray:no_baseline")
        .when(F.abs(F.try_divide(F.col("sale_price"), F.col("base")) - 1) <= 0.3, "accepted")
        .otherwise("gray:deviation")
    )
    return rows.withColumn("verdict", ladder)


_V = BASE + f""", v AS (SELECT o.*, {VERDICT} AS verdict FROM obs o LEFT JOIN base b ON o.country = b.country AND o.product_id = b.product_id AND o.rom_gb = b.rom_gb AND {MONTH.replace('obs_date', 'o.obs_date')} = b.month
    LEFT JOIN fl ON fl.country = o.country AND fl.category = o.category AND fl.currency = o.currency WHERE audit_status = 'pending' AND product_kind = 'device')"""


@query(over_obs(_V + " SELECT product_id, country, obs_date, channel_id, round(sale_price + 1e-9, 4) AS sale_price, verdict FROM v"))
def audit_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir).select("product_id", "country", "obs_date", "channel_id", r4(F.col("sale_price")).alias("sale_price"), "verdict")


@query(over_obs(_V + f" SELECT country, {MONTH} AS month, verdict, count(*) AS n FROM v GROUP BY ALL"))
def audit_rehearsal(spark, sf_dir):
    """What a run over the backlog would decide, by country and month."""
    return verdicts(spark, sf_dir).groupBy("country", "month", "verdict").agg(F.count("*").alias("n"))


@query(over_obs(_V + """ SELECT currency, verdict, product_id, round(sale_price + 1e-9, 4) AS sale_price, side FROM (SELECT *, 'low' AS side, row_number() OVER (PARTITION BY currency ORDER BY sale_price, product_id, obs_date, channel_id) AS r FROM v WHERE verdict <> 'accepted'
    UNION ALL SELECT *, 'high', row_number() OVER (PARTITION BY currency ORDER BY sale_price DESC, product_id, obs_date, channel_id) FROM v WHERE verdict <> 'accepted') WHERE r <= 3"""))
def audit_samples(spark, sf_dir, each=3):
    """The cheapest and dearest undecided rows of each currency, for a person to look at."""
    v = verdicts(spark, sf_dir).where("verdict <> 'accepted'")
    rest = ["product_id", "obs_date", "channel_id"]
    out = None
    for side, first in (("low", F.asc("sale_price")), ("high", F.desc("sale_price"))):
        w = Window.partitionBy("currency").orderBy(first, *rest)
        part = v.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("currency", "verdict", "product_id", r4(F.col("sale_price")).alias("sale_price"), F.lit(side).alias("side"))
        out = part if out is None else out.unionByName(part)
    return out


@query(over_obs(""", m AS (SELECT product_id, currency, median(sale_price) AS mid FROM obs GROUP BY ALL)
    SELECT o.product_id, o.currency, count(*) AS n, round(quantile_cont(sale_price, 0.9) / nullif(quantile_cont(sale_price, 0.1), 0) + 1e-9, 4) AS spread, quantile_cont(sale_price, 0.9) / nullif(quantile_cont(sale_price, 0.1), 0) > 3 AND count(*) >= 4 AS is_bucket
    FROM obs o JOIN m USING (product_id, currency) WHERE sale_price >= 0.2 * mid GROUP BY o.product_id, o.currency"""))
def bucket_report(spark, sf_dir):
    """Products that look like several: P90 over P10 after dropping prices under a fifth of the median."""
    obs = observations(spark, sf_dir)
    mid = obs.groupBy("product_id", "currency").agg(F.median("sale_price").alias("mid"))
    rows = obs.join(mid, ["product_id", "currency"]).where("sale_price >= 0.2 * mid")
    q = rows.groupBy("product_id", "currency").agg(F.count("*").alias("n"), F.percentile("sale_price", [0.1, 0.9]).alias("q"))
    spread = F.try_divide(F.col("q")[1], F.col("q")[0])
    return q.select("product_id", "currency", "n", r4(spread).alias("spread"), ((spread > 3) & (F.col("n") >= 4)).alias("is_bucket"))


@query(over_obs(" SELECT CASE WHEN rom_gb IS NULL OR rom_gb <= 0 THEN 'unknown' WHEN rom_gb <= 32 THEN '<=32' WHEN rom_gb <= 64 THEN '<=64' WHEN rom_gb <= 128 THEN '<=128' WHEN rom_gb <= 256 THEN '<=256' WHEN rom_gb <= 512 THEN '<=512' WHEN rom_gb <= 1024 THEN '<=1024' WHEN rom_gb <= 2048 THEN '<=2048' ELSE '>2048' END AS bucket, currency, count(*) AS n, round(min(sale_price) + 1e-9, 4) AS lowest, round(median(sale_price) + 1e-9, 4) AS mid FROM obs GROUP BY ALL"))
def storage_buckets(spark, sf_dir):
    rows = observations(spark, sf_dir).select(rom_bucket(F.col("rom_gb")).alias("bucket"), "currency", "sale_price")
    out = interpolated(rows, ["bucket", "currency"], "sale_price", {"lowest": 0.0, "mid": 0.5})
    return out.select("bucket", "currency", "n", r4(F.col("lowest")).alias("lowest"), r4(F.col("mid")).alias("mid"))

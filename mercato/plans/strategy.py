"""Strategy tracks, successors, candidate signals with capped confidence, spec filling and votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..sources.tables import observations, over_obs, read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)
TRACK = """, d AS (SELECT product_id, country, currency, rom_gb, obs_date, min(sale_price) AS p, count(DISTINCT channel_id) AS ch FROM obs WHERE audit_status = 'accepted' AND product_kind = 'device' GROUP BY ALL),
    t AS (SELECT product_id, country, currency, rom_gb, count(*) AS days, min(obs_date) AS first_day, max(obs_date) AS last_day, arg_min(p, obs_date) AS first_p, arg_max(p, obs_date) AS last_p, max(ch) AS ch FROM d GROUP BY ALL)"""


def tracks(spark, sf_dir):
    """First, last, span and channels of a specification in one aggregation, without joins."""
    d = observations(spark, sf_dir).where(flt.audited() & (F.col("product_kind") == "device")).groupBy("product_id", "country", "currency", "rom_gb", "obs_date").agg(F.min("sale_price").alias("p"), F.countDistinct("channel_id").alias("ch"))
    return d.groupBy("product_id", "country", "currency", "rom_gb").agg(F.count("*").alias("days"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.min_by("p", "obs_date").alias("first_p"), F.max_by("p", "obs_date").alias("last_p"), F.max("ch").alias("ch"))


@query(over_obs(TRACK + " SELECT product_id, country, currency, rom_gb, days, first_day, last_day, round(first_p + 1e-9, 4) AS first_price, round(last_p + 1e-9, 4) AS last_price, round((last_p / nullif(first_p, 0) - 1) * 100 + 1e-9, 4) AS drift_pct, ch AS channels FROM t"))
def strategy_tracks(spark, sf_dir):
    return tracks(spark, sf_dir).select("product_id", "country", "currency", "rom_gb", "days", "first_day", "last_day", r4(F.col("first_p")).alias("first_price"), r4(F.col("last_p")).alias("last_price"), r4((F.try_divide(F.col("last_p"), F.col("first_p")) - 1) * 100).alias("drift_pct"), F.col("ch").alias("channels"))


_CAND = TRACK + """, c AS (SELECT *, CASE WHEN days = 1 AND first_day > (SELECT max(obs_date) FROM obs) - INTERVAL 120 DAY THEN 'launch' WHEN last_p < 0.8 * first_p THEN 'clearance' WHEN last_p < 0.95 * first_p THEN 'erosion' WHEN last_p > 1.05 * first_p THEN 'increase' ELSE 'hold' END AS kind FROM t)"""


@query(over_obs(_CAND + " SELECT product_id, country, currency, rom_gb, kind, CAST(least(0.8, CASE WHEN days < 2 THEN 0.45 ELSE 1 END, CASE WHEN ch < 2 THEN 0.6 ELSE 1 END) AS DOUBLE) AS confidence_cap FROM c"))
def strategy_signals(spark, sf_dir):
    """Candidate kinds by an ordered ladder; confidence is capped by the least of the caps that apply."""
    t, obs = tracks(spark, sf_dir), observations(spark, sf_dir)
    now = F.broadcast(obs.agg(F.max("obs_date").alias("m")))
    kind = (
        F.when((F.col("days") == 1) & (F.col("first_day") > F.date_sub("m", 120)), "launch").when(F.col("last_p") < 0.8 * F.col("first_p"), "clearance")
        .when(F.col("last_p") < 0.95 * F.col("first_p"), "erosion").when(F.col("last_p") > 1.05 * F.col("first_p"), "increase").otherwise("hold")
    )
    cap = F.least(F.lit(0.8), F.when(F.col("days") < 2, 0.45).otherwise(1.0), F.when(F.col("ch") < 2, 0.6).otherwise(1.0))
    return t.crossJoin(now).select("product_id", "country", "currency", "rom_gb", kind.alias("kind"), cap.alias("confidence_cap"))


@query("SELECT a.p_partkey AS old, min(b.p_partkey) AS newer FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name = b.p_name AND b.p_size > a.p_size AND b.p_size <= a.p_size + 2 GROUP BY a.p_partkey")
def newer_generation(spark, sf_dir):
    """The successor within a family, at most two steps on: family members as a window range over the step, not a self-join."""
    p = read(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand", "p_type", "p_name").orderBy("p_size").rangeBetween(1, 2)
    return p.select(F.col("p_partkey").alias("old"), F.min("p_partkey").over(w).alias("newer")).where("newer is not null")


@query(over_obs(""", v AS (SELECT product_id, seller_kind, count(*) AS n, min(obs_date) AS first_day FROM obs GROUP BY ALL) SELECT product_id, seller_kind AS vote, n FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, first_day, seller_kind) AS r FROM v) WHERE r = 1"""))
def majority_vote(spark, sf_dir):
    """The commonest value of a product; ties go to the one seen first, then by name."""
    v = observations(spark, sf_dir).groupBy("product_id", "seller_kind").agg(F.count("*").alias("n"), F.min("obs_date").alias("d"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "d", F.col("seller_kind").alias("k")))
    return v.groupBy("product_id").agg(best.alias("b")).select("product_id", F.col("b.k").alias("vote"), (-F.col("b.m")).alias("n"))


@query(over_obs(""", s AS (SELECT product_id, channel_id, max(ram_gb) AS ram, max(rom_gb) AS rom FROM obs GROUP BY ALL) SELECT p_partkey AS product_id, coalesce(CASE WHEN p_size % 10 <> 0 THEN p_size END, m.ram, 4) AS ram, CASE WHEN p_size % 10 <> 0 THEN 'manual' WHEN m.ram IS NOT NULL THEN 'source' ELSE 'model' END AS spec_source
    FROM part LEFT JOIN (SELECT product_id, max(ram) AS ram FROM s GROUP BY ALL) m ON m.product_id = p_partkey"""))
def spec_fill(spark, sf_dir):
    """A missing specification by precedence: manual, then observed, then a model's guess; where it came from is kept."""
    m = observations(spark, sf_dir).groupBy("product_id").agg(F.max("ram_gb").alias("ram"))
    manual = F.when(F.col("p_size") % 10 != 0, F.col("p_size"))
    rows = read(spark, sf_dir, "part").join(m, F.col("p_partkey") == F.col("product_id"), "left")
    return rows.select(F.col("p_partkey").alias("product_id"), F.coalesce(manual, "ram", F.lit(4)).alias("ram"), F.when(manual.isNotNull(), "manual").when(F.col("ram").isNotNull(), "source").otherwise("model").alias("spec_source"))


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size % 10 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)""")
def spec_queue(spark, sf_dir):
    """Products that miss a specification, were observed and are not done yet: semi and anti joins on pruned columns."""
    li = read(spark, sf_dir, "lineitem")
    p = read(spark, sf_dir, "part").where("p_size % 10 = 0").select("p_partkey", "p_brand")
    p = p.join(li.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return p.join(li.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query(over_obs(""", k AS (SELECT product_id, country, audit_status, count(*) AS n FROM obs GROUP BY ALL) SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.country, b.country) AS country, a.n AS accepted, b.n AS pending,
    CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'stale' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM (SELECT * FROM k WHERE audit_status = 'accepted') a FULL JOIN (SELECT * FROM k WHERE audit_status = 'pending') b ON a.product_id = b.product_id AND a.country = b.country"""))
def before_after(spark, sf_dir):
    """The difference of two states by key, both sides kept."""
    k = observations(spark, sf_dir).groupBy("product_id", "country", "audit_status").count()
    a, b = (k.where(F.col("audit_status") == s).select("product_id", "country", F.col("count").alias(s)) for s in ("accepted", "pending"))
    change = F.when(F.col("accepted").isNull(), "new").when(F.col("pending").isNull(), "stale").when(F.col("accepted") == F.col("pending"), "same").otherwise("changed")
    return a.join(b, ["product_id", "country"], "full_outer").select("product_id", "country", "accepted", "pending", change.alias("change"))

"""Review boards. Documents stand in for reviews: their labels are the sentiment, their ids place them on products and days."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import UI_NOISE, review_reject_reason
from ..sources.tables import read
from .registry import query
from .textual import review_reason_sql

r4 = lambda c: F.round(c + 1e-9, 4)
REV = """WITH rev AS (SELECT d.doc_id AS review_id, d.doc_id % 50 AS product_id, d.doc_id % 7 AS channel_id, d.lang, length(d.text) AS n_chars, CAST('2024-01-01' AS DATE) + CAST(d.doc_id % 400 AS INTEGER) AS review_date,
    CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'neutral' END AS sentiment, d.doc_id % 9 AS aspect, 1 + (d.doc_id % 5) AS rating, d.source AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def reviews(spark, sf_dir):
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    i = F.col("doc_id")
    sent = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral")
    return d.join(lab, "doc_id", "left").select(
        i.alias("review_id"), (i % 50).alias("product_id"), (i % 7).alias("channel_id"), "lang", F.length("text").alias("n_chars"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int")).alias("review_date"),
        sent.alias("sentiment"), (i % 9).alias("aspect"), (1 + i % 5).alias("rating"), "source",
    )


def _is(s):
    return F.count(F.when(F.col("sentiment") == s, 1))


@query(REV + """ SELECT product_id, aspect, count(*) AS mentions, count(CASE WHEN sentiment = 'positive' THEN 1 END) AS pos, count(CASE WHEN sentiment = 'negative' THEN 1 END) AS neg, count(CASE WHEN sentiment = 'neutral' THEN 1 END) AS neutral, count(*) - count(sentiment) AS unknown,
    CASE WHEN count(sentiment) > 0 THEN round(count(CASE WHEN sentiment = 'positive' THEN 1 END) / count(sentiment) + 1e-9, 4) END AS pos_rate FROM rev GROUP BY product_id, aspect""")
def voc_radar(spark, sf_dir):
    """Aspect sentiment; the rate's denominator leaves out what nobody judged."""
    g = reviews(spark, sf_dir).groupBy("product_id", "aspect")
    return g.agg(F.count("*").alias("mentions"), _is("positive").alias("pos"), _is("negative").alias("neg"), _is("neutral").alias("neutral"), (F.count("*") - F.count("sentiment")).alias("unknown"), r4(F.try_divide(_is("positive"), F.count("sentiment"))).alias("pos_rate"))


@query(REV + """, a AS (SELECT product_id, aspect, count(sentiment) AS n, count(CASE WHEN sentiment = 'positive' THEN 1 END) AS pos FROM rev GROUP BY ALL HAVING count(sentiment) >= 2), b AS (SELECT aspect, sum(pos) / sum(n) AS base FROM a GROUP BY aspect)
    SELECT product_id, a.aspect, n, round(pos / n + 1e-9, 4) AS rate, round(base + 1e-9, 4) AS base, round(pos / n - base + 1e-9, 4) AS deviation FROM a JOIN b ON a.aspect = b.aspect""")
def voc_rank(spark, sf_dir, least=2):
    """Each product's rate on an aspect against the mention-weighted mean of all products."""
    a = reviews(spark, sf_dir).groupBy("product_id", "aspect").agg(F.count("sentiment").alias("n"), _is("positive").alias("pos")).where(F.col("n") >= least)
    w = Window.partitionBy("aspect")
    base = F.sum("pos").over(w) / F.sum("n").over(w)
    return a.select("product_id", "aspect", "n", r4(F.col("pos") / F.col("n")).alias("rate"), r4(base).alias("base"), r4(F.col("pos") / F.col("n") - base).alias("deviation"))


@query(REV + """, l AS (SELECT product_id, min(review_date) AS launch FROM rev GROUP BY ALL) SELECT rev.product_id, CAST(date_diff('day', launch, review_date) // 30 AS INTEGER) AS bucket, count(*) AS n, count(*) < 2 AS thin, CASE WHEN count(*) >= 2 THEN round(avg(rating) + 1e-9, 4) END AS rating
    FROM rev JOIN l ON rev.product_id = l.product_id WHERE date_diff('day', launch, review_date) < 360 GROUP BY ALL""")
def voc_decay(spark, sf_dir, bucket_days=30, max_days=360, least=2):
    """Ratings by time since launch; thin buckets are marked and have no mean."""
    rev = reviews(spark, sf_dir)
    age = F.datediff("review_date", F.min("review_date").over(Window.partitionBy("product_id")))
    rows = rev.withColumn("age", age).where(F.col("age") < max_days)
    g = rows.groupBy("product_id", F.floor(F.col("age") / bucket_days).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg("rating").alias("m"))
    return g.select("product_id", "bucket", "n", (F.col("n") < least).alias("thin"), F.when(F.col("n") >= least, r4(F.col("m"))).alias("rating"))


@query(REV + " SELECT source, count(*) AS n, count(sentiment) AS judged, count(CASE WHEN sentiment = 'negative' THEN 1 END) AS neg FROM rev GROUP BY source")
def voc_sentiment_source(spark, sf_dir):
    return reviews(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count("sentiment").alias("judged"), _is("negative").alias("neg"))


@query(REV + """, t AS (SELECT count(*) AS base, count(CASE WHEN n_chars >= 15 THEN 1 END) AS usable, count(sentiment) AS judged, count(CASE WHEN sentiment <> 'neutral' THEN 1 END) AS polar FROM rev)
    SELECT step, n, round(100.0 * n / base + 1e-9, 4) AS pct FROM (SELECT base, unnest(['base', 'usable', 'judged', 'polar']) AS step, unnest([base, usable, judged, polar]) AS n FROM t)""")
def voc_coverage(spark, sf_dir):
    """The funnel from all reviews to judged ones, as shares of the first step."""
    t = reviews(spark, sf_dir).agg(F.count("*").alias("base"), F.count(F.when(F.col("n_chars") >= 15, 1)).alias("usable"), F.count("sentiment").alias("judged"), F.count(F.when(F.col("sentiment") != "neutral", 1)).alias("polar"))
    rows = t.select("base", F.expr("stack(4, 'base', base, 'usable', usable, 'judged', judged, 'polar', polar) as (step, n)"))
    return rows.select("step", "n", r4(100.0 * F.col("n") / F.col("base")).alias("pct"))


@query(REV + """, m AS (SELECT product_id, date_trunc('month', review_date) AS mo, count(*) AS n FROM rev GROUP BY ALL), mm AS (SELECT product_id, max(n) / sum(n) AS share FROM m GROUP BY product_id)
    SELECT rev.product_id, count(*) AS n, round(avg(CASE WHEN rating = 5 THEN 1.0 ELSE 0.0 END) + 1e-9, 4) AS five_share, round(avg(CASE WHEN rating = 1 THEN 1.0 ELSE 0.0 END) + 1e-9, 4) AS one_share, median(n_chars) AS median_len, round(any_value(share) + 1e-9, 4) AS peak_month_share,
    CASE WHEN any_value(share) > 0.5 THEN 'burst' WHEN avg(CASE WHEN rating = 5 THEN 1.0 ELSE 0.0 END) > 0.6 THEN 'praised' WHEN avg(CASE WHEN rating = 1 THEN 1.0 ELSE 0.0 END) > 0.3 THEN 'panned' ELSE 'steady' END AS why
    FROM rev JOIN mm ON rev.product_id = mm.product_id GROUP BY rev.product_id HAVING count(*) >= 5""")
def review_signals(spark, sf_dir):
    """Star shares, typical length, the busiest month's share, and the first rule that explains the volume."""
    rev = reviews(spark, sf_dir)
    m = rev.groupBy("product_id", F.date_trunc("month", "review_date").alias("mo")).count().groupBy("product_id").agg((F.max("count") / F.sum("count")).alias("share"))
    star = lambda k: F.avg((F.col("rating") == k).cast("double"))
    g = rev.groupBy("product_id").agg(F.count("*").alias("n"), star(5).alias("s5"), star(1).alias("s1"), F.median("n_chars").alias("median_len")).where("n >= 5").join(m, "product_id")
    why = F.when(F.col("share") > 0.5, "burst").when(F.col("s5") > 0.6, "praised").when(F.col("s1") > 0.3, "panned").otherwise("steady")
    return g.select("product_id", "n", r4(F.col("s5")).alias("five_share"), r4(F.col("s1")).alias("one_share"), "median_len", r4(F.col("share")).alias("peak_month_share"), why.alias("why"))


@query(REV + " SELECT product_id, count(*) AS n, round(avg(rating) + 1e-9, 4) AS rating, count(CASE WHEN sentiment = 'negative' THEN 1 END) AS neg FROM rev GROUP BY product_id HAVING count(*) >= 5 ORDER BY n DESC, product_id LIMIT 20")
def review_insights(spark, sf_dir, limit=20):
    """The report of the most reviewed products."""
    g = reviews(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("n"), r4(F.avg("rating")).alias("rating"), _is("negative").alias("neg"))
    return g.where("n >= 5").orderBy(F.desc("n"), "product_id").limit(limit)


@query(REV + """, y AS (SELECT product_id, channel_id, count(*) AS reviews, avg(rating) AS price FROM rev GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY reviews DESC, price DESC, product_id) AS rn, avg(reviews) OVER (PARTITION BY channel_id) AS yield FROM y)
    SELECT channel_id, product_id, reviews, rn, round(rn / greatest(0.15, least(2.0, yield / 5)) + 1e-9, 4) AS turn FROM k""")
def review_targets(spark, sf_dir):
    """Yield-weighted round robin: a channel that brings more gets its next product sooner."""
    y = reviews(spark, sf_dir).groupBy("product_id", "channel_id").agg(F.count("*").alias("reviews"), F.avg("rating").alias("price"))
    w = Window.partitionBy("channel_id")
    k = y.select("*", F.row_number().over(w.orderBy(F.desc("reviews"), F.desc("price"), "product_id")).alias("rn"), F.avg("reviews").over(w).alias("yield"))
    return k.select("channel_id", "product_id", "reviews", "rn", r4(F.col("rn") / F.greatest(F.lit(0.15), F.least(F.lit(2.0), F.col("yield") / 5))).alias("turn"))


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT conv_id, count(*) AS turns, count(*) <> max(turn) + 1 OR min(turn) <> 0 OR count(DISTINCT turn) <> count(*) AS suspect, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS answer_chars FROM c GROUP BY conv_id""")
def suspect_batches(spark, sf_dir):
    """Batches whose returned positions are not 0 to n - 1."""
    c = read(spark, sf_dir, "conversations")
    n, t = F.count("*"), F.col("turn")
    return c.groupBy("conv_id").agg(n.alias("turns"), ((n != F.max(t) + 1) | (F.min(t) != 0) | (F.countDistinct(t) != n)).alias("suspect"), F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("answer_chars"))


_TRIAGE = f"CASE WHEN reason IN ({', '.join(repr(r) for r in UI_NOISE)}) THEN 'delete' WHEN reason = 'too_short' THEN 'short' WHEN reason = 'not_language' THEN 'doubtful' ELSE 'kept' END"


@query(f"SELECT doc_id AS review_id, reason, {_TRIAGE} AS triage FROM ({review_reason_sql('documents', 'doc_id')})")
def dirty_reviews(spark, sf_dir):
    """Every stored review in one of four classes. Only what is certainly a page's own text is to be deleted."""
    reason = F.col("reason")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), review_reject_reason(F.col("text")).alias("reason"))
    return rows.withColumn("triage", F.when(reason.isin(*UI_NOISE), "delete").when(reason == "too_short", "short").when(reason == "not_language", "doubtful").otherwise("kept"))

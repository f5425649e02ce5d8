"""News, chat and brief queries. Documents stand in for news items: their source is the brand, their language the country, their id the day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import event_kind
from ..operators import filters as flt
from ..operators.fields import matched
from ..operators.quantiles import interpolated
from ..sources.tables import OWN_BRAND, observations, over_obs, read
from .boards import OFFICIAL
from .matching import CANDIDATES, by_field, candidates, positions
from .moves import MOVES, moves
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)
NEWS = """WITH news AS (SELECT doc_id, source AS brand, lang AS country, CASE WHEN doc_id % 5 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) END AS published, DATE '2024-01-01' + CAST(doc_id % 60 + 1 AS INTEGER) AS created, n_chars % 10 AS importance, ['price', 'launch', 'store', 'ad'][CAST(1 + doc_id % 4 AS INTEGER)] AS action FROM documents)"""


def news(spark, sf_dir):
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    action = F.element_at(F.array(*map(F.lit, ("price", "launch", "store", "ad"))), (1 + i % 4).cast("int"))
    return d.select("doc_id", F.col("source").alias("brand"), F.col("lang").alias("country"), F.when(i % 5 != 0, day(i % 60)).alias("published"), day(i % 60 + 1).alias("created"), (F.col("n_chars") % 10).alias("importance"), action.alias("action"))


@query(NEWS + " SELECT brand, count(*) AS items, count(DISTINCT country) AS countries FROM news GROUP BY brand ORDER BY items DESC, brand LIMIT 6")
def tracked_brands(spark, sf_dir, cap=6):
    """The report of the brands with most presence."""
    return news(spark, sf_dir).groupBy("brand").agg(F.count("*").alias("items"), F.countDistinct("country").alias("countries")).orderBy(F.desc("items"), "brand").limit(cap)


@query("SELECT user_id AS step, round(CAST(epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) AS DOUBLE) / 3600 + 1e-9, 2) AS hours FROM events WHERE event_type = 'view' GROUP BY user_id")
def hours_since_fetch(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    g = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("step")).agg(F.max("ts").alias("last"))
    return g.crossJoin(now).select("step", F.round(F.timestamp_diff("MICROSECOND", F.col("last"), F.col("now")) / 1e6 / 3600 + 1e-9, 2).alias("hours"))


@query(NEWS + ", m AS (SELECT max(coalesce(published, created)) AS d FROM news) SELECT brand, count(*) AS pool, max(importance) AS top FROM news, m WHERE coalesce(published, created) > d - 14 GROUP BY brand")
def news_window(spark, sf_dir, days=14):
    """The pool of the last days: the day of publication, or of arrival where that is unknown."""
    n = news(spark, sf_dir).withColumn("day", F.coalesce("published", "created"))
    return flt.recent(n, days, "day").groupBy("brand").agg(F.count("*").alias("pool"), F.max("importance").alias("top"))


@query(NEWS + """, g AS (SELECT brand, country, action, count(*) AS n, max(importance) AS top FROM news GROUP BY ALL) SELECT brand, country, action, n, top, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY top DESC, n DESC, country NULLS LAST, action) AS r FROM g) WHERE r <= 3""")
def brand_actions(spark, sf_dir, each=3):
    """A brand's actions by importance, then by how often they were told."""
    g = news(spark, sf_dir).groupBy("brand", "country", "action").agg(F.count("*").alias("n"), F.max("importance").alias("top"))
    w = Window.partitionBy("brand").orderBy(F.desc("top"), F.desc("n"), F.asc_nulls_last("country"), "action")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each)


@query(over_obs(MOVES + " SELECT brand, count(*) AS moves, count(CASE WHEN change_pct < 0 THEN 1 END) AS cuts, round(avg(CASE WHEN change_pct < 0 AND is_official = 1 THEN change_pct END) + 1e-9, 4) AS official_cut FROM moves GROUP BY brand"))
def price_context(spark, sf_dir):
    m = moves(spark, sf_dir)
    cut = F.col("change_pct") < 0
    return m.groupBy("brand").agg(F.count("*").alias("moves"), F.count(F.when(cut, 1)).alias("cuts"), r4(F.avg(F.when(cut & (F.col("is_official") == 1), F.col("change_pct")))).alias("official_cut"))


SAID = """WITH said AS (SELECT p_partkey, p_brand, p_name, n_name, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' cuts prices in ' || n_name WHEN 1 THEN p_brand || ' opens a store' WHEN 2 THEN 'Prices fall in ' || n_name ELSE '' END AS text, p_partkey % 4 AS k FROM part JOIN nation ON n_nationkey = p_partkey % 25)"""


def _said(spark, sf_dir):
    p, n = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    k = F.col("p_partkey") % 4
    told = F.when(k == 0, F.concat("p_brand", F.lit(" cuts prices in "), "n_name")).when(k == 1, F.concat("p_brand", F.lit(" opens a store"))).when(k == 2, F.concat(F.lit("Prices fall in "), "n_name")).otherwise("")
    return p.join(F.broadcast(n), F.col("n_nationkey") == F.col("p_partkey") % 25).select("p_partkey", "p_brand", "p_name", "n_name", told.alias("text"))


@query(SAID + " SELECT p_partkey, ['accepted', 'no_place', 'no_brand', 'empty'][k + 1] AS verdict FROM said")
def news_gate(spark, sf_dir):
    """An extracted item needs its brand and its place in the source text; the first reason against it counts."""
    low = F.lower("text")
    verdict = F.when(F.length("text") == 0, "empty").when(~low.contains(F.lower("p_brand")), "no_brand").when(~low.contains(F.lower("n_name")), "no_place").otherwise("accepted")
    return _said(spark, sf_dir).select("p_partkey", verdict.alias("verdict"))


@query(SAID + " SELECT n_name AS country, count(*) AS n FROM said WHERE k IN (0, 2) GROUP BY n_name")
def countries_named(spark, sf_dir):
    """The countries that a text names as whole words: the text's words are looked up, so the list may grow."""
    names = F.broadcast(read(spark, sf_dir, "nation").select(F.col("n_name").alias("country")))  # 25 countries
    words = _said(spark, sf_dir).select("p_partkey", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))).alias("country"))
    return words.join(names, "country").groupBy("country").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ab cd' ELSE s_name || '|' || 'Shop ' || CAST(s_suppkey AS VARCHAR) || '|Market' END AS query FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0""")
def search_aliases(spark, sf_dir):
    """The first three names of three characters and more by which a source is searched."""
    names = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("a"), F.lit("bc"), F.col("s_name"))).otherwise(F.array(F.col("s_name"), F.lit("x"), F.concat(F.lit("Shop "), F.col("s_suppkey").cast("string")), F.lit("Market"), F.lit("Fourth")))
    kept = F.slice(F.filter(names, lambda x: F.length(x) >= 3), 1, 3)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(kept, "|").alias("query"))


@query(over_obs(""", c AS (SELECT channel_id, country, count(*) AS n, max(obs_date) AS last_day FROM obs GROUP BY ALL) SELECT country, channel_id, n, last_day FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, channel_id) AS r FROM c) WHERE r <= 8"""))
def bot_channels(spark, sf_dir, each=8):
    """Channels of a country by what they bring. Counted before anything is joined, so nothing fans out."""
    c = observations(spark, sf_dir).groupBy("channel_id", "country").agg(F.count("*").alias("n"), F.max("obs_date").alias("last_day"))
    w = Window.partitionBy("country").orderBy(F.desc("n"), "channel_id")
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("country", "channel_id", "n", "last_day")


@query(over_obs(""", l AS (SELECT title, country, currency, min(sale_price) AS lowest, max(obs_date) AS last_day FROM obs WHERE title ILIKE '%widget%' GROUP BY ALL) SELECT title, country, currency, round(lowest + 1e-9, 4) AS lowest, last_day FROM l ORDER BY lowest, title, country LIMIT 25"""))
def bot_prices(spark, sf_dir, keyword="widget", limit=25):
    g = observations(spark, sf_dir).where(flt.contains_any_case("title", keyword)).groupBy("title", "country", "currency").agg(F.min("sale_price").alias("lowest"), F.max("obs_date").alias("last_day"))
    return g.orderBy("lowest", "title", "country").limit(limit).withColumn("lowest", r4(F.col("lowest")))


@query(over_obs(f""", f AS (SELECT product_id, min(obs_date) AS first_day FROM obs GROUP BY 1), o AS (SELECT product_id, count(*) AS n, count(DISTINCT country) AS countries FROM obs WHERE brand = '{OWN_BRAND}' GROUP BY 1)
    SELECT p_partkey AS product_id, p_name AS name, coalesce(o.n, 0) AS n, coalesce(o.countries, 0) AS countries, f.first_day FROM part LEFT JOIN o ON o.product_id = p_partkey LEFT JOIN f ON f.product_id = p_partkey WHERE p_brand = '{OWN_BRAND}'"""))
def own_products(spark, sf_dir):
    """Own products with their counts, each counted on its own before the join."""
    obs = observations(spark, sf_dir)
    g = obs.where(F.col("brand") == OWN_BRAND).groupBy("product_id").agg(F.count("*").alias("n"), F.countDistinct("country").alias("countries"), F.min("obs_date").alias("first_day"))
    p = read(spark, sf_dir, "part").where(F.col("p_brand") == OWN_BRAND).select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    return p.join(g, "product_id", "left").select("product_id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("countries", F.lit(0)).alias("countries"), "first_day")


@query(over_obs(", f AS (SELECT product_id, brand, min(obs_date) AS first_day FROM obs GROUP BY ALL) SELECT product_id, brand, first_day FROM f WHERE first_day > (SELECT max(obs_date) FROM obs) - 200 ORDER BY first_day DESC, product_id LIMIT 30"))
def new_launches(spark, sf_dir, days=200, limit=30):
    f = observations(spark, sf_dir).groupBy("product_id", "brand").agg(F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"))
    now = F.broadcast(f.agg(F.max("last_day").alias("m")))
    return f.crossJoin(now).where(F.col("first_day") > F.date_sub("m", days)).orderBy(F.desc("first_day"), "product_id").limit(limit).select("product_id", "brand", "first_day")


@query(over_obs(MOVES + f""", s AS (SELECT 'new' AS section, country, count(*) AS n FROM (SELECT product_id, country, min(obs_date) AS d FROM obs GROUP BY ALL) WHERE d > (SELECT max(obs_date) FROM obs) - 90 GROUP BY country UNION ALL SELECT 'cuts', country, count(*) FROM moves WHERE change_pct < 0 GROUP BY country
    UNION ALL SELECT 'official', country, count(*) FROM obs WHERE {OFFICIAL} GROUP BY country) SELECT section, string_agg(country || ' ' || n, ', ' ORDER BY n DESC, country) AS line FROM s GROUP BY section"""))
def daily_brief(spark, sf_dir):
    """A line of text for each section of the brief; a section has a row for each of the 25 countries at most."""
    obs = observations(spark, sf_dir)
    n = F.count("*").alias("n")
    first = obs.groupBy("product_id", "country").agg(F.min("obs_date").alias("d"), F.max("obs_date").alias("last_day"))
    now = F.broadcast(first.agg(F.max("last_day").alias("m")))
    fresh = first.crossJoin(now).where(F.col("d") > F.date_sub("m", 90)).groupBy("country").agg(n)
    cuts = moves(spark, sf_dir).where("change_pct < 0").groupBy("country").agg(n)
    own = obs.where(flt.official()).groupBy("country").agg(n)
    rows = fresh.withColumn("section", F.lit("new")).unionByName(cuts.withColumn("section", F.lit("cuts"))).unionByName(own.withColumn("section", F.lit("official")))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "country")))
    return rows.groupBy("section").agg(F.array_join(F.transform(lines, lambda x: F.concat(x["country"], F.lit(" "), (-x["m"]).cast("string"))), ", ").alias("line"))


@query(over_obs(CANDIDATES + """, f AS (SELECT mine, country, any_value(my_price) AS p, median(rival_price) AS m FROM pr GROUP BY mine, country) SELECT country, count(CASE WHEN p > 1.05 * m THEN 1 END) AS dearer, count(CASE WHEN p < 0.95 * m THEN 1 END) AS cheaper, count(*) AS products FROM f GROUP BY country"""))
def deviation_mix(spark, sf_dir):
    """How many own products are dearer or cheaper than their field, by country."""
    f = positions(spark, sf_dir).select("country", F.col("my_price").alias("p"), F.col("field").alias("m"))
    n = lambda c: F.count(F.when(c, 1))
    return f.groupBy("country").agg(n(F.col("p") > 1.05 * F.col("m")).alias("dearer"), n(F.col("p") < 0.95 * F.col("m")).alias("cheaper"), F.count("*").alias("products"))


@query(over_obs(CANDIDATES + MOVES + """, k AS (SELECT DISTINCT rival AS product_id, country FROM tt WHERE total >= 0.6) SELECT product_id, country, obs_date, round(change_pct + 1e-9, 4) AS change_pct FROM moves m SEMI JOIN k USING (product_id, country) ORDER BY abs(round(change_pct, 6)) DESC, product_id, country, obs_date LIMIT 4"""))
def weekly_alerts(spark, sf_dir, most=4):
    """The report's few moves that hit own matches: a semi join before the top is taken."""

    def read(f):
        return [f.rival["id"][matched(f, 0.6)], f.cell[0]]

    k = by_field(candidates(spark, sf_dir), read, "product_id long, country string")
    hit = moves(spark, sf_dir).join(k, ["product_id", "country"], "left_semi")
    return hit.orderBy(F.desc(F.abs(F.round("change_pct", 6))), "product_id", "country", "obs_date").limit(most).select("product_id", "country", "obs_date", r4(F.col("change_pct")).alias("change_pct"))


@query(NEWS + ", m AS (SELECT max(created) AS d FROM news) SELECT action, country, count(*) AS n, max(created) AS last_day FROM news, m WHERE action IN ('price', 'launch') AND created > d - 30 GROUP BY action, country")
def market_events(spark, sf_dir, days=30, tags=("price", "launch")):
    n = news(spark, sf_dir)
    return flt.recent(n, days, "created").where(F.col("action").isin(*tags)).groupBy("action", "country").agg(F.count("*").alias("n"), F.max("created").alias("last_day"))


@query(over_obs(MOVES + " SELECT country, CASE WHEN count(CASE WHEN change_pct < 0 THEN 1 END) > 1.2 * count(CASE WHEN change_pct > 0 THEN 1 END) THEN 'prices fall' WHEN count(CASE WHEN change_pct > 0 THEN 1 END) > 1.2 * count(CASE WHEN change_pct < 0 THEN 1 END) THEN 'prices rise' ELSE 'mixed' END AS headline FROM moves GROUP BY country"))
def headlines(spark, sf_dir):
    """A headline by rule, where no model wrote one."""
    down, up = (F.count(F.when(c, 1)) for c in (F.col("change_pct") < 0, F.col("change_pct") > 0))
    return moves(spark, sf_dir).groupBy("country").agg(F.when(down > 1.2 * up, "prices fall").when(up > 1.2 * down, "prices rise").otherwise("mixed").alias("headline"))


@query("""WITH v AS (SELECT p_brand, p_name, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL), w AS (SELECT p_brand, p_name, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY n DESC, f) AS r FROM v) WHERE r = 1) SELECT p.p_partkey, p.p_type AS was, w.p_type AS voted, p.p_type <> w.p_type AS dropped FROM part p JOIN w ON w.p_brand = p.p_brand AND w.p_name = p.p_name""")
def category_follows_vote(spark, sf_dir):
    """A product's category follows its model's vote; what was derived from another category is dropped."""
    p = read(spark, sf_dir, "part")
    v = p.groupBy("p_brand", "p_name", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("f"))
    w = v.groupBy("p_brand", "p_name").agg(F.min_by("p_type", F.struct((-F.col("n")).alias("m"), "f")).alias("voted"))
    return p.join(w, ["p_brand", "p_name"]).select("p_partkey", F.col("p_type").alias("was"), "voted", (F.col("p_type") != F.col("voted")).alias("dropped"))


@query(over_obs(""", fl AS (SELECT category, currency, median(sale_price) AS mid FROM obs WHERE audit_status = 'accepted' GROUP BY ALL) SELECT o.product_id, o.obs_date, o.channel_id, CASE WHEN sale_price < 0.25 * mid THEN 'rejected' ELSE 'accepted' END AS verdict FROM obs o JOIN fl USING (category, currency) WHERE o.audit_status = 'accepted'"""))
def floor_recheck(spark, sf_dir):
    """Accepted rows held against the floor again: they can only be rejected, never the other way round."""
    obs = observations(spark, sf_dir).where(flt.audited())
    fl = interpolated(obs, ["category", "currency"], "sale_price", {"mid": 0.5})
    return obs.join(fl, ["category", "currency"]).select("product_id", "obs_date", "channel_id", F.when(F.col("sale_price") < 0.25 * F.col("mid"), "rejected").otherwise("accepted").alias("verdict"))


@query(over_obs(", d AS (SELECT DISTINCT title, brand FROM obs WHERE obs_date > (SELECT max(obs_date) FROM obs) - 21) SELECT title, count(*) AS brands FROM d GROUP BY title ORDER BY brands DESC, title LIMIT 6"))
def tracked_models(spark, sf_dir, days=21, limit=6):
    """The report of the models that queries are built from."""
    d = observations(spark, sf_dir, days).select("title", "brand").distinct()
    return d.groupBy("title").agg(F.count("*").alias("brands")).orderBy(F.desc("brands"), "title").limit(limit)


@query("""WITH r AS (SELECT doc_id, doc_id % 40 AS url, text, lang FROM documents WHERE length(text) >= 15), u AS (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM r GROUP BY 1), l AS (SELECT doc_id % 40 AS url, max(doc_id) AS product FROM documents GROUP BY 1) SELECT u.doc_id, l.product FROM u JOIN r ON r.doc_id = u.doc_id LEFT JOIN l ON l.url = r.url""")
def review_persist(spark, sf_dir, least=15):
    """Reviews long enough, each text once, linked to the latest product of their page."""
    d = read(spark, sf_dir, "documents").withColumn("url", F.col("doc_id") % 40)
    once = d.where(F.length("text") >= least).groupBy(F.md5("text").alias("h")).agg(F.min_by("url", "doc_id").alias("url"), F.min("doc_id").alias("doc_id"))
    latest = d.groupBy("url").agg(F.max("doc_id").alias("product"))
    return once.join(latest, "url", "left").select("doc_id", "product")


@query("SELECT doc_id % 40 AS url, max(doc_id) AS last_doc, count(*) AS total, count(CASE WHEN n_chars >= 15 THEN 1 END) AS fetched FROM documents GROUP BY 1")
def review_profiles(spark, sf_dir):
    g = read(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("url"))
    return g.agg(F.max("doc_id").alias("last_doc"), F.count("*").alias("total"), F.count(F.when(F.col("n_chars") >= 15, 1)).alias("fetched"))


@query("""WITH q AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL ELSE turn END AS ident, substring(text, 1, 12) AS head, text FROM conversations), c AS (SELECT conv_id, substring(text, 1, 12) AS head, count(*) AS n, min(turn) AS turn FROM conversations GROUP BY ALL)
    SELECT q.conv_id, q.turn, coalesce(q.ident, CASE WHEN c.n = 1 THEN c.turn END) AS found FROM q JOIN c ON c.conv_id = q.conv_id AND c.head = q.head""")
def realigned_results(spark, sf_dir):
    """Results put back by id, else by a text's head if only one text of the batch begins so."""
    c = read(spark, sf_dir, "conversations").withColumn("head", F.substring("text", 1, 12))
    heads = c.groupBy("conv_id", "head").agg(F.count("*").alias("n"), F.min("turn").alias("only"))
    ident = F.when((F.col("conv_id") + F.col("turn")) % 3 != 0, F.col("turn"))
    return c.join(heads, ["conv_id", "head"]).select("conv_id", "turn", F.coalesce(ident, F.when(F.col("n") == 1, F.col("only"))).alias("found"))


#: What reviewers call an aspect, by its code.
ASPECTS = {"battery": "battery", "autonomia": "battery", "camera": "camera", "photo": "camera", "screen": "display", "display": "display", "price": "price"}


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'battery,camera' WHEN 1 THEN 'display' WHEN 2 THEN 'price' ELSE '' END AS aspects FROM part""")
def review_aspects(spark, sf_dir):
    """Aspects by their synonyms, each code once a review, unknown ones left out."""
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.array(*map(F.lit, ("Camera", "autonomia", "photo")))).when(k == 1, F.array(F.lit(" Screen "), F.lit("display"))).when(k == 2, F.array(F.lit("price"), F.lit("smell"))).otherwise(F.array(F.lit("other")))
    codes = F.create_map(*[F.lit(x) for kv in ASPECTS.items() for x in kv])
    named = F.array_sort(F.array_distinct(F.array_compact(F.transform(said, lambda a: F.try_element_at(codes, F.lower(F.trim(a)))))))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(named, ",").alias("aspects"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 120 + p_size WHEN 1 THEN p_size END AS total, CASE p_partkey % 3 WHEN 0 THEN CAST(4.5 AS DOUBLE) END AS rating FROM part""")
def review_totals(spark, sf_dir, sane=1_000_000):
    """The least sane number of reviews that a page tells, and its mean rating."""
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    page = F.when(k == 0, F.concat(F.lit("4.5 out of 5, 99999999 reviews, "), (120 + n).cast("string"), F.lit(" reviews, 5000 reviews"))).when(k == 1, F.concat(n.cast("string"), F.lit(" reviews"))).otherwise("none yet")
    found = F.filter(F.transform(F.regexp_extract_all(page, F.lit("([0-9]+) reviews"), 1), lambda x: x.cast("int")), lambda x: (x > 0) & (x <= sane))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_min(found).alias("total"), F.regexp_extract(page, r"([0-5][.,][0-9]) out of 5", 1).try_cast("double").alias("rating"))


@query(over_obs(""", g AS (SELECT product_id, count(*) AS n, count(DISTINCT country) AS countries, max(obs_date) AS last_day FROM obs WHERE product_kind = 'device' GROUP BY 1 HAVING count(DISTINCT country) >= 2) SELECT product_id, n, countries FROM g ORDER BY n DESC, countries DESC, product_id LIMIT 40"""))
def hot_products(spark, sf_dir, limit=40):
    """The queue of products whose reviews come first."""
    g = observations(spark, sf_dir).where("product_kind = 'device'").groupBy("product_id").agg(F.count("*").alias("n"), F.countDistinct("country").alias("countries")).where("countries >= 2")
    return g.orderBy(F.desc("n"), F.desc("countries"), "product_id").limit(limit)


@query("""WITH b AS (SELECT conv_id, count(*) AS n, count(CASE WHEN turn % 3 = 0 THEN 1 END) AS fits, count(CASE WHEN role = 'assistant' THEN 1 END) AS named FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN n < 3 THEN 'small' WHEN named = 0 THEN 'brand_absent' WHEN fits >= 0.34 * n THEN 'relevant' ELSE 'off_topic' END AS verdict FROM b""")
def batch_relevance(spark, sf_dir, rate=0.34, least=3):
    """Whether a batch of results is about what was asked: enough rows, the brand named, a share of hits."""
    n, fits, named = F.count("*"), F.count(F.when(F.col("turn") % 3 == 0, 1)), F.count(F.when(F.col("role") == "assistant", 1))
    verdict = F.when(n < least, "small").when(named == 0, "brand_absent").when(fits >= rate * n, "relevant").otherwise("off_topic")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(verdict.alias("verdict"))


@query(over_obs(""", k AS (SELECT product_id, country, min(sale_price) AS lowest, max(ram_gb) AS ram, max(rom_gb) AS rom, arg_max(title, length(title)) AS title FROM obs GROUP BY ALL) SELECT product_id, count(*) AS countries, max(ram) AS ram, max(rom) AS rom, max(length(title)) AS title_chars FROM k GROUP BY product_id"""))
def renormalised(spark, sf_dir):
    """A product's rows merged: the longest title, the richest specification, field by field."""
    o = observations(spark, sf_dir)
    k = o.groupBy("product_id", "country").agg(F.max("ram_gb").alias("ram"), F.max("rom_gb").alias("rom"), F.max_by("title", F.length("title")).alias("title"))
    return k.groupBy("product_id").agg(F.count("*").alias("countries"), F.max("ram").alias("ram"), F.max("rom").alias("rom"), F.max(F.length("title")).alias("title_chars"))


@query(over_obs(""", d AS (SELECT DISTINCT obs_date FROM obs ORDER BY obs_date DESC LIMIT 60) SELECT country, count(*) AS orphans FROM obs WHERE obs_date IN (SELECT obs_date FROM d) AND product_id IN (SELECT p_partkey FROM part WHERE p_size % 10 = 0) GROUP BY country"""))
def orphans(spark, sf_dir, latest=60):
    """Rows of the latest days whose product is to be linked anew."""
    obs = observations(spark, sf_dir)
    days = F.broadcast(obs.select("obs_date").distinct().orderBy(F.desc("obs_date")).limit(latest))  # so many days
    lost = read(spark, sf_dir, "part").where("p_size % 10 = 0").select(F.col("p_partkey").alias("product_id"))
    return obs.join(days, "obs_date", "left_semi").join(lost, "product_id", "left_semi").groupBy("country").agg(F.count("*").alias("orphans"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(sale|discount|promo|oferta)') THEN 'promo' WHEN regexp_matches(lower(text), '\\b(rumou?r|leak|filtra)') THEN 'rumor' WHEN regexp_matches(lower(text), '\\b(review|hands-on|rese)') THEN 'review' WHEN regexp_matches(lower(text), '\\b(update|android|firmware)') THEN 'software' WHEN regexp_matches(lower(text), '\\b(launch|announce|lanza)') THEN 'launch' ELSE 'other' END AS kind FROM documents")
def event_kinds(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", event_kind(F.col("text")).alias("kind"))

"""Listings written from the part table by rules that both engines know, and read back by the functions of titles and specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import listing as ls
from ..functions import price as pr
from ..functions import spec as sp
from ..functions import text as tx
from ..operators import filters as flt
from ..sources.shipping import ship
from ..sources.tables import OWN_BRAND, observations, over_obs, read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)


def written(spark, sf_dir, sql: str):
    """The rows of ``sql``, which reads part only, in the SQL both engines share."""
    return spark.sql(sql.replace("AS VARCHAR", "AS STRING").replace(" FROM part", " FROM {part}"), part=read(spark, sf_dir, "part"))


KIND = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name || ' Phone 128GB' WHEN 1 THEN 'Funda para ' || p_name || ' phone' WHEN 2 THEN 'Case ' || p_name || ' tablet' WHEN 3 THEN 'Laptop ' || p_name || ' + keyboard cover'
    WHEN 4 THEN 'Phone ' || p_name || ' for phone' WHEN 5 THEN p_name || ' cable' WHEN 6 THEN 'Kit smartwatch ' || p_name ELSE p_name END AS title, p_partkey % 8 AS k FROM part"""


@query(f"""SELECT p_partkey, title, ['device', 'accessory', 'accessory', 'device', 'unknown', 'accessory', 'device', 'unknown'][k + 1] AS kind, k IN (3, 6) AS bundle, lower(p) AS plain
    FROM (SELECT *, title AS p FROM ({KIND}))""")
def product_kinds(spark, sf_dir):
    """Device, accessory or unknown by the order of words, bundles, and the plain name."""
    t = F.col("title")
    return written(spark, sf_dir, KIND).select("p_partkey", "title", ls.product_kind(t).alias("kind"), ls.is_bundle(t).alias("bundle"), ls.plain_name(t).alias("plain"))


@query(f"SELECT p_partkey, ['phone', 'phone', 'tablet', 'pc', 'phone', NULL, 'wearable', NULL][k + 1] AS category FROM ({KIND})")
def category_of_title(spark, sf_dir):
    """The category whose word stands first."""
    return written(spark, sf_dir, KIND).select("p_partkey", F.get(ls.category_evidence(F.col("title")), F.lit(0))["category"].alias("category"))


@query(f"""SELECT p_partkey, CASE WHEN k IN (2, 3, 6) AND p_size % 3 = 0 THEN 'fix' WHEN k IN (5, 7) THEN 'pending' WHEN p_size % 3 = 0 AND k IN (0, 1, 4) THEN 'ok' ELSE 'fix' END AS verdict
    FROM ({KIND}) JOIN (SELECT p_partkey AS pk, p_size FROM part) ON pk = p_partkey""")
def category_crosscheck(spark, sf_dir):
    """A listed category against the title's evidence: ok, fix where another category shows, pending where none does."""
    said = F.get(ls.category_evidence(F.col("title")), F.lit(0))["category"]
    rows = written(spark, sf_dir, KIND).join(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    listed = F.when(F.col("p_size") % 3 == 0, "phone").otherwise("camera")
    return rows.select("p_partkey", F.when(said.isNull(), "pending").when(said == listed, "ok").otherwise("fix").alias("verdict"))


SPEC = """SELECT p_partkey, CAST(p_size % 18 + 3 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN ' inches' WHEN 1 THEN '"' ELSE ' pulgadas' END || ', ' || CAST(3000 + p_size * 20 AS VARCHAR) || ' mAh, ' || CAST(8 + p_size AS VARCHAR)
    || ' MP + 8 MP' AS sheet, CAST(64 * (1 + p_size % 4) AS VARCHAR) || 'GB ' || CAST(2 + p_size % 6 AS VARCHAR) || 'GB RAM, 512GB 16GB RAM' AS memory, p_size, p_partkey % 10 AS tenth FROM part"""


@query(f"""SELECT p_partkey, CASE WHEN p_size % 18 + 3 + tenth / 10.0 <= 20 THEN CAST(p_size % 18 + 3 + tenth / 10.0 AS DOUBLE) END AS screen, 3000 + p_size * 20 AS battery, CAST(8 + p_size AS DOUBLE) AS camera, 64 * (1 + p_size % 4) AS least_rom, 2 + p_size % 6 AS its_ram FROM ({SPEC})""")
def spec_sheets(spark, sf_dir):
    """Screen, battery, main camera and the smallest memory variant of written specifications."""
    s, least = F.col("sheet"), F.array_min(sp.memory_options(F.col("memory")))
    rows = written(spark, sf_dir, SPEC)
    return rows.select("p_partkey", sp.screen_inches(s).alias("screen"), sp.battery_mah(s).alias("battery"), sp.camera_mp(s).alias("camera"), least["rom"].alias("least_rom"), least["ram"].alias("its_ram"))


#: Tiers of invented chips: the longest key decides.
CHIPS = {"nova8gen1": 6, "nova8gen2": 7, "nova8": 5, "luma900": 4, "luma9000": 9}
#: Words of the names in the table that say nothing about the tier.
CHIP_MAKERS = ("mobile", "platform", "processor", "cpu", "samsung", "qualcomm", "mediatek")
CHIP = """SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'Qualcomm Nova 8 Gen 2' WHEN 1 THEN 'Nova 8 Gen 1 Mobile Platform' WHEN 2 THEN 'MediaTek Luma 9000' WHEN 3 THEN 'luma-900 processor' WHEN 4 THEN 'Samsung CPU' ELSE 'Other 77' END AS chip, p_partkey % 6 AS k FROM part"""


@query(f"""SELECT p_partkey, tier, CASE WHEN tier IS NOT NULL THEN CAST(CASE abs(tier - p_size % 10) WHEN 0 THEN 1 WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 WHEN 3 THEN 0.15 ELSE 0 END AS DOUBLE) END AS score, round(greatest(0, 1 - abs(p_size - 25.0) / greatest(p_size, 25) / 0.5) + 1e-9, 4) AS near
    FROM (SELECT *, [7, 6, 9, 4, NULL, NULL][k + 1] AS tier FROM ({CHIP}))""")
def chip_tiers(spark, sf_dir):
    """A chip's tier, exact or by the longest key within, scored against another's; and the nearness of two sizes."""
    tier = sp.chip_tier(F.col("chip"), CHIPS, CHIP_MAKERS)
    return written(spark, sf_dir, CHIP).select("p_partkey", tier.alias("tier"), sp.tier_score(tier, F.col("p_size") % 10).alias("score"), r4(sp.ratio_score(F.col("p_size"), F.lit(25.0), 0.5)).alias("near"))


MODEL = """SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'Acme Nova ' || CAST(p_size AS VARCHAR) || ' Pro 8/256GB Black' WHEN 1 THEN 'NOVA ' || CAST(p_size AS VARCHAR) || ' pro 5G' WHEN 2 THEN 'Luma x ' || CAST(p_size AS VARCHAR) ELSE p_name END AS title, p_partkey % 4 AS k FROM part"""


@query(f"""SELECT p_partkey, CASE k WHEN 0 THEN 'nova ' || CAST(p_size AS VARCHAR) || ' pro 8' WHEN 1 THEN 'nova ' || CAST(p_size AS VARCHAR) || ' pro' WHEN 2 THEN 'luma x ' || CAST(p_size AS VARCHAR) || ',luma x' || CAST(p_size AS VARCHAR) ELSE '' END AS keys,
    CASE k WHEN 1 THEN 'nova' WHEN 2 THEN 'luma x' WHEN 0 THEN 'acme nova' ELSE '' END AS family, CASE WHEN k < 3 THEN p_size END AS generation FROM ({MODEL})""")
def series_model_keys(spark, sf_dir):
    """Keys of a listing from its series and the tokens behind it, in both spellings; family and generation."""
    t = F.col("title")
    g = sp.generation(t)
    return written(spark, sf_dir, MODEL).select("p_partkey", F.array_join(sp.series_keys(t, ("nova", "luma")), ",").alias("keys"), g["family"].alias("family"), g["number"].alias("generation"))


@query(f"""SELECT p_partkey, CASE k WHEN 0 THEN 'acme nova ' || CAST(p_size AS VARCHAR) || ' pro 8' WHEN 1 THEN 'nova ' || CAST(p_size AS VARCHAR) || ' pro' WHEN 2 THEN 'luma x ' || CAST(p_size AS VARCHAR) ELSE trim(regexp_replace(regexp_replace(title, '\\b(black|white|blue|red|green|new|sale)\\b', ' ', 'g'), '\\s+', ' ', 'g')) END AS core FROM ({MODEL})""")
def core_models(spark, sf_dir):
    """Titles without memory, colour, network and promotion words."""
    return written(spark, sf_dir, MODEL).select("p_partkey", ls.core_model(F.col("title")).alias("core"))


PAGE = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Please solve the CAPTCHA' WHEN 1 THEN 'Too many requests' WHEN 2 THEN 'Just a moment' WHEN 3 THEN 'Sign in to see prices' WHEN 4 THEN 'Add to cart Compare ' || p_name WHEN 5 THEN p_name || ' - Agotado' ELSE p_name END AS page, p_partkey % 7 AS k FROM part"""


@query(f"SELECT p_partkey, ['captcha', 'throttled', 'challenge', 'login_wall', 'none', 'none', 'none'][k + 1] AS block, k = 4 AS chrome, k <> 5 AS in_stock FROM ({PAGE})")
def page_kinds(spark, sf_dir):
    """Intercepted pages by kind, page chrome, stock."""
    t = F.col("page")
    return written(spark, sf_dir, PAGE).select("p_partkey", tx.block_kind(t).alias("block"), ls.page_chrome(t).alias("chrome"), ls.in_stock(t).alias("in_stock"))


REVIEW = """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'keyboard_arrow_up' WHEN 1 THEN 'Muy bueno' WHEN 2 THEN 'See all reviews' WHEN 3 THEN 'Add to cart to see the price' WHEN 4 THEN '5 4 3 2 1 0 5 4 3 2 1' WHEN 5 THEN 'stars 5 120 4 30 3 10 2 4 1 9' WHEN 6 THEN 'It has 4.5 out of 5 points here'
    WHEN 7 THEN '5 stars and 4 stars and 3 stars shown' WHEN 8 THEN '#### 12345678901 ok ok ok' WHEN 9 THEN 'opinion general' || chr(10) || '190' || chr(10) || '23' || chr(10) || '4' WHEN 10 THEN 'ok ok ok ok ok ok ok' ELSE 'The battery of this ' || p_name || ' lasts all day long' END AS said, p_partkey % 12 AS k FROM part"""


@query(f"SELECT p_partkey, ['icon_only', 'too_short', 'ui_only', 'chrome', 'scale_only', 'histogram', 'summary', 'rating_dist', 'low_letter', 'vertical_hist', 'not_language', NULL][k + 1] AS reason, k NOT IN (1, 10, 11) AS noise FROM ({REVIEW})")
def review_reasons(spark, sf_dir):
    """All eleven reasons for which a text is no review, and which of them are safe to delete by."""
    reason = tx.review_reject_reason(F.col("said"))
    return written(spark, sf_dir, REVIEW).select("p_partkey", reason.alias("reason"), F.coalesce(reason.isin(*tx.UI_NOISE), F.lit(False)).alias("noise"))


TITLE = """SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'NEW Sale ' || p_name WHEN 1 THEN p_name || ' - hot' WHEN 2 THEN p_name || ' refurbished' ELSE 'used ' || p_name END AS title, p_name, k FROM (SELECT p_partkey, p_brand, p_brand || ' gear' AS p_name, p_partkey % 4 AS k FROM part)"""


@query(f"""SELECT p_partkey, CASE k WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || ' refurbished' ELSE 'used ' || p_name END AS title, k < 2 AS stripped, ['new', 'new', 'refurb', 'used'][k + 1] AS condition, p_name AS label FROM ({TITLE})""")
def title_badges(spark, sf_dir):
    """Titles without badges, whether any was there, their condition, and brand and model as one label."""
    t = F.col("title")
    clean = tx.strip_badges(t)
    rows = written(spark, sf_dir, TITLE)
    both = ls.label(F.col("p_brand"), F.col("p_name"))
    return rows.select("p_partkey", clean.alias("title"), (clean != t).alias("stripped"), tx.detect_condition(t).alias("condition"), both.alias("label"))


OFFER = """SELECT p_partkey, p_retailprice AS list_price, CASE p_partkey % 3 WHEN 0 THEN p_retailprice * 0.75 WHEN 1 THEN p_retailprice + 1 END AS sale_price, CASE p_partkey % 4 WHEN 0 THEN 'price with card' WHEN 1 THEN 'con la tarjeta' WHEN 2 THEN '12 x $ 99.50' ELSE 'plain' END AS note, p_partkey % 3 AS k, p_partkey % 4 AS j FROM part"""


@query(f"""SELECT p_partkey, CAST(CASE k WHEN 0 THEN 25.0 WHEN 1 THEN 0.0 END AS DOUBLE) AS discount, CASE WHEN j < 2 THEN 'card' ELSE 'public' END AS scope, CASE WHEN j = 2 THEN 12 END AS months, CASE WHEN j = 2 THEN CAST(99.5 AS DOUBLE) END AS amount,
    list_price BETWEEN 950 AND 1500 AS sane, 'USD ' || format('{{:,.2f}}', round(list_price, 2)) AS shown FROM ({OFFER})""")
def offers(spark, sf_dir):
    """Discounts (unknown is not none), prices for card holders, instalments, bounds and formatting."""
    rows = written(spark, sf_dir, OFFER)
    m, n = pr.installments(F.col("note")), F.col("note")
    sane = pr.is_sane(F.col("list_price"), F.lit(950), F.lit(1500))
    return rows.select("p_partkey", r4(pr.discount(F.col("list_price"), F.col("sale_price"))).alias("discount"), pr.price_scope(n).alias("scope"), m["months"].alias("months"), m["amount"].alias("amount"), sane.alias("sane"), pr.money(F.col("list_price"), F.lit("USD")).alias("shown"))


SAID = """SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN CAST(1 + p_size % 9 AS VARCHAR) || ' days ago' WHEN 1 THEN CAST(1 + p_size % 5 AS VARCHAR) || ' weeks ago' WHEN 2 THEN '1 month ago' ELSE 'yesterday?' END AS ago, CASE p_partkey % 4 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '03/02/2024' WHEN 2 THEN '3 Feb 2024' ELSE 'soon' END AS day,
    CASE p_partkey % 3 WHEN 0 THEN 'n/a' ELSE p_name END AS word, 'Sure: {{"a": {{"b": ' || CAST(p_size AS VARCHAR) || ', "c": "}}"}}}} and {{more' AS answer, p_partkey % 4 AS k FROM part""".replace("{{", "{").replace("}}", "}")


@query(f"""SELECT p_partkey, CASE k WHEN 0 THEN DATE '2024-06-30' - CAST(1 + p_size % 9 AS INTEGER) WHEN 1 THEN DATE '2024-06-30' - CAST(7 * (1 + p_size % 5) AS INTEGER) WHEN 2 THEN DATE '2024-05-31' END AS day_of, CASE WHEN k < 3 THEN DATE '2024-02-03' END AS parsed, CASE WHEN p_partkey % 3 <> 0 THEN word END AS word,
    '{{"a": {{"b": ' || CAST(p_size AS VARCHAR) || ', "c": "}}"}}}}' AS object FROM ({SAID})""")
def said_and_dated(spark, sf_dir):
    """Relative and absolute dates, words that mean nothing, and the balanced object of a chatty answer."""
    ship(spark)
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    ago = F.when(F.col("k") == 0, F.concat((1 + F.col("p_size") % 9).cast("string"), F.lit(" days ago"))).when(F.col("k") == 1, F.concat((1 + F.col("p_size") % 5).cast("string"), F.lit(" weeks ago"))).when(F.col("k") == 2, "1 month ago").otherwise("yesterday?")
    day = F.when(F.col("k") == 0, "2024-02-03").when(F.col("k") == 1, "03/02/2024").when(F.col("k") == 2, "3 Feb 2024").otherwise("soon")
    word = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_name"))
    answer = F.concat(F.lit('Sure: {"a": {"b": '), F.col("p_size").cast("string"), F.lit(', "c": "}"}} and {more'))
    rows = p.withColumn("k", F.col("p_partkey") % 4)
    return rows.select("p_partkey", tx.relative_date(ago, F.lit("2024-06-30").cast("date")).alias("day_of"), tx.parse_date(day).alias("parsed"), tx.as_text(word).alias("word"), tx.json_object(answer).alias("object"))


@query("SELECT s_suppkey, s_name AS said FROM (SELECT s_suppkey, s_name || ' é ñ' AS s_name FROM supplier)")
def mojibake(spark, sf_dir):
    """Names with accents, garbled twice over and read back."""
    s = F.concat("s_name", F.lit(" é ñ"))
    twice = F.decode(F.encode(F.decode(F.encode(s, "UTF-8"), "ISO-8859-1"), "UTF-8"), "ISO-8859-1")
    return read(spark, sf_dir, "supplier").select("s_suppkey", tx.fix_mojibake(twice).alias("said"))


SELLER = """SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN 'Retailer' WHEN 1 THEN p_brand || ' official' WHEN 2 THEN '' WHEN 3 THEN 'Shop ' || CAST(p_size AS VARCHAR) ELSE 'Any' END AS seller, CASE p_partkey % 5 WHEN 4 THEN 'brand_store' ELSE 'retail' END AS kind, p_partkey % 5 AS k FROM part"""


@query(f"SELECT p_partkey, ['self_operated', 'brand_official', 'unknown', 'third_party', 'brand_official'][k + 1] AS seller_kind FROM ({SELLER})")
def seller_kinds(spark, sf_dir):
    """The ladder from the brand's own store to an unknown seller."""
    return written(spark, sf_dir, SELLER).select("p_partkey", tx.seller_kind(F.col("seller"), F.col("p_brand"), F.col("kind")).alias("seller_kind"))


@query(over_obs(f""", t AS (SELECT product_id, country, max(CASE seller_kind WHEN 'self_operated' THEN 2 WHEN 'brand_official' THEN 1 ELSE 0 END) AS tier, count(*) AS n FROM obs WHERE brand = '{OWN_BRAND}' GROUP BY ALL) SELECT * FROM t"""))
def official_tiers(spark, sf_dir):
    """The best seller tier of an own product in a country, from a scope text."""
    rows = observations(spark, sf_dir).where(flt.optional(**{k: v for k, v in flt.scope("all").items()}) & (F.col("brand") == OWN_BRAND))
    return rows.groupBy("product_id", "country").agg(F.max(flt.official_tier()).alias("tier"), F.count("*").alias("n"))

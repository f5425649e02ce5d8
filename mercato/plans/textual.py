"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import price as pr
from ..functions import spec as sp
from ..functions import text as tx
from ..sources.tables import read
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)


@query("""SELECT p_partkey, md5(p_name || '|' || p_brand || '|' || CAST(p_size AS VARCHAR)) AS row_hash, substring(md5(CAST(p_partkey AS VARCHAR)), 1, 5) AS batch_key, substring(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 1, 24) AS head,
    regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS model_key FROM part""")
def text_scalars(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", tx.row_hash(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("row_hash"), tx.batch_key(F.col("p_partkey")).alias("batch_key"), tx.head_print(F.col("p_name")).alias("head"), sp.model_key(F.col("p_name")).alias("model_key"))


@query("""WITH r AS (SELECT p_partkey, ['MXN', 'COP', 'CLP', 'PEN', 'BRL', 'ARS'][1 + p_partkey % 6] AS currency, CAST(CAST(p_retailprice * 100 AS BIGINT) AS BIGINT) AS cents FROM part),
    s AS (SELECT *, CASE WHEN currency IN ('CLP', 'COP') THEN '$ ' || CAST(cents // 1000 AS VARCHAR) || '.' || lpad(CAST(cents % 1000 AS VARCHAR), 3, '0') WHEN currency IN ('BRL', 'ARS') THEN 'R$ ' || CAST(cents // 100 AS VARCHAR) || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') ELSE '$' || CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS raw FROM r)
    SELECT p_partkey, currency, raw, CASE WHEN currency IN ('CLP', 'COP') THEN CAST(cents AS DOUBLE) ELSE round(cents / 100.0, 2) END AS price FROM s""")
def price_parse(spark, sf_dir):
    """Prices written by each currency's rules and read back."""
    p = read(spark, sf_dir, "part")
    cur = F.element_at(F.array(*map(F.lit, ("MXN", "COP", "CLP", "PEN", "BRL", "ARS"))), (1 + F.col("p_partkey") % 6).cast("int"))
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    s = lambda c: c.cast("string")
    cut = lambda n, w: (s(F.expr(f"cents div {n}")), F.lpad(s(F.col("cents") % n), w, "0"))
    (t, tr), (h, hr) = cut(1000, 3), cut(100, 2)
    rows = p.select("p_partkey", cur.alias("currency"), cents.alias("cents"))
    raw = F.when(F.col("currency").isin("CLP", "COP"), F.concat(F.lit("$ "), t, F.lit("."), tr)).when(F.col("currency").isin("BRL", "ARS"), F.concat(F.lit("R$ "), h, F.lit(","), hr)).otherwise(F.concat(F.lit("$"), h, F.lit("."), hr))
    return rows.select("p_partkey", "currency", raw.alias("raw")).withColumn("price", pr.parse_price(F.col("raw"), F.col("currency")))


@query("""SELECT p_partkey, p_name || ' ' || CAST(2 + 2 * (p_size % 5) AS VARCHAR) || '/' || CAST(64 << (p_size % 4) AS VARCHAR) || 'GB' AS title, 2 + 2 * (p_size % 5) AS ram, 64 << (p_size % 4) AS rom,
    CASE WHEN p_name LIKE '%black%' THEN 'black' WHEN p_name LIKE '%white%' THEN 'white' WHEN p_name LIKE '%blue%' THEN 'blue' WHEN p_name LIKE '%red%' THEN 'red' WHEN p_name LIKE '%green%' THEN 'green' END AS colour FROM part""")
def ram_rom(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" "), (2 + 2 * (F.col("p_size") % 5)).cast("string"), F.lit("/"), F.expr("cast(shiftleft(64, p_size % 4) as string)"), F.lit("GB"))
    rows = p.select("p_partkey", title.alias("title")).withColumn("m", sp.ram_rom(F.col("title")))
    return rows.select("p_partkey", "title", F.col("m.ram").alias("ram"), F.col("m.rom").alias("rom"), sp.colour(F.col("title")).alias("colour"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS links,
    regexp_matches(html, 'application/ld\+json') AS has_jsonld FROM pages""")
def html_extract(spark, sf_dir):
    """Host, title, language, links and structured data of pages by JVM regular expressions."""
    p, h = read(spark, sf_dir, "pages"), F.col("html")
    return p.select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, r'<html[^>]*lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), 1)).cast("long").alias("links"), h.rlike(r"application/ld\+json").alias("has_jsonld"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even, CAST(date_trunc('week', ts) AS DATE) AS week FROM events")
def json_props(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    return e.select("event_id", k.alias("k"), (k % 2 == 0).alias("even"), F.to_date(F.date_trunc("week", "ts")).alias("week"))


_ICONS = r"(?i)\b(" + "|".join(tx.ICON_WORDS) + r")\b"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)


def review_reason_sql(table: str, cols: str) -> str:
    """``cols`` and reason of the texts of a table, by the rules of ``review_reject_reason``."""
    return rf"""WITH r1 AS (SELECT {cols}, trim(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g')) AS raw FROM {table}),
    r2 AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '{_ICONS}', ' ', 'g'), '[ \t]+', ' ', 'g')) AS t FROM r1),
    r3 AS (SELECT *, translate(lower(t), 'áàâãäéèêëíìîïóòôõöúùûüñç', 'aaaaaeeeeiiiiooooouuuunc') AS low, regexp_replace(t, '\s+', ' ', 'g') AS flat, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ln FROM r2),
    r4 AS (SELECT *, len(list_filter(ln, lambda x: regexp_matches(x, '^[0-9.,]{{1,7}}$'))) AS bare, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / nullif(length(t), 0) AS letters FROM r3)
    SELECT {cols}, CASE WHEN length(t) < 15 THEN CASE WHEN regexp_matches(raw, '{_ICONS}') THEN 'icon_only' ELSE 'too_short' END WHEN low IN ({_IN(tx.CONTROLS)}) THEN 'ui_only' WHEN regexp_matches(low, '{"|".join(tx.PAGE_WORDS)}') THEN 'chrome'
    WHEN regexp_matches(t, '^[0-9][0-9 /.,]*$') THEN 'scale_only' WHEN regexp_matches(flat, '(?i)\b5 [0-9]+ 4 [0-9]+ 3 [0-9]+ 2 [0-9]+') THEN 'histogram' WHEN regexp_matches(flat, '(?i)[0-9][.,][0-9] (out of|de|sobre) 5|based on [0-9]+ reviews') THEN 'summary'
    WHEN len(regexp_extract_all(flat, '(?i)[1-5] (stars?|estrellas?|estrelas?)')) >= 3 OR len(regexp_extract_all(flat, '\b[1-5] +[0-9]{{1,3}} ?%')) >= 3 THEN 'rating_dist' WHEN letters < 0.55 THEN 'low_letter' WHEN len(ln) >= 4 AND bare >= 0.5 * len(ln) THEN 'vertical_hist'
    WHEN NOT (regexp_matches(t, '\p{{L}}{{8,}}') OR len(regexp_extract_all(flat, '\p{{L}}{{3,}}')) >= 4) THEN 'not_language' END AS reason FROM r4"""


@query(review_reason_sql("conversations", "conv_id, turn, role"))
def review_gate(spark, sf_dir):
    """Why each text would not pass as a review."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tx.review_reject_reason(F.col("text")).alias("reason"))


_BLOCK = " ".join(f"WHEN regexp_matches(lower(substring(text, 1, 4000)), '{'|'.join(words)}') THEN '{kind}'" for kind, words in tx.BLOCK_WORDS.items())


@query(rf"""SELECT doc_id, round(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / nullif(length(text), 0) + 1e-9, 4) AS letters, CASE {_BLOCK} ELSE 'none' END AS block, len(regexp_extract_all(lower(text), '[a-z0-9\x{{00C0}}-\x{{024F}}]+'))
    + list_sum(list_transform(regexp_extract_all(text, '[\x{{4E00}}-\x{{9FFF}}]{{2,}}'), lambda x: length(x) - 1)) AS tokens FROM documents""".replace("+ list_sum(list_transform(", "+ coalesce(list_sum(list_transform(").replace("lambda x: length(x) - 1))", "lambda x: length(x) - 1)), 0)"))
def text_kinds(spark, sf_dir):
    """Over whole texts: the share of letters, the kind of an intercepted page, tokens of words and of neighbouring characters."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", r4(tx.letter_ratio(t)).alias("letters"), tx.block_kind(t).alias("block"), F.size(tx.tokens(t)).cast("long").alias("tokens"))

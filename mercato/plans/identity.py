"""Titles to names, names to products, products to clusters, and links that follow: rules are tables, titles are columns of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewrite import RULES, Rule, name_key, normalise, read_rules, usable, variants
from ..operators.identity import identity, relink, resolve, upsert_products
from ..operators.phrases import longest_hits, phrase_hits
from ..sources.tables import read
from .registry import query

#: What part titles are rewritten by: place, stage, kind, pattern, into.
PART_RULES = [
    (1, "promotion", "replace", r"\b(promo|economy|standard)\b", " "),
    (2, "colour", "replace", r"\b(red|blue)\b", " "),
    (3, "mood", "replace", r"\b(hot|cold)\b", " "),
    (4, "measure", "replace", r"\b(small|medium|large) ([0-9]+)$", " $2"),
    (5, "short", "words", "3", ""),
    (10, "series", "sku", r"\bwidget\b", "Widget"),
    (11, "series", "sku", r"\bgizmo\b", "Gizmo"),
    (20, "Widget", "refine", r"^(old|new) widget [a-z]+ ([0-9]+)$", "Widget $1 $2"),
    (21, "Gizmo", "refine", r"^[a-z]+ gizmo (small|medium|large) ([0-9]+)$", "Gizmo $1 $2"),
    (30, "small parts", "accessory", r"\b(ring|bolt)\b", "a part of something else"),
    (31, "small parts", "attached", r"^(hot|cold) gizmo\b", "a gizmo added to something"),
    (40, "series", "bucket", r"^[a-z ]+$", "a series' name"),
]
PART_LADDER = [("promotion", "colour", "mood", "measure", "short"), ("promotion", "short"), ("short",)]

#: Another table, for the first lines of documents.
LINE_RULES = [
    (1, "seller", "cut", r"[|;].*$", " "),
    (2, "marks", "replace", r"[#*$%&<>|]+", " "),
    (3, "stops", "replace", r"(?i)(^| )((?:the|of|and|in|to|is|by|de|la|le|que|du|un|el|der|die|und|en|y)(?: |$)){1,40}", " "),
    (4, "short", "words", "4", ""),
]
LINE_LADDER = [("seller", "marks", "stops", "short"), ("seller", "marks", "short"), ("marks", "short")]
TIER_WORDS = ("old", "new", "small", "large")


def _rules(spark, rows) -> list[Rule]:
    return read_rules(spark.createDataFrame(rows, RULES))


def titled_parts(spark, sf_dir) -> DataFrame:
    title = F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), "p_size", "p_retailprice", title.alias("title"))


def identified_parts(spark, sf_dir) -> DataFrame:
    return titled_parts(spark, sf_dir).withColumn("i", identity(F.col("title"), _rules(spark, PART_RULES), PART_LADDER)).select("*", "i.*").drop("i")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fold(text: str, rules, stages) -> str:
    """The rewriting rules of some stages as DuckDB SQL over an expression."""
    squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    for _, stage, kind, pattern, into in rules:
        if stage not in stages:
            continue
        if kind == "words":
            text = f"array_to_string(list_slice(string_split({squeeze(text)}, ' '), 1, {pattern}), ' ')"
        else:
            new = f"regexp_replace({text}, {_q(pattern)}, {_q(into.replace('$', chr(92)))}, 'g')"
            text = new if kind == "replace" else f"CASE WHEN regexp_matches({new}, '[0-9]') OR len(string_split({squeeze(new)}, ' ')) >= 3 THEN {new} ELSE {text} END"
    return squeeze(text)


def _usable(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3"


LINES = ", ".join(f"{sql_fold('line', LINE_RULES, stages)} AS r{k}" for k, stages in enumerate(LINE_LADDER, 1))
LINE_SQL = f"""WITH l AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents), r AS (SELECT *, {LINES}, {sql_fold('line', [], ())} AS r0 FROM l),
    n AS (SELECT doc_id, CASE WHEN {_usable('r1')} THEN r1 WHEN {_usable('r2')} THEN r2 WHEN {_usable('r3')} THEN r3 ELSE r0 END AS name, CASE WHEN {_usable('r1')} THEN 1 WHEN {_usable('r2')} THEN 2 WHEN {_usable('r3')} THEN 3 ELSE 0 END AS rung FROM r)"""


def named_lines(spark, sf_dir) -> DataFrame:
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return read(spark, sf_dir, "documents").select("doc_id", normalise(line, _rules(spark, LINE_RULES), LINE_LADDER).alias("n")).select("doc_id", "n.name", "n.rung")


@query(LINE_SQL + " SELECT * FROM n")
def line_names(spark, sf_dir):
    """The first line of every document as a name: cut, cleaned, without stop words, four words; and how far down the ladder it came."""
    return named_lines(spark, sf_dir)


@query(LINE_SQL + """, w AS (SELECT doc_id, name, string_split(name, ' ') AS w FROM n WHERE """ + _usable("name") + """), v AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, w FROM w), c AS (SELECT name, count(*) AS n FROM w GROUP BY name HAVING count(*) > 1),
    m AS (SELECT doc_id, k, array_to_string(list_slice(w, 1, k), ' ') AS variant FROM v) SELECT m.doc_id, arg_max(m.variant, k) AS known_as, CAST(max(k) AS INTEGER) AS n_words, arg_max(c.n, k) AS n FROM m JOIN c ON m.variant = c.name GROUP BY m.doc_id""")
def known_names(spark, sf_dir):
    """Names found in the catalogue of names that several documents have: exact joins on the name's variants, the longest counts."""
    named = named_lines(spark, sf_dir).where(usable(F.col("name"), 3))
    catalogue = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("name", "variant")
    each = named.select("doc_id", F.explode(variants(F.col("name"))).alias("variant")).join(catalogue, "variant")
    longest = F.max(F.struct(F.size(F.split("variant", " ")).alias("n_words"), "variant", "n"))
    return each.groupBy("doc_id").agg(longest.alias("x")).select("doc_id", F.col("x.variant").alias("known_as"), "x.n_words", "x.n")


_FLAT = lambda x: f"trim(regexp_replace(translate(lower(coalesce({x}, '')), 'áàâãäéèêëíìîïóòôõöúùûüñç', 'aaaaaeeeeiiiiooooouuuunc'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(LINE_SQL.replace("WITH l AS", "WITH RECURSIVE l AS", 1) + f""", c AS (SELECT name FROM n WHERE {_usable("name")} GROUP BY name HAVING count(*) > 1), ph AS (SELECT f AS phrase, len(string_split(f, ' ')) AS n, min(name) AS value FROM (SELECT name, {_FLAT("name")} AS f FROM c) WHERE f <> '' GROUP BY f),
    t AS (SELECT doc_id, string_split({_FLAT("text")}, ' ') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM t), k AS (SELECT DISTINCT n FROM ph),
    h AS (SELECT doc_id, pos, ph.n, ph.phrase FROM p CROSS JOIN k JOIN ph ON ph.n = k.n WHERE ph.phrase = array_to_string(list_slice(w, pos, pos + k.n - 1), ' ') AND pos + k.n - 1 <= len(w)),
    b AS (SELECT doc_id, pos, max(n) AS n FROM h GROUP BY doc_id, pos), rd AS (SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS free FROM (SELECT DISTINCT doc_id FROM b) UNION ALL SELECT doc_id, pos, free FROM (SELECT b.doc_id, b.pos, b.pos + b.n AS free, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS rn FROM rd JOIN b ON b.doc_id = rd.doc_id AND b.pos >= rd.free) WHERE rn = 1)
    SELECT rd.doc_id, count(*) AS named, count(DISTINCT array_to_string(list_slice(w, rd.pos, rd.free - 1), ' ')) AS names, CAST(min(rd.pos) AS INTEGER) AS first_at FROM rd JOIN t ON t.doc_id = rd.doc_id WHERE rd.pos > 0 GROUP BY rd.doc_id""")
def names_in_texts(spark, sf_dir):
    """How often the names that several documents have stand in whole texts, read from the left, the longest name first: a dictionary that is a table."""
    named = named_lines(spark, sf_dir).where(usable(F.col("name"), 3))
    catalogue = named.groupBy(F.col("name").alias("phrase")).agg(F.count("*").alias("n")).where("n > 1").select("phrase", F.col("phrase").alias("value"))
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = longest_hits(phrase_hits(texts, catalogue, most_words=None))
    return hits.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("named"), F.countDistinct("phrase").alias("names"), F.min("at").alias("first_at"))


_STAGES = PART_LADDER[0]
IDENT_SQL = f"""WITH t AS (SELECT p_partkey, p_brand AS brand, p_type AS category, p_size, p_retailprice, p_name || ' ' || lower(p_type) || ' ' || CAST(p_size AS VARCHAR) AS title FROM part),
    s AS (SELECT *, regexp_matches(title, '\\b(ring|bolt)\\b') AS acc, regexp_matches(title, '^(hot|cold) gizmo\\b') AS att, CASE WHEN regexp_matches(title, '\\bwidget\\b') THEN 'Widget' WHEN regexp_matches(title, '\\bgizmo\\b') THEN 'Gizmo' END AS sku,
      CASE WHEN regexp_matches(title, '^(old|new) widget') THEN 'Widget ' || split_part(title, ' ', 1) || ' ' || p_size WHEN regexp_matches(title, ' gizmo (small|medium|large) ') THEN 'Gizmo ' || split_part(title, ' ', 3) || ' ' || p_size END AS fine, {sql_fold('title', PART_RULES, _STAGES)} AS plain FROM t),
    m AS (SELECT *, CASE WHEN acc THEN NULL WHEN sku IS NOT NULL AND att THEN sku ELSE coalesce(fine, sku, plain) END AS model, CASE WHEN acc THEN 'rule' WHEN sku IS NOT NULL AND att THEN 'rule' WHEN fine IS NOT NULL THEN 'rule/refined' WHEN sku IS NOT NULL THEN 'rule' ELSE 'name' END AS source,
      CASE WHEN acc OR (sku IS NOT NULL AND att) THEN 'accessory' ELSE 'device' END AS kind, NOT acc AND sku IS NOT NULL AND att AS conflict FROM s),
    ident AS (SELECT p_partkey, brand, category, p_size, p_retailprice, title, model, replace(lower(model), ' ', '') AS key, source, kind, coalesce(regexp_matches(lower(model), '^[a-z ]+$'), false) AS is_bucket, conflict FROM m)"""


@query(IDENT_SQL + " SELECT p_partkey, title, model, key, source, kind, is_bucket, conflict FROM ident")
def product_identity(spark, sf_dir):
    """What each part's title is: by an authoritative rule, a series made finer, or the cleaned name; accessories, buckets, and where rules disagree."""
    return identified_parts(spark, sf_dir).select("p_partkey", "title", "model", "key", "source", "kind", "is_bucket", "conflict")


CLUSTER_SQL = IDENT_SQL.replace("WITH t AS", "WITH RECURSIVE t AS") + """,
    k AS (SELECT p_partkey AS r, brand || '/' || category || '/' || key AS k FROM ident WHERE NOT is_bucket AND NOT conflict AND key IS NOT NULL UNION ALL SELECT p_partkey, brand || '/' || CAST(round(p_retailprice * 100) AS BIGINT) || '/' || p_size FROM ident WHERE kind = 'device'),
    e AS (SELECT DISTINCT a.r AS u, b.r AS v FROM k a JOIN k b USING (k)), reach AS (SELECT p_partkey AS r, p_partkey AS x FROM part UNION SELECT reach.r, e.v FROM reach JOIN e ON e.u = reach.x),
    c AS (SELECT r, min(x) AS cluster FROM reach GROUP BY r), a AS (SELECT p_partkey AS r, cluster, title, source, CASE WHEN source LIKE 'rule%' AND kind = 'device' THEN sku END AS auth FROM (SELECT *, CASE WHEN source LIKE 'rule%' THEN split_part(model, ' ', 1) END AS sku FROM ident) JOIN c ON c.r = p_partkey),
    st AS (SELECT *, CASE WHEN min(auth) OVER w IS NULL THEN 'open' WHEN min(auth) OVER w = max(auth) OVER w THEN 'sure' ELSE 'conflict' END AS state FROM a WINDOW w AS (PARTITION BY cluster)),
    g AS (SELECT *, CASE WHEN state = 'conflict' THEN coalesce(auth, '#' || r) ELSE '' END AS part FROM st)
    SELECT r AS p_partkey, min(r) OVER h AS product, state, first_value(r) OVER (h ORDER BY (source = 'rule/refined') DESC, length(title) DESC, r) AS survivor FROM g WINDOW h AS (PARTITION BY cluster, part)"""


@query(CLUSTER_SQL)
def product_clusters(spark, sf_dir):
    """Parts that are one product, over shared name keys and shared offers (brand, price, size); the authoritative series decide what may be together."""
    rows = identified_parts(spark, sf_dir)
    by_name = rows.where("not is_bucket and not conflict and key is not null").select(F.col("p_partkey").alias("record"), F.concat_ws("/", "brand", "category", "key").alias("key"))
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    by_offer = rows.where("kind = 'device'").select(F.col("p_partkey").alias("record"), F.concat_ws("/", "brand", cents, "p_size").alias("key"))
    ruled = F.col("source").startswith("rule") & (F.col("kind") == "device")
    records = rows.select(F.col("p_partkey").alias("record"), F.col("title").alias("name"), F.when(ruled, F.substring_index("model", " ", 1)).alias("authoritative"), (F.col("source") == "rule/refined").alias("verified"))
    return resolve(records, by_name.unionByName(by_offer)).select(F.col("record").alias("p_partkey"), "product", "state", "survivor")


UPSERT_SQL = IDENT_SQL + """, f AS (SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS first_day FROM lineitem GROUP BY 1), x AS (SELECT ident.*, source = 'rule/refined' AS verified, first_day < DATE '1996-01-01' AS early FROM ident JOIN f ON l_partkey = p_partkey WHERE key IS NOT NULL AND NOT conflict),
    b AS (SELECT early, brand, category, key, arg_min(model, (CASE WHEN verified THEN '0' ELSE '1' END) || model) AS name, bool_or(verified) AS verified, bool_and(is_bucket) AS is_bucket FROM x GROUP BY ALL)
    SELECT brand, category, key, CASE WHEN o.name IS NULL OR (n.verified AND NOT o.verified) THEN n.name ELSE o.name END AS name, coalesce(o.verified, false) OR coalesce(n.verified, false) AS verified, CASE WHEN o.name IS NULL THEN n.is_bucket ELSE o.is_bucket AND coalesce(n.is_bucket, true) END AS is_bucket, o.name IS NULL AS is_new
    FROM (SELECT * FROM b WHERE early) o FULL JOIN (SELECT * FROM b WHERE NOT early) n USING (brand, category, key)"""


@query(UPSERT_SQL)
def product_upsert(spark, sf_dir):
    """The catalogue of products seen before 1996 after the later ones come in: new keys are added, marks only get better."""
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.to_date(F.min("l_shipdate")).alias("first_day"))
    rows = identified_parts(spark, sf_dir).where("not conflict").join(first, "p_partkey")
    rows = rows.select("brand", "category", "key", F.col("model").alias("name"), (F.col("source") == "rule/refined").alias("verified"), "is_bucket", (F.col("first_day") < F.lit("1996-01-01").cast("date")).alias("early"))
    nothing = rows.where("false").select("brand", "category", "key", "name", "verified", "is_bucket")
    before = upsert_products(nothing, rows.where("early"))
    return upsert_products(before, rows.where("not early"))


_LIST = "[" + ", ".join(f"'{w}'" for w in TIER_WORDS) + "]"
_TIERS = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: list_contains({_LIST}, w)))"


@query(IDENT_SQL + f""", l AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), l_partkey) AS product FROM lineitem),
    p AS (SELECT *, CASE WHEN NOT conflict THEN key END AS k FROM ident), tg AS (SELECT brand, category, k, min(p_partkey) AS target FROM p WHERE k IS NOT NULL GROUP BY ALL),
    j AS (SELECT l_orderkey, l_linenumber, l_partkey, product, t.k, t.title, h.k AS had_key, h.is_bucket AS had_bucket, h.title AS had_title, target, g.is_bucket AS to_bucket, g.title AS to_title FROM l JOIN p t ON t.p_partkey = l.l_partkey JOIN p h ON h.p_partkey = l.product LEFT JOIN tg ON tg.brand = t.brand AND tg.category = t.category AND tg.k = t.k LEFT JOIN p g ON g.p_partkey = target),
    f AS (SELECT *, {_TIERS('title')} AS said, {_TIERS('had_title')} AS a, {_TIERS('to_title')} AS b FROM j),
    v AS (SELECT *, CASE WHEN had_bucket THEN 'held' WHEN k IS NULL THEN 'unknown' WHEN k = had_key THEN 'same' WHEN target IS NULL THEN 'missing' WHEN target = product THEN 'same' WHEN to_bucket THEN 'bucket'
      WHEN NOT len(list_intersect(b, said)) - (len(b) - len(list_intersect(b, said))) > len(list_intersect(a, said)) - (len(a) - len(list_intersect(a, said))) THEN 'no_better' ELSE 'move' END AS verdict FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, product AS before, CASE WHEN verdict = 'move' THEN target ELSE product END AS after, verdict FROM v""")
def relink_plan(spark, sf_dir):
    """Lines that were linked to the product of the line before them: which links move to the product that the title's own key names, and which stay and why."""
    parts = identified_parts(spark, sf_dir).withColumn("key", F.when(~F.col("conflict"), F.col("key")))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    linked = F.coalesce(F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")), F.col("l_partkey"))
    rows = li.withColumn("product", linked).join(parts.select(F.col("p_partkey").alias("l_partkey"), "brand", "category", "title", "key"), "l_partkey")
    links = rows.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("link"), "brand", "category", "title", "key", "product")
    products = parts.select(F.col("p_partkey").alias("product"), "brand", "category", F.col("title").alias("name"), "key", "is_bucket")
    return relink(links, products, TIER_WORDS).select("link.l_orderkey", "link.l_linenumber", "link.l_partkey", "before", "after", "verdict")

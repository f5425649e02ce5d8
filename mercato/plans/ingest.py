"""Sources and sinks: pages, feeds, tables of specifications, files written and read back, evidence packs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import as_text
from ..sources import feeds
from ..sources.archive import archived, publish, verify
from ..sources.shared import new_path
from ..sources.tables import evolve, observations, over_obs, read
from ..sources.versions import Versions
from .registry import query

r4 = lambda c: F.round(c + 1e-9, 4)



def product_page():
    """A page with a product as linked data within a graph, a specification table, data attributes and cards."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), name.alias("name"), F.struct(F.col("p_retailprice").alias("price"), F.lit("USD").alias("priceCurrency")).alias("offers")))
    return F.concat(
        F.lit('<html><script type="application/ld+json">{"@graph":[{"@type":"WebSite"},'), product, F.lit("]}</script><table><tr><th>Brand</th><td>"), F.col("p_brand"), F.lit("</td></tr><tr><th> Size </th><td><b>"), size,
        F.lit('</b></td></tr></table><span data-spec="chipset">'), F.col("p_type"), F.lit('</span><span data-spec="battery">'), size, F.lit(' mAh</span><p>Sold by <b>Shop '), size, F.lit('</b></p><div class="card"><h3>'), name,
        F.lit('</h3><i>$ '), size, F.lit('</i></div><div class="card"><h3>'), F.col("p_brand"), F.lit("</h3><i>ask</i></div></html>"),
    )


def pages_of(spark, sf_dir):
    return read(spark, sf_dir, "part").select("*", product_page().alias("html"))


GRAPH = "`@type` string, name string, offers struct<price double, priceCurrency string>, `@graph` array<struct<`@type` string, name string, offers struct<price double, priceCurrency string>>>"


def linked_products(html):
    """Products of a page's linked data, alone or in a graph, as an array of structs."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<script type=\"application/ld\+json\">(.*?)</script>"), 1), lambda b: F.from_json(b, GRAPH))
    flat = F.flatten(F.transform(blocks, lambda b: F.concat(F.array(F.struct(b["@type"].alias("@type"), b["name"].alias("name"), b["offers"].alias("offers"))), F.coalesce(b["@graph"], F.array()))))
    return F.filter(flat, lambda x: x["@type"] == "Product")


def strip_tags(s):
    return F.trim(F.regexp_replace(s, "<[^>]*>", ""))


def spec_table(html):
    """The rows of specification tables as a map; a name that comes twice keeps its first value."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr>(.*?)</tr>"), 1)
    pairs = F.transform(rows, lambda r: F.struct(strip_tags(F.regexp_extract(r, r"(?s)<th>(.*?)</th>", 1)).alias("key"), strip_tags(F.regexp_extract(r, r"(?s)<td>(.*?)</td>", 1)).alias("value")))
    named = F.filter(pairs, lambda x: x["key"] != "")
    first = F.filter(named, lambda x, i: F.array_position(F.transform(named, lambda y: y["key"]), x["key"]) == i + 1)
    return F.map_from_entries(first)


@query("SELECT p_partkey, p_name AS name, p_retailprice AS price, 'USD' AS currency, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, 'Shop ' || CAST(p_size AS VARCHAR) AS seller FROM part")
def page_products(spark, sf_dir):
    """Products from linked data, specifications from tables, the seller's name."""
    h = F.col("html")
    x, specs = F.get(linked_products(h), F.lit(0)), spec_table(h)
    seller = F.regexp_extract(h, r"Sold by <b>([^<]*)</b>", 1)
    return pages_of(spark, sf_dir).select("p_partkey", x["name"].alias("name"), x["offers"]["price"].alias("price"), x["offers"]["priceCurrency"].alias("currency"), specs["Brand"].alias("brand"), specs["Size"].alias("size"), seller.alias("seller"))


@query("SELECT p_partkey, 1 AS place, p_name AS title, CAST(p_size AS DOUBLE) AS price FROM part UNION ALL SELECT p_partkey, 2, p_brand, NULL FROM part")
def page_cards(spark, sf_dir):
    """A row for each card of a page."""
    cards = F.regexp_extract_all("html", F.lit(r'(?s)<div class="card">(.*?)</div>'), 1)
    rows = pages_of(spark, sf_dir).select("p_partkey", F.posexplode(cards).alias("place", "card"))
    price = F.regexp_extract("card", r"<i>\$ ([0-9.]+)</i>", 1).try_cast("double")
    return rows.select("p_partkey", (F.col("place") + 1).alias("place"), F.regexp_extract("card", r"<h3>(.*?)</h3>", 1).alias("title"), price.alias("price"))


@query("SELECT p_partkey, p_type AS chipset, p_size AS battery FROM part")
def device_pages(spark, sf_dir):
    """Specifications in data attributes."""
    one = lambda name: F.regexp_extract("html", rf'data-spec="{name}">([^<]*)<', 1)
    return pages_of(spark, sf_dir).select("p_partkey", one("chipset").alias("chipset"), F.regexp_extract(one("battery"), "([0-9]+)", 1).try_cast("int").alias("battery"))


def written_feeds(spark, sf_dir):
    """Twenty documents to a feed, each feed one line: there is no table of feeds. Everything that markup needs is escaped."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = F.regexp_replace(F.replace(escaped, F.lit("\r"), F.lit("&#13;")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", " ")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    said = F.date_format(day.cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item><title>"), F.substring_index(clean, "\n", 1), F.lit("</title><guid>"), F.col("doc_id").cast("string"), F.lit("</guid><pubDate>"), said, F.lit(" +0000</pubDate><category>"), F.coalesce("lang", F.lit("none")), F.lit("</category><category>all</category><description>"), F.replace(clean, F.lit("\n"), F.lit("&#10;")), F.lit("</description></item>"))
    rows = read(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 20).alias("block"), "doc_id", item.alias("item"))
    feeds = rows.groupBy("source", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "").alias("items"))
    return feeds.select("source", "block", F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), F.coalesce("source", F.lit("")), F.lit("</title>"), "items", F.lit("</channel></rss>")).alias("value"))


_FEEDS = """SELECT doc_id, source, block, CAST(row_number() OVER (PARTITION BY source, block ORDER BY doc_id) AS INTEGER) AS place, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS day, CASE WHEN lang IN ('none') OR lang IS NULL THEN NULL ELSE lang END AS category, text FROM (SELECT *, CAST(floor(doc_id / 20) AS BIGINT) AS block FROM documents)"""


@query(f"SELECT doc_id, source, block, place, day, category, length(text) AS n_chars FROM ({_FEEDS})")
def feed_items(spark, sf_dir):
    """Every item of every feed: its place, day, first category and the length of its text."""
    items = feeds.feed_items(written_feeds(spark, sf_dir), keep=("source", "block"))
    return items.select(F.col("guid").cast("long").alias("doc_id"), "source", "block", "place", F.to_date("published").alias("day"), as_text(F.get("categories", F.lit(0))).alias("category"), F.length("summary").alias("n_chars"))


@query(f"SELECT day, count(*) AS n, min(doc_id) AS first_doc FROM ({_FEEDS}) GROUP BY day")
def stream_feeds(spark, sf_dir):
    """Feed files taken in by a stream in two runs under one checkpoint, the second with files that say it all again: every item once, by day."""
    path, out, state = (new_path(spark, x) for x in ("feeds", "feed-items", "feed-state"))
    rows = written_feeds(spark, sf_dir).select("block", "value")
    for run, some in enumerate((rows.where("block % 2 = 0"), rows)):
        some.select("value").write.text(f"{path}/run={run}")
        feeds.take_in(feeds.feed_stream(spark, path, whole=False), out, state, late="400 days")
    got = spark.read.schema(feeds.ITEMS).parquet(out)
    return got.groupBy(F.to_date("published").alias("day")).agg(F.count("*").alias("n"), F.min(F.col("guid").cast("long")).alias("first_doc"))


@query("SELECT url, count(*) AS versions, min(page_id) AS first_page FROM (SELECT url, md5(html) AS h, min(page_id) AS page_id FROM pages GROUP BY url, md5(html)) GROUP BY url")
def page_stash(spark, sf_dir):
    """Raw pages kept once for each address and text."""
    once = read(spark, sf_dir, "pages").groupBy("url", F.md5("html").alias("h")).agg(F.min("page_id").alias("page_id"))
    return once.groupBy("url").agg(F.count("*").alias("versions"), F.min("page_id").alias("first_page"))


@query("SELECT p_partkey, p_name, p_brand, p_size, CAST(NULL AS VARCHAR) AS colour FROM part")
def csv_products(spark, sf_dir):
    """A product list as CSV with a header, read by schema and brought to the model's columns: what is missing is null."""
    path = new_path(spark, "products")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.col("p_retailprice").alias("not_asked_for"))
    p.write.option("header", True).option("escape", '"').csv(path)
    back = spark.read.schema(p.schema).option("header", True).option("escape", '"').csv(path)
    want = spark.createDataFrame([], "p_partkey long, p_name string, p_brand string, p_size int, colour string").schema
    return evolve(back, want)


@query("SELECT n_name AS country, r_name AS currency, CAST(n_nationkey % 2 = 0 AS BOOLEAN) AS enabled FROM nation JOIN region ON n_regionkey = r_regionkey")
def seed_countries(spark, sf_dir):
    """Dimension rows from configuration text (key: value lines), one text for each country, upserted by key."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    lines = F.concat(F.lit("name: "), "n_name", F.lit("\ncurrency: "), "r_name", F.lit("\nenabled: "), (F.col("n_nationkey") % 2 == 0).cast("string"))
    said = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.str_to_map(lines, F.lit("\n"), F.lit(": ")).alias("c"))
    return said.select(F.col("c")["name"].alias("country"), F.col("c")["currency"].alias("currency"), F.col("c")["enabled"].cast("boolean").alias("enabled"))


_RUNS = """SELECT CAST(CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS VARCHAR) AS part, l_linenumber <= 5 AS first_run, l_linenumber <= CASE WHEN year(CAST(l_shipdate AS DATE)) = 1997 THEN 4 ELSE 7 END AS second_run, l_partkey FROM lineitem"""
_COUNTS = f"WITH r AS ({_RUNS}), c AS (SELECT part, count(CASE WHEN first_run THEN 1 END) AS had, count(CASE WHEN second_run THEN 1 END) AS has, count(DISTINCT CASE WHEN first_run THEN l_partkey END) AS p1, count(DISTINCT CASE WHEN second_run THEN l_partkey END) AS p2 FROM r GROUP BY part)"


def archived_runs(spark, sf_dir):
    """The line items archived twice: a first run without late lines, a second one with all but for a year whose rows were lost in part."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    li = li.withColumn("part", F.to_date(F.date_trunc("month", "day")).cast("string"))
    store = Versions(spark, new_path(spark, "archive"))
    publish(store, li.where("l_linenumber <= 5"), "part", 2, "l_partkey")
    return store, publish(store, li.where(F.col("l_linenumber") <= F.when(F.year("day") == 1997, 4).otherwise(7)), "part", 2, "l_partkey")


@query(_COUNTS + " SELECT part, nullif(had, 0) AS had, nullif(has, 0) AS has, CASE WHEN has = 0 THEN 'kept' WHEN had = 0 THEN 'new' WHEN has < had THEN 'refused' WHEN has = had THEN 'same' ELSE 'grown' END AS state, greatest(had, has) AS n_rows, CASE WHEN has < had THEN p1 ELSE p2 END AS products FROM c WHERE had > 0 OR has > 0")
def partition_export(spark, sf_dir):
    """The fact as compressed CSV by month: months that would shrink against the last run's manifest are refused and keep their files; counted from the archive."""
    store, decided = archived_runs(spark, sf_dir)
    rows = archived(store, "l_partkey long, l_suppkey long, l_linenumber int, day date")
    return decided.join(rows.groupBy("part").agg(F.count("*").alias("n_rows"), F.countDistinct("l_partkey").alias("products")), "part", "left")


@query(_COUNTS + " SELECT part, greatest(had, has) AS noted_rows, CASE WHEN has < had THEN 1 ELSE 2 END AS run, CAST(0 AS BIGINT) AS bad FROM c WHERE had > 0 OR has > 0")
def manifest_check(spark, sf_dir):
    """What the manifest notes for each month, from which run its files are, and how many of them have other bytes than were published."""
    store, _ = archived_runs(spark, sf_dir)
    noted = store.read("files").groupBy("part").agg(F.sum("n_rows").alias("noted_rows"), F.max("run").alias("run"))
    return noted.join(verify(store).groupBy("part").agg(F.count(F.when(F.col("status") != "ok", 1)).alias("bad")), "part")


@query(over_obs(""", m AS (SELECT max(obs_date) AS d FROM obs) SELECT p_partkey, p_brand, d AS asof FROM part, m"""))
def dimension_snapshot(spark, sf_dir):
    """A dimension as of the data's last day, in a partition of that day; writing it again replaces it."""
    path = new_path(spark, "snapshot")
    day = observations(spark, sf_dir).agg(F.max("obs_date").alias("asof"))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand").crossJoin(F.broadcast(day))
    for _ in range(2):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asof").parquet(path)
    return spark.read.schema("p_partkey long, p_brand string, asof date").parquet(path)


@query(over_obs(""", g AS (SELECT country, category, count(*) AS n, count(DISTINCT product_id) AS p FROM obs GROUP BY ALL), r AS (SELECT country, '{"category":"' || category || '","n":' || n || ',"products":' || p || '}' AS item, category FROM g)
    SELECT country, '[' || string_agg(item, ',' ORDER BY category) || ']' AS pack, md5('[' || string_agg(item, ',' ORDER BY category) || ']') AS stamp FROM r GROUP BY country"""))
def evidence_pack(spark, sf_dir):
    """A JSON pack for each country with a checksum of its text. Its rows are the closed list of categories."""
    g = observations(spark, sf_dir).groupBy("country", "category").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("products"))
    items = F.array_sort(F.collect_list(F.struct("category", "n", "products")))
    pack = g.groupBy("country").agg(F.to_json(items).alias("pack"))
    return pack.select("country", "pack", F.md5("pack").alias("stamp"))


@query("SELECT conv_id, turn, text, substring(md5(CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)), 1, 5) AS code FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, substring(md5(CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)), 1, 5)) AS c FROM conversations) WHERE c = 1")
def answers_by_code(spark, sf_dir):
    """Answers of a batch put to their questions by check code, whatever their order; a code that is not unique in its batch is left out."""
    code = F.substring(F.md5(F.concat_ws("/", "conv_id", "turn")), 1, 5)
    asked = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", code.alias("code"))
    same = F.count("*").over(Window.partitionBy("conv_id", "code"))
    answered = asked.select("conv_id", "code", F.col("turn").alias("n")).withColumn("c", same).where("c = 1").select("conv_id", "code")
    return asked.join(answered, ["conv_id", "code"]).select("conv_id", "turn", "text", "code")


@query("SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) + 1e-9, 4) AS norm FROM embeddings")
def vectors(spark, sf_dir):
    """Stored vectors are native arrays of floats: nothing to pack or unpack."""
    e = read(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return e.select("vec_id", F.size("embedding").cast("long").alias("dim"), r4(norm).alias("norm"))


TREE = "name string, price double, items array<struct<name string, price double, items array<struct<name string, price double>>>>"


@query("SELECT p_partkey, p_name AS name, p_retailprice AS price, 1 AS depth FROM part UNION ALL SELECT p_partkey, p_brand, p_size, 2 FROM part UNION ALL SELECT p_partkey, p_type, 1, 3 FROM part")
def nested_products(spark, sf_dir):
    """Products of nested JSON, level by level to a fixed depth: the schema is the cap."""
    p = read(spark, sf_dir, "part")
    said = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_size").alias("price"), F.array(F.struct(F.col("p_type").alias("name"), F.lit(1).alias("price"))).alias("items"))).alias("items")))
    t = p.select("p_partkey", F.from_json(said, TREE).alias("t"))
    one = lambda x, d: F.struct(x["name"].alias("name"), x["price"].alias("price"), F.lit(d).alias("depth"))
    level2 = F.transform("t.items", lambda x: one(x, 2))
    level3 = F.flatten(F.transform("t.items", lambda x: F.transform(x["items"], lambda y: one(y, 3))))
    return t.select("p_partkey", F.explode(F.concat(F.array(one(F.col("t"), 1)), level2, level3)).alias("x")).select("p_partkey", "x.name", "x.price", "x.depth")

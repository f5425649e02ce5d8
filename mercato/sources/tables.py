"""The observation model: enums, schemas and how the star-schema tables map onto price observations.

An observation is a line item: the supplier is the channel, the nation the country and its region the currency zone.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SELLER_KINDS = ("self_operated", "brand_official", "third_party", "unknown")
PRODUCT_KINDS = ("device", "accessory", "unknown")
AUDIT_STATUSES = ("pending", "accepted", "rejected")
OWN_BRAND = "Brand#1"

OBSERVATION = T.StructType(
    [
        T.StructField("obs_date", T.DateType()), T.StructField("country", T.StringType()), T.StructField("currency", T.StringType()),
        T.StructField("channel_id", T.LongType()), T.StructField("product_id", T.LongType()), T.StructField("brand", T.StringType()),
        T.StructField("category", T.StringType()), T.StructField("title", T.StringType()), T.StructField("ram_gb", T.IntegerType()),
        T.StructField("rom_gb", T.IntegerType()), T.StructField("list_price", T.DoubleType()), T.StructField("sale_price", T.DoubleType()),
        T.StructField("discount_pct", T.DoubleType()), T.StructField("seller_kind", T.StringType()), T.StructField("product_kind", T.StringType()),
        T.StructField("condition", T.StringType()), T.StructField("is_bundle", T.IntegerType()), T.StructField("price_scope", T.StringType()),
        T.StructField("audit_status", T.StringType()),
    ]
)

PRICE_MOVE = T.StructType(
    [
        T.StructField("move_date", T.DateType()), T.StructField("product_id", T.LongType()), T.StructField("country", T.StringType()), T.StructField("currency", T.StringType()),
        T.StructField("brand", T.StringType()), T.StructField("category", T.StringType()), T.StructField("prev_date", T.DateType()), T.StructField("prev_price", T.DoubleType()),
        T.StructField("curr_price", T.DoubleType()), T.StructField("change_pct", T.DoubleType()), T.StructField("days_span", T.IntegerType()), T.StructField("is_official", T.IntegerType()),
    ]
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: what is missing is null, what is more is left out. Never inferred."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country and currency zone: 25 rows at any scale, so broadcasting them is safe."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("currency"))


def latest(spark: SparkSession, sf_dir: str, name: str = "lineitem", col: str = "l_shipdate") -> date | None:
    """The last day of a fact: one column of one table, not of the joined observations."""
    return read(spark, sf_dir, name).agg(F.to_date(F.max(col)).alias("d")).first()["d"]


def observations(spark: SparkSession, sf_dir: str, last_days: int | None = None) -> DataFrame:
    """Price observations. Products and channels are joined as they come; their size decides how, at run time.

    With ``last_days`` only those of so many days up to the fact's last one: a literal bound on the fact's own column, which reaches its
    scan, so files and row groups before it are not read.
    """
    li, part, sup = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    if last_days is not None and (now := latest(spark, sf_dir)):
        first = F.lit(now - timedelta(days=last_days - 1)).cast(li.schema["l_shipdate"].dataType)
        li = li.where(F.col("l_shipdate") >= first)
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    li = li.withColumns({"list_price": price, "sale_price": price * (1 - F.col("l_discount"))})  # before the joins: fewer columns are shuffled
    flag = F.create_map(*[F.lit(x) for x in ("N", "self_operated", "A", "brand_official", "R", "third_party")])
    size = F.col("p_size")
    return (  # products last, so that what is grouped by product next is together already
        li.join(sup.select("s_suppkey", "s_nationkey"), li.l_suppkey == sup.s_suppkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(F.broadcast(countries(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.to_date("l_shipdate").alias("obs_date"), "country", "currency", F.col("l_suppkey").alias("channel_id"), F.col("l_partkey").alias("product_id"),
            F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_name").alias("title"),
            F.when(size % 10 != 0, 2 + 2 * (size % 5)).cast("int").alias("ram_gb"), F.expr("cast(shiftleft(64, p_size % 4) as int)").alias("rom_gb"),
            "list_price", "sale_price", (100 * F.col("l_discount")).alias("discount_pct"),
            flag[F.col("l_returnflag")].alias("seller_kind"),
            F.when(F.col("l_linenumber") == 7, "accessory").when(F.col("l_linenumber") == 6, "unknown").otherwise("device").alias("product_kind"),
            F.when(F.col("l_quantity") >= 49, "refurb").otherwise("new").alias("condition"), F.when(F.col("l_quantity") == 1, 1).otherwise(0).alias("is_bundle"),
            F.when(F.col("l_tax") >= 0.08, "card").when(F.col("l_tax") >= 0.04, "public").alias("price_scope"),
            F.when(F.col("l_linestatus") == "O", "accepted").otherwise("pending").alias("audit_status"),
        )
    )


OBS_SQL = """
  SELECT CAST(l_shipdate AS DATE) AS obs_date, n_name AS country, r_name AS currency, l_suppkey AS channel_id, l_partkey AS product_id,
    p_brand AS brand, p_type AS category, p_name AS title,
    CASE WHEN p_size % 10 <> 0 THEN CAST(2 + 2 * (p_size % 5) AS INTEGER) END AS ram_gb, CAST(64 << (p_size % 4) AS INTEGER) AS rom_gb,
    l_extendedprice / nullif(l_quantity, 0) AS list_price, l_extendedprice / nullif(l_quantity, 0) * (1 - l_discount) AS sale_price, 100 * l_discount AS discount_pct,
    CASE l_returnflag WHEN 'N' THEN 'self_operated' WHEN 'A' THEN 'brand_official' WHEN 'R' THEN 'third_party' END AS seller_kind,
    CASE WHEN l_linenumber = 7 THEN 'accessory' WHEN l_linenumber = 6 THEN 'unknown' ELSE 'device' END AS product_kind,
    CASE WHEN l_quantity >= 49 THEN 'refurb' ELSE 'new' END AS condition, CASE WHEN l_quantity = 1 THEN 1 ELSE 0 END AS is_bundle,
    CASE WHEN l_tax >= 0.08 THEN 'card' WHEN l_tax >= 0.04 THEN 'public' END AS price_scope,
    CASE WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'pending' END AS audit_status
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def over_obs(sql: str) -> str:
    """An oracle over ``obs``; ``sql`` starts with more CTEs (", x AS (...)") or with SELECT."""
    return f"WITH obs AS ({OBS_SQL})\n{sql}"

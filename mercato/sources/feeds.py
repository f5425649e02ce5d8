"""News feeds: every item of a channel, with its dates, from tables of texts or as a stream of files that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_text

ITEM = "title string, link string, guid string, pubDate string, category array<string>, description string"
FEED = f"channel struct<title string, link string, lastBuildDate string, item array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array')}>>>"
ITEMS = "feed string, place int, guid string, title string, link string, published timestamp, categories array<string>, summary string"
#: Formats of a date, the first that fits counts.
DATES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def published(said: Column) -> Column:
    """A feed's date in any of ``DATES``, whatever weekday is said before it; null where none fits."""
    said = F.regexp_replace(F.trim(said), "^[A-Za-z]{3,9}, *", "")
    return F.coalesce(*[F.try_to_timestamp(said, F.lit(f)) for f in DATES])


def feed_items(feeds: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``ITEMS``: a row for each item of each feed, in the feed's order from 1, after the columns of ``keep``.

    An item without a guid goes by its link, else by a hash of its title and date. A text that is no feed, is null, or has no items gives no
    rows; an item without a title, or whose date fits no format, keeps nulls. Links and titles that say nothing are null.
    """
    tag = F.regexp_replace(F.col(text), r"(?s)^.*?(?=<rss\b)", "")  # what stands before the feed: declarations and comments
    rows = feeds.select(*keep, F.from_xml(tag, FEED, {"rowTag": "rss", "mode": "PERMISSIVE"})["channel"].alias("c")).where("c is not null")
    each = rows.select(*keep, F.col("c.title").alias("feed"), F.posexplode("c.item").alias("at", "x"))
    title, link = as_text(F.trim("x.title")), as_text(F.trim("x.link"))
    guid = F.coalesce(as_text(F.trim("x.guid")), link, F.md5(F.concat_ws("|", title, "x.pubDate")))
    return each.select(*keep, "feed", (F.col("at") + 1).alias("place"), guid.alias("guid"), title.alias("title"), link.alias("link"), published(F.col("x.pubDate")).alias("published"), F.col("x.category").alias("categories"), F.col("x.description").alias("summary"))


def feed_stream(spark: SparkSession, path: str, files_at_once: int = 100, whole: bool = True) -> DataFrame:
    """``ITEMS`` of a folder as a stream, a feed for each file, or with ``whole`` false for each line.

    The files that were read are the offset, so none is read twice under one checkpoint.
    """
    raw = spark.readStream.format("text").option("wholetext", whole).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(path)
    return feed_items(raw)


def take_in(items: DataFrame, out: str, checkpoint: str, late: str = "30 days") -> None:
    """Append what is new of a stream of items to ``out``, each guid once within ``late`` of its date; items without a date are left out."""
    dated = items.where("published is not null").withWatermark("published", late)
    once = dated.dropDuplicatesWithinWatermark(["guid"])
    once.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").format("parquet").option("path", out).start().awaitTermination()

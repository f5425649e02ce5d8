"""Feeds with many items, all kinds of dates, broken ones; a stream that goes on where it stopped."""

from datetime import datetime

from mercato.sources.feeds import ITEMS, feed_items, feed_stream, take_in

FEED = """<?xml version="1.0"?><!-- made by hand --><rss version="2.0"><channel><title>News</title><link>http://n</link>
<item><title>One &amp; only</title><link>http://n/1</link><guid isPermaLink="false">g1</guid><pubDate>Sat, 03 Feb 2024 10:00:00 +0100</pubDate><category>a</category><category>b</category><description><![CDATA[<p>x</p>]]></description></item>
<item><title> </title><link>http://n/2</link><pubDate>2024-02-04T10:00:00Z</pubDate></item><item><title>Three</title><pubDate>soon</pubDate></item></channel></rss>"""


def rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    return sorted(feed_items(df, keep=("i",)).collect(), key=lambda r: (r.i, r.place))


def test_items(spark):
    got = rows(spark, [FEED, None, "", "no feed", "<rss><channel><title>empty</title></channel></rss>", FEED.replace("News", "Other")])
    assert [(r.i, r.feed, r.place) for r in got] == [(0, "News", 1), (0, "News", 2), (0, "News", 3), (5, "Other", 1), (5, "Other", 2), (5, "Other", 3)]
    one, two, three = got[:3]
    assert (one.title, one.guid, one.published, one.categories, one.summary) == ("One & only", "g1", datetime(2024, 2, 3, 9), ["a", "b"], "<p>x</p>")
    assert (two.title, two.guid, two.published) == (None, "http://n/2", datetime(2024, 2, 4, 10)) and (three.published, len(three.guid)) == (None, 32)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.xml").write_text(FEED.replace("g1", f"g{k // 2}").replace("http://n/2", f"http://n/x{k}"))
        take_in(feed_stream(spark, str(tmp_path / "in"), 1), f"{tmp_path}/out", f"{tmp_path}/state")
    got = [r.guid for r in spark.read.schema(ITEMS).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(["g0", "g1", "g2", *[f"http://n/x{k}" for k in range(5)]])

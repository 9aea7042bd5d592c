import pytest
from pyspark.sql import functions as F

from postmill.feed import Feed
from postmill.sources.store import Store

LISTING = "source string, pos long, title string, company string, location string, posted_date date, job_url string"


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(Store(spark, str(tmp_path / "store")).init())


def listings(spark, *rows):
    df = spark.createDataFrame([("A", i, t, "C", "L", d, u) for i, (t, d, u) in enumerate(rows)],
                               LISTING.replace("posted_date date", "posted_date string"))
    return df.withColumn("posted_date", F.col("posted_date").cast("date"))


def titles(df):
    return [r.title for r in df.collect()]


def test_feed(spark, feed):
    assert tuple(feed.insert_postings(listings(
        spark, ("a", "2024-01-02", "u"), ("b", None, "v"), ("c", None, "u"), (None, None, "w")))) == (2, 2)
    assert tuple(feed.insert_postings(listings(spark, ("a", None, "u"), ("d", "2024-01-09", "X/y")))) == (1, 1)
    assert titles(feed.all_postings()) == ["d", "a", "b"]
    assert feed.count() == 3 and feed.url_exists("u") and not feed.url_exists("w")
    assert titles(feed.posted_on("2024-01-09")) == ["d"]
    assert titles(feed.posted_within(3, "2024-01-05")) == ["d", "a"]
    assert titles(feed.search("D")) == ["d"]
    assert titles(feed.pending_details("x/Y")) == ["d"]

    rows = spark.createDataFrame([(1, "u", "text"), (2, "v", None), (3, "u", "no")], "job_id long, job_url string, description string")
    assert tuple(feed.insert_details(rows.filter("job_id < 3"))) == (2, 0)
    assert tuple(feed.insert_details(rows.filter("job_id = 3"))) == (0, 1)
    assert feed.detail_count() == 2 and titles(feed.pending_details()) == ["d"]
    assert feed.details_of(1).first().description == "text" and feed.all_details().count() == 2

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert feed.mark_sent(ids(1, 3, 3, 9)) == 2
    assert feed.unsent_count() == 1 and titles(feed.unsent()) == ["b"]
    assert feed.reset_sent_without_details() == 1
    assert sorted(titles(feed.unsent())) == ["b", "d"]
    assert {r.title: r.outcome for r in feed.select_for_delivery(["d"]).collect()} == {"b": "skip", "d": "send"}

    assert feed.delete_empty_details() == 1 and feed.detail_count() == 1
    assert feed.clear_postings() == 3 and feed.count() == 0 and feed.detail_count() == 0
    assert tuple(feed.insert_postings(listings(spark, ("a", None, "u")))) == (1, 0)
    assert feed.all_postings().first().id == 4
    assert feed.clear_details() == 0


def test_clearing_may_leave_details(spark, feed):
    feed.insert_postings(listings(spark, ("a", None, "u")))
    feed.insert_details(spark.createDataFrame([(1, "u")], "job_id long, job_url string"))
    assert feed.clear_postings(keep_orphans=True) == 1 and feed.detail_count() == 1
    feed.insert_postings(listings(spark, ("a", None, "u")))
    # The left-over row still owns the URL, so the posting cannot get details.
    refused = spark.createDataFrame([(2, "u")], "job_id long, job_url string")
    assert tuple(feed.insert_details(refused)) == (0, 1)

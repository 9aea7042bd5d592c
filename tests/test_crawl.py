from pyspark.sql import functions as F

from postmill.operators import crawl

SCHEMA = "site string, crawl_id long, scroll_no int, height long, pos long, url string, card_lines array<string>"
AS_OF = "2024-01-31"


def log(spark, *scrolls, crawl_id=1):
    """Scrolls as (height, [(url, lines)])."""
    rows = [("A", crawl_id, n + 1, h, p, url, lines)
            for n, (h, cards) in enumerate(scrolls) for p, (url, lines) in enumerate(cards)]
    return spark.createDataFrame(rows, SCHEMA)


def card(url, *lines):
    return url, list(lines)


def test_last_visible_date(spark):
    df = log(spark, (1, [card("a", "T", "01-01-2024"), card("b", "x 02-01-2024", "32-13-2024", " 30-01-2024 late ", "dünən")]),
             (2, [card("c", "T")]))
    rows = {r.scroll_no: (str(r.last_date), r.last_text) for r in crawl.last_visible_date(df, AS_OF).collect()}
    assert rows == {1: ("2024-01-30", "30-01-2024 late"), 2: ("None", None)}


def test_cutoff_by_age(spark):
    df = log(spark, (1, [card("a", "T", "18-01-2024")]), (2, [card("b", "T", "17-01-2024")]), (3, [card("c", "T", "01-01-2024")]))
    assert crawl.cutoff_by_age(df, 14, AS_OF).first().age_cutoff == 2
    assert crawl.cutoff_by_age(df, 99, AS_OF).first().age_cutoff is None


def test_stalled(spark):
    one = [card("a", "T")]
    heights = [5, 5, 5, 6, 6, 6, 6, 6]
    df = log(spark, *[(h, one) for h in heights])
    assert crawl.cutoff_stalled(df, streak=1).first().stall_cutoff == 2
    assert crawl.cutoff_stalled(df, streak=3, distinct_urls=True).first().stall_cutoff == 7
    assert crawl.cutoff_stalled(df, streak=9).first().stall_cutoff is None


def test_growth_and_cutoff(spark):
    a, b, c = (card(x, "T", "30-01-2024") for x in "abc")
    df = log(spark, (1, [a]), (2, [a, b]), (2, [b, a]), (3, [a, b, c]))
    rows = [(r.scroll_no, r.new_urls, r.total_urls) for r in crawl.distinct_growth(df).orderBy("scroll_no").collect()]
    assert rows == [(1, 1, 1), (2, 1, 2), (3, 0, 2), (4, 1, 3)]
    kept = crawl.apply_cutoff(df, AS_OF, target_days=14)
    assert sorted((r.url, r.scroll_no) for r in kept.collect()) == [("a", 1), ("b", 2)]


def test_scroll_limit_and_hot_crawl(spark):
    """One crawl holds most rows; windows see one row per scroll."""
    df = spark.range(20000).select(
        F.lit("A").alias("site"), (F.col("id") % 10 == 0).cast("long").alias("crawl_id"),
        (F.col("id") % 200 + 1).cast("int").alias("scroll_no"), F.col("id").alias("height"), F.col("id").alias("pos"),
        F.col("id").cast("string").alias("url"), F.array(F.lit("T")).alias("card_lines"))
    kept = crawl.apply_cutoff(df, AS_OF, max_scrolls=30)
    assert kept.count() == df.filter("scroll_no <= 30").count()
    assert kept.agg(F.max("scroll_no")).first()[0] == 30


def test_facts_cover_scrolls_beyond_any_bound(spark):
    df = spark.range(1, 121).select(
        F.lit("A").alias("site"), F.lit(1).cast("long").alias("crawl_id"), F.col("id").cast("int").alias("scroll_no"),
        F.col("id").alias("height"), F.lit(0).cast("long").alias("pos"), F.col("id").cast("string").alias("url"),
        F.array(F.lit("T")).alias("card_lines"))
    assert crawl.distinct_growth(df).count() == 120
    assert crawl.last_visible_date(df, AS_OF).count() == 120


def test_each_site_has_its_own_rule(spark):
    """Both crawls are longer than their bounds; cards never stand still."""
    df = spark.range(1, 131).select(
        F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("site"), F.lit(1).cast("long").alias("crawl_id"),
        F.col("id").cast("int").alias("scroll_no"), F.col("id").alias("height"), F.lit(0).cast("long").alias("pos"),
        F.col("id").cast("string").alias("url"), F.array(F.lit("T")).alias("card_lines"))
    kept = crawl.apply_site_rules(df, AS_OF, 10)
    assert {r.site: r.n for r in kept.groupBy("site").agg(F.count("*").alias("n")).collect()} == {"A": 100, "B": 30, "C": 130}

import pytest
from pyspark.sql import functions as F

from postmill.operators import listing
from postmill.sources.readers import listings_from_payload


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def cards(spark, *texts, inner=None):
    return spark.createDataFrame(
        [(i, f"/vacancies/{i}", inner or t, t) for i, t in enumerate(texts)],
        "page_id long, href string, inner string, text string")


def test_extract_links(spark):
    html = """<!-- <a href="/c">c</a> --><a class=x href='/1?a=1&amp;b=2'><h3>T</h3>x</a> <A HREF=/2>two
 lines</A><a name="n">none</a><a data-href="/no" href="/3"></a><script>'<a href="/s">s</a>'</script>"""
    rows = listing.extract_link_cards(pages(spark, html)).orderBy("pos").collect()
    assert [(r.pos, r.href, r.text) for r in rows] == [(0, "/1?a=1&b=2", "Tx"), (1, "/2", "two\n lines"), (2, "/3", "")]
    assert rows[0].inner == "<h3>T</h3>x"


def test_rendered_text_breaks_at_blocks(spark):
    html = '<a href="/1"><h3>T</h3><div>C ● L</div><span>a</span>b</a>'
    row = listing.card_lines(listing.extract_link_cards(pages(spark, html), rendered=True)).first()
    assert row.lines == ["T", "C ● L", "ab"]


def test_filters(spark):
    df = spark.createDataFrame([("/job/1",), ("/JOB/1",), ("/x?vacancy=3",), ("https://site.b/about",), ("/x",)], "href string")
    hrefs = lambda d: [r.href for r in d.collect()]
    assert hrefs(listing.filter_job_links(df, "site.b")) == ["/job/1", "https://site.b/about"]
    assert hrefs(listing.filter_job_links(df, "site.b", lenient=True)) == ["/job/1", "/JOB/1", "/x?vacancy=3", "https://site.b/about"]


@pytest.mark.parametrize(("html", "tier", "hrefs"), [
    ('<a href="/x?id=1">a</a><a href="/job/1">b</a><a href="/job/1">c</a><a href="/elan/2">d</a>', 1, ["/job/1", "/elan/2"]),
    ('<a href="/x?id=1">a</a><a href="/x?id=1">b</a><main><a href="/m">m</a></main>', 2, ["/x?id=1"]),
    ('<a href="/o">o</a><main><a href="/m">m</a><a href="/m">m</a></main>', 3, ["/m", "/m"]),
    ('<a href="/o">o</a><a href="/o">p</a><main>none</main>', 4, ["/o", "/o"]),
])
def test_tiers(spark, html, tier, hrefs):
    rows = listing.link_strategy_fallback(pages(spark, "no links", html)).orderBy("pos").collect()
    assert {r.tier for r in rows} == {tier} and [r.href for r in rows] == hrefs


def test_tiers_need_one_pass(spark, plan, tmp_path):
    pages(spark, "x").write.parquet(str(tmp_path / "p"))
    text = plan(listing.link_strategy_fallback(spark.read.parquet(str(tmp_path / "p"))))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_first_n(spark):
    html = "".join(f'<a href="/vacancies/{i}">x</a><a href="/o">o</a>' for i in range(5))
    rows = listing.first_n_cards(pages(spark, html), 3, paths=["/vacancies/"]).collect()
    assert [r.href for r in rows] == ["/vacancies/0", "/vacancies/1", "/vacancies/2"]


def test_card_lines(spark):
    df = listing.card_lines(cards(spark, "one", " a \n\n \n b ", ""))
    assert [r.lines for r in df.collect()] == [["a", "b"]]


def fields(df):
    r = df.first()
    return r.title, r.company, r.location, str(r.posted_date)


@pytest.mark.parametrize(("text", "expected"), [
    ("T\nA ● B\nC ● D\n24-01-2026", ("T", "C", "D", "2026-01-24")),
    ("T\nA ● B\nX ● 24-01-2026", ("T", "A", "B", "2026-01-24")),
    ("T\nA ●", ("T", "A", "", "None")),
    ("T\nplain\n24-01-2026\ndünən", ("T", "Unknown", "Unknown", "2024-01-30")),
    ("T\nA ● B ● C", ("T", "A", "B", "None")),
])
def test_separator_cards(spark, text, expected):
    df = listing.card_fields_separator(listing.card_lines(cards(spark, text)), "2024-01-31")
    assert fields(df) == expected


def test_heading_is_the_title(spark):
    df = cards(spark, "first\nA ● B", inner="<b>first</b><h3 class=t> Head &amp; tail </h3>")
    assert fields(listing.card_fields_separator(listing.card_lines(df), "2024-01-31"))[0] == "Head & tail"


def test_positional_cards(spark):
    df = listing.card_fields_positional(listing.card_lines(cards(spark, "T\nC", "T\nC\nL\nM")))
    assert [(r.title, r.company, r.location) for r in df.collect()] == [("T", "C", "Unknown"), ("T", "C", "L")]


@pytest.mark.parametrize(("text", "location"), [
    ("Remote dev\nC\nL", "Remote dev"), ("T\nC\nBAKU\nin Gəncə", "in Gəncə"), ("T\nC\nL", "L"),
])
def test_place_words(spark, text, location):
    df = listing.card_fields_positional(listing.card_lines(cards(spark, text)))
    assert listing.location_keyword_override(df).first().location == location


def test_skip_reasons(spark):
    count = lambda df: {r.reason: r.cards for r in df.collect()}
    base = cards(spark, "a\nb", "a", "a\nb")
    base = base.withColumn("href", F.when(F.col("page_id") == 2, "/x").otherwise(F.col("href")))
    assert count(listing.card_skip_reasons(base)) == {"kept": 1, "few_lines": 1, "no_url": 1}
    same = spark.createDataFrame([(1, h, t) for h, t in [
        ("/job/1", "a\nb"), ("/job/1", "a"), ("/job/1", "c\nd"), ("/x", "a\nb"), (None, "a\nb"), ("/job/2", "a\nb")]],
        "page_id long, href string, text string")
    assert count(listing.card_skip_reasons(same, "positional")) == {"kept": 2, "parse": 3, "duplicate": 1}


def test_sources(spark, tmp_path):
    good = spark.createDataFrame([("a", 1)], "title string, pos long")
    opened, failed = listing.read_guarded({
        "good": lambda: good, "lost": lambda: spark.read.parquet(str(tmp_path / "nothing"))})
    both = listing.union_sources({**opened, "other": spark.createDataFrame([("b",)], "title string")})
    assert failed == ["lost"]
    assert sorted((r.source, r.title, r.pos) for r in both.collect()) == [("good", "a", 1), ("other", "b", None)]
    summary = {r.source: (r.rows, r.failed) for r in listing.source_summary(spark, both, ["good", "other", "lost"]).collect()}
    assert summary == {"good": (1, False), "other": (1, False), "lost": (0, True)}


def test_sample_head(spark):
    df = spark.range(10).select(F.col("id").alias("pos"), F.when(F.col("id") < 2, "s").otherwise("t").alias("source"))
    rows = {(r.source, r.pos, r.more) for r in listing.sample_head(df).collect()}
    assert rows == {("s", 0, 0), ("s", 1, 0), ("t", 2, 5), ("t", 3, 5), ("t", 4, 5)}


def test_json_payload(spark):
    df = spark.createDataFrame([('[{"url":"/job/1","title":"T","company":""},{"title":"U"}]',), ("broken",)], "payload string")
    rows = listings_from_payload(df, "payload", "https://h", "B").orderBy("pos").collect()
    assert [(r.job_url, r.title, r.company, r.location) for r in rows] == [
        ("https://h/job/1", "T", "Unknown", "Unknown"), ("", "U", "Unknown", "Unknown")]

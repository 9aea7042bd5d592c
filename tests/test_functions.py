import datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, keywords, numbers, text


def evaluate(spark, expression, value, type_="string"):
    return spark.createDataFrame([(value,)], f"c {type_}").select(expression(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("value", ["  a b  \n", " x\t", "", " \n", "\x1cq\x1f"])
def test_strip_is_unicode_strip(spark, value):
    assert evaluate(spark, text.strip, value) == value.strip()


@pytest.mark.parametrize(("value", "word", "hit"), [
    ("a.B", "A.b", True), ("axb", "a.b", False),
    ("take 50 of", "50%of", True), ("axb", "a_b", True), ("ab", "a_b", False),
    (r"a\b", r"a\b", True), ("aXb", r"a\b", False),
    ("ƏLI", "əli", False), ("Əli", "Əli", True), (None, "x", None), ("a\nb", "a_b", True),
])
def test_like_contains(spark, value, word, hit):
    assert evaluate(spark, lambda c: text.like_contains(c, word), value) is hit


def test_default_unknown_and_absolute_url(spark):
    assert [evaluate(spark, text.default_unknown, x) for x in (None, "", "x")] == ["Unknown", "Unknown", "x"]
    full = lambda x: evaluate(spark, lambda c: text.absolute_url(c, "https://h/"), x)
    assert [full("/a"), full("https://o/a"), full("a")] == ["https://h/a", "https://o/a", "a"]


@pytest.mark.parametrize(("markup", "plain"), [
    ("a &amp;lt; b", "a &lt; b"), ("&#1513;&#x41;&eacute;&nope;&", "שAé&nope;&"),
    ("&#xD800;x", "&#xD800;x"), ("&nbsp;", " "), ("no entity", "no entity"), (None, None), ("&#0;", "&#0;"),
])
def test_decode_entities(spark, markup, plain):
    assert evaluate(spark, text.decode_entities, markup) == plain


def test_visible_text(spark):
    page = "<p>a<!-- <b>no</b> --> <b>c</b></p><script>x('<p>')</script><STYLE>y</STYLE> d &lt;e&gt; "
    assert evaluate(spark, text.visible_text, page) == "a c d <e> "
    assert evaluate(spark, lambda c: text.visible_text(c, "|"), page) == "a| |c| d <e> "
    assert evaluate(spark, lambda c: text.visible_text(c, "|", stripped=True), page) == "a|c|d <e>"


@pytest.mark.parametrize(("value", "date"), [
    ("24-01-2026", datetime.date(2026, 1, 24)), ("31-02-2026", None), ("on 24-01-2026 at 9", datetime.date(2026, 1, 24)),
    (" DÜNƏN ", datetime.date(2024, 1, 30)), ("Bugün", datetime.date(2024, 1, 31)), ("bugün!", None),
    ("", None), (None, None), ("32-13-2026 05-01-2026", None),
])
def test_parse_posted_date(spark, value, date):
    assert evaluate(spark, lambda c: dates.parse_posted_date(c, "2024-01-31"), value) == date


@pytest.mark.parametrize(("value", "number"), [
    ("208", 208), ("1.2K", 1200), ("1,234", 1234), ("3M", 3000000), ("1.234", None), (",", None), ("0", None),
    ("2.3k", 2300), ("x", None), ("1.2.3K", None),
])
def test_compact_number(spark, value, number):
    assert evaluate(spark, numbers.compact_number, value) == number


@pytest.mark.parametrize(("values", "number"), [
    (["0", "7"], 7), (["1.234", "7"], None), (["0"], None), ([], None), (["0", "1.5K", "3"], 1500),
])
def test_first_compact_number(spark, values, number):
    assert evaluate(spark, numbers.first_compact_number, values, "array<string>") == number


@pytest.mark.parametrize(("value", "span"), [
    ("pay 500 - 900 azn now", "500 - 900 azn"), ("1000MANAT", "1000MANAT"), ("500 eur", None), ("1-2 AZN", "1-2 AZN"),
])
def test_salary_span(spark, value, span):
    assert evaluate(spark, numbers.salary_span, value) == span


def test_retry_after(spark):
    seen = [evaluate(spark, numbers.retry_after_seconds, x)
            for x in ("Flood control exceeded. Retry in 230 seconds", "other", None)]
    assert seen == [230, 0, 0]


@pytest.mark.parametrize(("words", "title", "description", "hit"), [
    ([], "x", None, True), (["sql"], "mysql", None, False), (["sql"], "Learn SQL.", None, True),
    (["sql"], "əsql", None, False), (["sql"], None, "sqlə", False), (["c++"], "c++ dev", None, False),
    (["data entry"], "Data", "Entry work", True), (["data entry"], "data", None, False),
    ([r"a\Eb"], r"x a\eb", None, False), (["a.b"], "axb", None, False),
])
def test_match_any_keyword(spark, words, title, description, hit):
    df = spark.createDataFrame([(title, description)], "t string, d string")
    match = keywords.match_any_keyword(F.col("t"), F.col("d"), F.lit(None).cast("string"), words)
    assert df.select(match.alias("r")).first().r is hit


def test_keyword_lists(spark):
    assert keywords.parse_keyword_list(" Python, ,SQL ,") == ["python", "sql"]
    assert keywords.parse_keyword_list() == ["python", "sql"]
    assert keywords.parse_keyword_list("") == []
    assert evaluate(spark, keywords.keyword_list, " A,, b\n") == ["a", "b"]
    assert evaluate(spark, keywords.keyword_list, None) == ["python", "sql"]

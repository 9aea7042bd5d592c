import pytest
from pyspark.sql import functions as F

from postmill.operators import notify

SCHEMA = ("id long, title string, company string, location string, job_url string, posted_date date, "
          "description string, requirements string, job_type string, views long")


def message(spark, site_root="https://h", escape_html=False, **given):
    base = {"id": 1, "title": "T", "company": "C", "location": "L"}
    base.update(given)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(base.get(n) for n in names)], SCHEMA)
    return notify.with_message(df, site_root, escape_html).first().message


def test_lines(spark):
    assert message(spark, company=None, views=0) == "💼 <b>T</b>\n🏢 None\n📍 L"
    assert message(spark, title="a<b", job_type="x", views=5, job_url="/v/1") == (
        '💼 <b>a<b</b>\n🏢 C\n📍 L\n⏰ x\n👁 Baxış: 5\n\n🔗 <a href="https://h/v/1">Ətraflı bax</a>')
    assert "a&lt;b &amp; c" in message(spark, title="a<b & c", escape_html=True)
    assert message(spark, job_type="", description="") == "💼 <b>T</b>\n🏢 C\n📍 L"


def reference_budget(header, link, description, requirements):
    """Plain restatement of the length rule."""
    space = 4096 - (len(header) + len(link) + 50)
    share = space // 2 if description and requirements else space
    cut = lambda t: t if len(t) <= share else t[:max(share - 3, 0)] + "..."
    parts = [header]
    if description:
        parts.append(f"\n📝 <b>Təsvir:</b>\n{cut(description)}")
    if requirements:
        parts.append(f"\n✅ <b>Tələblər:</b>\n{cut(requirements)}")
    return "\n".join([*parts, link] if link else parts)


@pytest.mark.parametrize(("d", "r", "title", "url"), [
    ("d" * 5000, None, "T", None), ("d" * 5000, "r" * 5000, "T", "u"), (None, "😀" * 4100, "T", "u"),
    ("d" * 100, "r" * 5000, "T", "u"), ("d" * 50, None, "t" * 5000, None), ("x", "y", "t" * 4100, "u"),
])
def test_budget(spark, d, r, title, url):
    link = f'\n🔗 <a href="{url}">Ətraflı bax</a>' if url else ""
    expected = reference_budget(f"💼 <b>{title}</b>\n🏢 C\n📍 L", link, d, r)
    got = message(spark, title=title, description=d, requirements=r, job_url=url)
    assert got == expected
    if len(title) < 100:
        assert len(got) <= 4096


def unsent(spark):
    return spark.createDataFrame([
        (1, "sql dev", None, None), (2, "chef", "cook", None), (3, "chef", "", None), (4, "x", None, "know SQL")],
        "id long, title string, description string, requirements string")


def test_selection_and_counts(spark):
    chosen = notify.select_for_delivery(unsent(spark), ["sql"])
    assert {r.id: (r.outcome, r.mark) for r in chosen.collect()} == {
        1: ("send", False), 2: ("skip", True), 3: ("skip", False), 4: ("send", False)}
    assert [r.job_id for r in notify.skipped_log(chosen, F.current_timestamp()).collect()] == [2]
    assert tuple(notify.delivery_counts(chosen).first()) == (2, 2, 1, 0)


def test_outcomes(spark):
    outbox = spark.createDataFrame([(1,), (4,), (5,)], "job_id long")
    results = spark.createDataFrame([(1, True, None), (4, False, "boom"), (4, False, "boom"), (9, True, None)],
                                    "job_id long, ok boolean, error string")
    log = notify.apply_outcomes(outbox, results, F.current_timestamp())
    assert sorted((r.job_id, r.outcome, r.error) for r in log.collect()) == [(1, "sent", None), (4, "failed", "boom")]
    chosen = notify.select_for_delivery(unsent(spark), ["sql"])
    assert tuple(notify.delivery_counts(chosen, log).first()) == (1, 2, 1, 1)

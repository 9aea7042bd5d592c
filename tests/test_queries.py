import datetime

from pyspark.sql import functions as F

from postmill.operators import mutate, queries

POSTING = "id long, title string, company string, location string, job_url string, posted_date date, is_sent boolean"
DETAIL = "job_id long, job_url string, description string, requirements string, views long"
D = datetime.date


def postings(spark, *rows):
    return spark.createDataFrame(list(rows), POSTING)


def three(spark):
    return postings(
        spark,
        (1, "Chef", "A", "x", "https://a.b/1", D(2024, 1, 24), False),
        (2, "SQL dev", "Ə", "y", "https://A.B/2", D(2024, 2, 5), True),
        (3, "Guard", None, "z", None, None, False))


def details(spark, *rows):
    return spark.createDataFrame(list(rows), DETAIL)


def ids(df, name="id"):
    return [r[name] for r in df.collect()]


def test_dates(spark):
    p = three(spark)
    assert ids(queries.posted_within(p, 7, "2024-01-31")) == [2, 1]
    assert ids(queries.posted_on(p, D(2024, 1, 24))) == [1]
    assert ids(queries.newest_first(p)) == [2, 1, 3]


def test_search(spark):
    p = three(spark)
    assert ids(queries.search_text(p, "sql")) == [2]
    assert ids(queries.search_text(p, "ə")) == []
    assert ids(queries.search_text(p, "Ə")) == [2]
    assert ids(queries.search_text(p, "c_ef")) == [1]


def test_pending(spark):
    p, d = three(spark), details(spark, (2, "u", "t", None, 0))
    assert ids(queries.pending_details(p, d)) == [1, 3]
    assert ids(queries.pending_details(p, details(spark), "A.b")) == [2, 1]


def test_pending_and_detailed_are_all_postings(spark):
    p, d = three(spark), details(spark, (1, "u", "t", None, 0), (2, "v", None, None, 1))
    assert queries.pending_details(p, d).count() + queries.postings_with_details(p, d).count() == p.count()


def test_unsent_with_details_columns(spark):
    rows = queries.unsent_with_details(three(spark), details(spark, (1, "u", "t", None, 0)))
    assert ids(rows) == [1, 3]
    assert "education" not in rows.columns and "scraped_at" not in rows.columns
    assert rows.filter("id = 3").first().description is None


def test_not_in_details(spark):
    p = three(spark)
    assert ids(queries.not_in_details(p, details(spark, (1, "u", None, None, 0)))) == [2, 3]
    assert ids(queries.not_in_details(p, details(spark, (1, "u", None, None, 0), (None, "v", None, None, 0)))) == []
    assert ids(queries.not_in_details(p, details(spark))) == [1, 2, 3]


def test_column_pruning(spark, plan, tmp_path):
    three(spark).write.parquet(str(tmp_path / "p"))
    details(spark, (1, "u", "long text", None, 0)).write.parquet(str(tmp_path / "d"))
    text = plan(queries.pending_details(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "d"))))
    assert "ReadSchema: struct<job_id:bigint>" in text
    pushed = plan(queries.posted_within(spark.read.parquet(str(tmp_path / "p")), 7, "2024-01-31"))
    assert "GreaterThanOrEqual(posted_date,2024-01-24)" in pushed


def test_counts(spark):
    p = three(spark)
    assert queries.posting_count(p).first().n == 3
    assert queries.unsent_count(p).first().n == 2
    assert queries.detail_count(details(spark)).first().n == 0
    assert queries.limit_one(p).count() == 1
    assert ids(queries.detail_by_id(details(spark, (1, "u", None, None, 0), (2, "v", None, None, 0)), 2), "job_id") == [2]


def test_delete_empty_details(spark):
    d = details(spark, (1, "a", "", None, 0), (2, "b", None, None, 0), (9, "o", None, None, 0))
    assert ids(mutate.delete_empty_details(d), "job_id") == [1]
    assert ids(mutate.empty_details(d), "job_id") == [2, 9]
    assert sorted(ids(mutate.delete_empty_details(d, three(spark), "a.b"), "job_id")) == [1, 9]


def test_mark_and_reset(spark):
    p, at = three(spark), F.current_timestamp()
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert ids(mutate.mark_sent(p, one(3, 3, 77), at), "job_id") == [3]
    assert ids(mutate.mark_sent(p, one(2), at), "job_id") == [2]
    assert ids(mutate.mark_sent(p, one(), at), "job_id") == []
    assert ids(mutate.reset_sent_without_details(p, details(spark, (1, "a", None, None, 0)), at), "job_id") == [2]


def test_delivery_state(spark):
    at = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([
        (1, "sent", 1, at), (1, "reset", 2, at), (2, "reset", 1, at), (2, "skipped", 2, at),
        (3, "sent", 1, at), (3, "failed", 2, at), (4, "failed", 1, at)],
        "job_id long, outcome string, batch_id long, at timestamp")
    state = {r.job_id: r.is_sent for r in mutate.delivery_state(log).collect()}
    assert state == {1: False, 2: True, 3: True}
    flags = {r.id: r.is_sent for r in mutate.with_sent_flag(three(spark), log).collect()}
    assert flags == {1: False, 2: True, 3: True}


def test_clear(spark):
    p, d = three(spark), details(spark, (1, "a", None, None, 0), (9, "o", None, None, 0))
    left, orphans = mutate.clear_postings(p, d)
    assert left.count() == 0 and ids(orphans, "job_id") == [9]
    assert mutate.clear_postings(p, d, keep_orphans=True)[1].count() == 2
    assert mutate.clear_details(d).count() == 0

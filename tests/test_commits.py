"""Commits of the store: what readers see, and what happens when two write at once or a writer dies."""

import pytest
from pyspark.sql import functions as F

from postmill.feed import Feed
from postmill.sources import staging
from postmill.sources.store import Changed, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store")).init()


def postings(spark, store, *ids, source="A"):
    rows = spark.createDataFrame([(i, f"t{i}", f"u{i}") for i in ids], "id long, title string, job_url string")
    return rows.select(*[c if c in rows.columns else F.lit(source if c == "source" else None).cast(f.dataType).alias(c)
                         for c, f in ((f.name, f) for f in store.schema("postings").fields) if c != "batch_id"])


def ids(frame):
    return sorted(r[0] for r in frame.select(frame.columns[0]).collect())


def test_a_file_is_created_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "f" / "a.json")
    assert staging.create_once(spark, path, "one ü") and not staging.create_once(spark, path, "two")
    assert staging.read_text(spark, path) == "one ü" and staging.names(spark, str(tmp_path / "f")) == ["a.json"]
    assert staging.names(spark, str(tmp_path / "none")) == []


def test_two_publishers_of_one_version(spark, store):
    store.append("postings", postings(spark, store, 1, 2, 3), 0)
    first, second = store.change(), store.change()
    first.publish("postings", store.read("postings").filter("id > 1"))
    second.publish("postings", store.read("postings").filter("id > 2"))
    first.commit()
    with pytest.raises(Changed):
        second.commit()
    assert ids(store.read("postings").select("id")) == [2, 3] and store.version("postings") == 1
    store.publish("postings", store.read("postings").filter("id > 2"))
    assert ids(store.read("postings").select("id")) == [3] and store.highest_id("postings").first().max_id == 3


def test_rows_of_a_round_survive_a_publisher_that_did_not_see_them(spark, store):
    store.append("postings", postings(spark, store, 1, 2), 0)
    slow = store.change()
    slow.publish("postings", store.read("postings").filter("id = 2"))
    store.append("postings", postings(spark, store, 5), 1)
    slow.commit()
    assert ids(store.read("postings").select("id")) == [2, 5]


def test_writers_at_the_same_time_lose_nothing(spark, store):
    changes = [store.change() for _ in range(3)]
    for i, change in enumerate(changes):
        change.put("postings", postings(spark, store, i), i)
    numbers = [change.commit() for change in changes]
    assert numbers == [1, 2, 3] and ids(store.read("postings").select("id")) == [0, 1, 2]


def test_nothing_is_seen_of_a_writer_that_died(spark, store):
    store.append("postings", postings(spark, store, 1), 0)
    before = store.manifest()
    change = store.change()
    change.put("postings", postings(spark, store, 2), 1)
    with pytest.raises(Exception, match="no_such_column"):
        change.put("details", spark.range(1).select("no_such_column"), 1)
    assert store.manifest() == before and ids(store.read("postings").select("id")) == [1]
    pinned = store.pin()
    store.append("postings", postings(spark, store, 7), 2)
    assert ids(pinned.read("postings").select("id")) == [1]


def test_sweep_removes_what_no_commit_names(spark, store):
    for rows in ((1, 2), (1,), (3,)):
        store.append("postings", postings(spark, store, *rows), 0)
    assert store.sweep(commits=100, older_than=0) == 0
    assert store.sweep(commits=1, older_than=3600) == 0
    assert store.sweep(commits=1, older_than=0) == 2
    assert ids(store.read("postings").select("id")) == [3]


def test_every_action_by_hand_counts(spark, store):
    store.append("postings", postings(spark, store, 1, 2), -1)
    feed, one = Feed(store), spark.createDataFrame([(1,)], "id long")
    state = lambda: {r.id: r.is_sent for r in feed.postings().collect()}
    seen = []
    for act in (lambda: feed.mark_sent(one), feed.reset_sent_without_details, lambda: feed.mark_sent(one), feed.reset_sent_without_details,
                lambda: feed.mark_sent(one), lambda: feed.mark_sent(one)):
        assert act() == 1
        seen.append(state()[1])
    assert seen == [True, False, True, False, True, True] and not state()[2]
    feed.reset_sent_without_details()
    assert not state()[1]


def test_results_count_once_however_often_they_come(spark, store):
    from postmill.streaming import rounds

    outbox = spark.createDataFrame([(i, "c", "m") for i in range(1, 5)], "job_id long, chat_id string, message string")
    store.append("outbox", outbox.withColumn("rendered_at", F.current_timestamp()), 3)
    result = lambda *rows: spark.createDataFrame(list(rows), "job_id long, ok boolean, error string")
    for part in (result((1, True, None)), result((2, False, "x")), result((1, True, None), (3, True, None)), result((2, True, None)), result((2, False, "x")), result((9, True, None))):
        rounds.deliver(store, part, 3)
    log = store.read("delivery")
    assert sorted((r.job_id, r.outcome) for r in log.collect()) == [(1, "sent"), (2, "failed"), (2, "sent"), (3, "sent")]

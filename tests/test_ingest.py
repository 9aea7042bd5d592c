import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import ingest

BATCH = "pos long, title string, job_url string"


def batch(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], BATCH)


def stored(spark, *urls):
    return spark.createDataFrame([(i + 1, u) for i, u in enumerate(urls)], "id long, job_url string")


def kept(df):
    return sorted(r.pos for r in df.collect())


@pytest.mark.parametrize(("rows", "have", "expected"), [
    ([("a", "u"), ("b", "u")], [], [0]),
    ([("a", None), ("b", None)], [None], [0, 1]),
    ([(None, "u"), ("b", "u")], [], [1]),
    ([("a", ""), ("b", ""), ("c", "s")], ["s"], [0]),
    ([("a", "/x"), ("b", "https://host/x")], [], [0, 1]),
    ([("a", None), ("a", None), (None, None)], ["x"], [0, 1]),
])
def test_accept_new(spark, rows, have, expected):
    arriving = batch(spark, *rows)
    accepted = ingest.accept_new(arriving, stored(spark, *have))
    assert kept(accepted) == expected
    counts = ingest.ingest_counts(arriving, accepted).first()
    assert (counts.inserted, counts.skipped) == (len(expected), len(rows) - len(expected))


@pytest.mark.parametrize("unique", [True, False])
def test_hot_and_null_keys(spark, unique):
    """One key and the NULL key hold a third of the rows each."""
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    result = ingest.dedupe_first_wins(df, "k", unique_order=unique)
    assert result.filter("k = 'hot'").collect()[0].pos == 0
    assert result.filter("k is null").count() == n / 3
    assert result.count() == 1 + 2 * n / 3


def test_equal_places_do_not_lose_null_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "k")], "pos long, k string")
    assert ingest.dedupe_first_wins(df, "k").count() == 3


def test_rank_is_cut_before_the_shuffle(spark, plan):
    text = plan(ingest.dedupe_first_wins(batch(spark, ("a", "u")), "job_url"))
    assert "row_number(), 1, Partial" in text


def test_ids_continue_in_arrival_order(spark):
    arriving = spark.range(1000).select(
        (999 - F.col("id")).alias("pos"), F.lit("t").alias("title"), F.col("id").cast("string").alias("job_url")).repartition(7)
    new = ingest.ingest_new(arriving, stored(spark, "x", "y"))
    assert [(r.id, r.pos) for r in new.orderBy("id").collect()] == [(i + 3, i) for i in range(1000)]


def test_ingest_twice_changes_nothing(spark):
    arriving = batch(spark, ("a", "u"), ("b", "v"), ("c", "u"))
    first = ingest.ingest_new(arriving, stored(spark, "w"))
    again = ingest.accept_new(arriving, stored(spark, "w").union(first.select("id", "job_url")))
    assert again.count() == 0


def details(spark, *rows):
    return spark.createDataFrame(list(rows), "job_id long, job_url string")


def test_ingest_details(spark):
    have = details(spark, (1, "a"), (None, "n"), (8, None))
    new = details(spark, (1, "z"), (2, "a"), (3, "c"), (3, "c"), (4, None), (4, None), (5, None), (None, "d"), (None, "d"), (None, "n"), (8, "y"),
                  (None, None), (None, None))
    rows = ingest.ingest_details(new, have).collect()
    expected = details(spark, (3, "c"), (4, None), (5, None), (None, "d"), (None, None), (None, None))
    assert sorted(map(str, rows)) == sorted(map(str, expected.collect()))


def one_by_one(rows, have):
    ids, urls = {i for i, _ in have if i is not None}, {u for _, u in have if u is not None}
    before, out = (set(ids), set(urls)), []
    for i, u in rows:
        good = i not in ids and u not in urls
        out.append("stored" if i in before[0] or u in before[1] else "accepted" if good else "taken")
        if good:
            ids |= {i} - {None}
            urls |= {u} - {None}
    return out


@pytest.mark.parametrize("rows", [
    [(1, "u"), (1, "v"), (2, "w")], [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c")], [(1, "a"), (1, None), (1, None)],
    [(1, "a"), (None, "a"), (None, "b"), (None, "b")], [(None, None), (None, None)], [], [(9, "q"), (4, "z"), (9, "z"), (4, "q")]])
def test_details_are_accepted_one_by_one(spark, rows):
    have = [(9, "z"), (None, "n"), (8, None)]
    batch = spark.createDataFrame([(k, *r, "extra") for k, r in enumerate(rows)], "pos long, job_id long, job_url string, _extra string")
    got = ingest.accept_details(batch, details(spark, *have), ["pos"]).orderBy("pos").collect()
    assert [r.outcome for r in got] == one_by_one(rows, have)


def test_large_tangled_batches_match_row_by_row(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, *range(60)]), rng.choice([None, "hot", *map(str, range(60))])) for _ in range(600)]
    batch = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pos long, job_id long, job_url string").repartition(5)
    got = ingest.accept_details(batch, details(spark, (5, "3")), ["pos"]).orderBy("pos").collect()
    assert [r.outcome for r in got] == one_by_one(rows, [(5, "3")])


def test_equal_places_are_told_apart_by_content(spark):
    rows = [(0, f"t{i}", f"u{i % 7}") for i in range(40)]
    runs = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        new = ingest.ingest_new(spark.createDataFrame(rows, BATCH).repartition(1 + seed), stored(spark, "u3"))
        runs.append(sorted((r.id, r.title, r.job_url) for r in new.collect()))
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == list(range(2, 8))


def test_url_exists_and_existing(spark):
    have = stored(spark, "a", "a", None)
    asked = spark.createDataFrame([("a",), ("b",), (None,)], "job_url string")
    assert [r.job_url for r in ingest.url_exists(asked, have).collect()] == ["a"]
    assert ingest.existing_urls(have).count() == 2

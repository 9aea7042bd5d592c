"""What rounds carry from one to the next, and files that cannot be read."""

import gzip
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill.feed import Feed
from postmill.operators import ingest, mutate, queries
from postmill.operators.details import Site
from postmill.sources.staging import shared_folder
from postmill.sources.store import Store
from postmill.streaming import rounds

SITES = (Site("a.com", "sections"),)
PAGE = "page_id long, url string, status int, html string"


def listing(pos, title, url, source="A", **more):
    return {"source": source, "pos": pos, "title": title, "company": "C", "location": "L", "job_url": url, **more}


def land(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows)
    (folder / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())


@pytest.fixture
def world(spark, tmp_path):
    store, pages = Store(spark, str(tmp_path / "store")).init(), []
    settings = rounds.RoundSettings("chat", SITES, ("sql",), "https://a.com", source_folders={"A": "landed/a", "B": "landed/b"})

    def run(files_per_round=None):
        frame = spark.createDataFrame(pages, PAGE)
        rounds.start_rounds(store, rounds.landed_files(spark, str(tmp_path / "landed"), files_per_round), lambda: frame, settings,
                            str(tmp_path / "checkpoint")).awaitTermination()

    return store, tmp_path / "landed", pages, run


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_a_truncated_file_between_good_ones(spark, world, tmp_path):
    store, landed, _, run = world
    half = json.dumps(listing(7, "half", "https://a.com/7"))[:-30]
    land(landed, "a1.json", listing(0, "one", "https://a.com/1"), listing(1, "two", "https://a.com/2"), half, '{"pos": "xyz", "title": "Half"}')
    land(landed, "b1.json.gz", *[listing(i, f"b{i}", f"https://a.com/b{i}", "B") for i in range(2000)])
    whole = (landed / "b1.json.gz").read_bytes()
    (landed / "b1.json.gz").write_bytes(whole[:len(whole) // 2])
    land(landed, "c1.json", listing(0, "three", "https://a.com/3"), listing(1, "again", "https://a.com/1"))
    run()
    assert rows(store.read("postings"), "title") == [("one",), ("three",), ("two",)]
    reasons = {(r.line, r.reason if r.line else "file") for r in store.read("rejected").collect()}
    assert reasons == {(half, "malformed"), ('{"pos": "xyz", "title": "Half"}', "malformed"), (None, "file")}
    report = store.read("metrics").first()
    assert (report.inserted, report.skipped, report.rejected_lines, report.failed_files, report.failed_sources) == (3, 1, 2, 1, 1)
    assert [(r.outcome, Path(r.file).name) for r in store.read("files").collect()] == [("failed", "b1.json.gz")]

    # Still broken in the next round, whole in the one after it.
    land(landed, "a2.json", listing(0, "four", "https://a.com/4"))
    run()
    assert rows(store.read("metrics"), "inserted", "failed_files") == [(1, 1), (3, 1)]
    (landed / "b1.json.gz").write_bytes(whole)
    for crc in landed.glob(".*.crc"):
        crc.unlink()
    land(landed, "a3.json", listing(0, "five", "https://a.com/5"))
    run()
    assert store.read("postings").count() == 5 + 2000
    assert rows(store.read("files"), "outcome", "batch_id") == [("failed", 0), ("failed", 1), ("read", 2)]
    land(landed, "a4.json", listing(0, "six", "https://a.com/6"))
    run()
    assert store.read("postings").count() == 6 + 2000
    assert sorted(r.id for r in store.read("postings").collect()) == list(range(1, 2007))


def test_state_equals_the_joins_over_all_tables(spark, world, monkeypatch):
    """Ten rounds with deliveries, late pages, marks by hand and one deletion between them."""
    store, landed, pages, run = world
    rng = random.Random(1)
    full = []
    read = Store.read

    def noted(self, name, before_batch=None):
        full.append(name)
        return read(self, name, before_batch)

    for k in range(10):
        land(landed, f"{k}.json", *[listing(i, rng.choice(["sql", "cook"]), rng.choice([None, f"https://a.com/{rng.randrange(40)}"])) for i in range(6)])
        pages += [(100 * k + i, f"https://a.com/{rng.randrange(40)}", rng.choice([200, 404]), f"<h3>Təsvir</h3><p>{rng.choice(['sql', 'pan'])}</p>") for i in range(3)]
        if k == 6:
            Feed(store).delete_empty_details()
        full.clear()
        with monkeypatch.context() as m:
            m.setattr(Store, "read", noted)
            run()
        if k not in (0, 4, 6):  # the first round, the one after a reset and the one after a deletion read the tables
            assert set(full) <= {"files"}
        log, postings, details = read(store, "delivery"), read(store, "postings"), read(store, "details")
        kept = rounds.state_before(store, k + 1)
        assert rows(kept.pending, "id") == rows(queries.pending_details(postings, details), "id")
        want = rounds._unsent_from_tables(store, k + 1)
        columns = ("id", "title", "job_url", "description", "requirements", "rendered_batch")
        assert rows(rounds._after_deliveries(kept.unsent, kept.log), *columns) == rows(want, *columns)
        on_way = [r.id for r in mutate.on_their_way(log).collect()]
        results = [(i, rng.random() < 0.5) for i in on_way if rng.random() < 0.7]
        if results:
            frame = spark.createDataFrame([(i, ok, None if ok else "x") for i, ok in results], "job_id long, ok boolean, error string")
            for b in {e["batch"] for e in store.entries("outbox")}:
                rounds.deliver(store, frame, b)
        if k == 2:
            assert Feed(store).mark_sent(postings.select("id").orderBy("id").limit(3)) == 3
        if k == 3:
            Feed(store).reset_sent_without_details()


def test_a_round_leaves_nothing_staged(spark, world):
    store, landed, pages, run = world
    pages.append((1, "https://a.com/1", 200, "<h3>Təsvir</h3><p>sql</p>"))
    staged = Path(shared_folder(spark)) / "staged"
    before = set(staged.glob("*")) if staged.exists() else set()
    land(landed, "1.json", listing(0, "sql", "https://a.com/1"), listing(1, "two", None))
    run()
    Feed(store).insert_details(spark.createDataFrame([(2, "x", "d")], "job_id long, job_url string, description string"))
    assert set(staged.glob("*")) <= before and store.read("details").count() == 2


def test_only_the_buckets_of_the_batch_are_read(spark, plan, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BUCKET_ROWS", 10)
    assert [ingest.buckets_for(n) for n in (0, 9, 19, 20, 85, 10**9)] == [1, 1, 1, 2, 8, 4096]
    store = Store(spark, str(tmp_path / "s")).init()
    urls = spark.range(640).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("job_url"))
    large = store.write("posting_keys", ingest.keys_of(urls.filter("job_url < 'u5'"), 32), 0)
    small = store.write("posting_keys", ingest.keys_of(urls.filter("job_url >= 'u5'"), 4), 1)
    batch = spark.createDataFrame([("u17",), ("u555",), ("new",), (None,)], "job_url string")
    keys = ingest.stored_keys([(store.folders("posting_keys", [large]), 32), (store.folders("posting_keys", [small]), 4)], batch)
    text = plan(keys)
    assert "bucket#" in text and "PartitionFilters: [bucket#" in text.replace("isnotnull", "").replace("(", "").replace("  ", " ") or " IN (" in text
    assert rows(keys.join(batch.dropna(), "job_url", "left_semi"), "job_url") == [("u17",), ("u555",)]
    assert keys.count() < 500


def test_keys_are_merged_when_folders_become_many(spark, world, monkeypatch):
    monkeypatch.setattr(rounds, "MERGE", 2)
    store, landed, _, run = world
    for k in range(5):
        land(landed, f"{k}.json", *[listing(i, "t", f"https://c.com/{5 * k + i - k}") for i in range(5)])
        run()
    assert store.read("postings").count() == 21
    kept = store.state(5)
    assert len(kept["posting_keys"]) <= 3 and sum(e["rows"] for e in kept["posting_keys"]) == 21


def test_bodies_of_unwanted_pages_are_not_moved(spark, plan):
    from postmill.operators import details as det

    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), (F.col("id") % 100).cast("string")).alias("url"),
                                     F.lit(200).alias("status"), F.lit(10).alias("length"), F.lit("x" * 10).alias("html"))
    wanted = spark.createDataFrame([(1, "u7"), (2, "u8"), (3, "none")], "job_id long, job_url string")
    got = det.latest_pages(pages, wanted)
    assert rows(got, "job_id", "page_id") == [(1, 907), (2, 908)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")}
    try:
        for k, v in zip(old, ("-1", "0"), strict=True):
            spark.conf.set(k, v)
        folder = f"{shared_folder(spark)}/pages-for-plan"
        pages.write.mode("overwrite").parquet(folder)
        text = plan(det.latest_pages(spark.read.parquet(folder), wanted).select("job_id", "html"))
        assert "SortMergeJoin" in text and "might_contain" in text and "GreaterThanOrEqual(page_id,907)" in text
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

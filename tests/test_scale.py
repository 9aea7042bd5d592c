"""What keeps memory, traffic and the number of rounds from growing faster than the input."""

import json
import random
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from postmill.operators import details as det
from postmill.operators import ingest, notify
from postmill.plans import catalog, views
from postmill.sources.staging import stage
from postmill.sources.store import Change, Store
from postmill.streaming import rounds


def test_a_worker_holds_few_pages_as_objects(spark):
    bodies = [None, "x" * 400_000, "", "y" * 700_000, "z" * 3_000_000] + ["p" * 10_000] * 2000
    batch = pa.RecordBatch.from_pydict({"body": bodies})
    parts = [part.column("body").to_pylist() for part in det._slices(batch)]
    assert [b for part in parts for b in part] == bodies
    assert all(sum(len(b or "") for b in part) <= det.SLICE_BYTES or len(part) == 1 for part in parts)
    assert max(map(len, parts)) <= det.SLICE_PAGES


def test_pages_of_all_slices_are_read(spark):
    n = 3 * det.SLICE_PAGES + 7
    html = F.concat(F.lit('<aside><h3>Vakansiya haqqında</h3><div class="flex justify-between"><i>Təhsil</i><b>'), F.col("id").cast("string"), F.lit("</b></div></aside>"))
    pages = spark.range(0, n, 1, 1).select(F.col("id").alias("page_id"), F.when(F.col("id") % 5 > 0, html).alias("html"))
    found = {r.page_id: r.education for r in det.section_details(pages).select("page_id", "education").collect()}
    assert found == {i: str(i) if i % 5 else None for i in range(n)}


def test_landing_writes_a_file_for_a_feed(spark, tmp_path):
    """Not one for each feed and task, which would make the number of rounds follow the number of tasks."""
    spark.range(0, 4000, 1, 16).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
        F.concat(F.lit("src"), (F.col("id") % 20).cast("string")).alias("source"), F.lit(2).cast("long").alias("n_chars"),
    ).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        folder, _, _ = catalog._land(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32m")
    assert len(list(Path(folder.removeprefix("file:")).glob("landed/*/*.json"))) == 20


def test_stored_urls_are_not_broadcast(spark, plan):
    batch = spark.createDataFrame([(0, "t", "u"), (1, "t", "v")], "pos long, title string, job_url string")
    accepted = ingest.accept_new(batch, spark.createDataFrame([("u",)], "job_url string"))
    assert [r.job_url for r in accepted.collect()] == ["v"]
    assert "SortMergeJoin" in plan(accepted) and "Broadcast" not in plan(accepted)


def test_delivery_is_not_broadcast(spark, tmp_path, plan, monkeypatch):
    """Neither the outbox that results are held against nor the log that they are added to."""
    store = Store(spark, str(tmp_path / "store")).init()
    sent = spark.createDataFrame([(i, "chat", "text") for i in range(40)], "job_id long, chat_id string, message string")
    store.append("outbox", sent.withColumn("rendered_at", F.current_timestamp()), 0)
    plans, add = [], Change.add
    monkeypatch.setattr(Change, "add", lambda change, name, rows, *rest: plans.append(plan(rows)) or add(change, name, rows, *rest))
    results = spark.createDataFrame([(i, i % 3 > 0, None if i % 3 else "lost") for i in range(50)], "job_id long, ok boolean, error string")
    for part in (0, 1, 0):
        rounds.deliver(store, results.filter(F.col("job_id") % 2 == part), 0)
    assert all("Broadcast" not in p for p in plans) and sum("SortMergeJoin" in p for p in plans) == 3
    found = {(r.job_id, r.outcome, r.error) for r in store.read("delivery").collect()}
    assert found == {(i, "sent", None) if i % 3 else (i, "failed", "lost") for i in range(40)} and store.read("delivery").count() == 40
    assert "Broadcast" not in plan(notify.apply_outcomes(store.read("outbox"), results, F.current_timestamp()))


def test_orders_are_dealt_out_before_they_become_pages(spark, sf_dir, plan):
    """However few row groups they have."""
    assert "REPARTITION_BY_COL" in plan(views.payload_pages(spark, sf_dir))


def test_round_moves_texts_by_themselves(spark, tmp_path, monkeypatch):
    """Details are deduped and numbered as narrow rows; their texts are joined to that."""
    rng = random.Random(3)
    store = Store(spark, str(tmp_path / "store")).init()
    body = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ABCDEFGH0123456789") for _ in range(3000))
    n = 300
    spark.createDataFrame([(i, f"https://a.com/{i}", 200, f"<h3>Təsvir</h3><p>{body()}</p>") for i in range(n)],
                          "page_id long, url string, status int, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.json").write_text("\n".join(json.dumps(
        {"source": "A", "pos": i, "title": f"t{i}" if i % 3 else "sql", "job_url": f"https://a.com/{i}"}) for i in range(n)))
    seen = []

    def watched(frame, name, *rest):
        seen.append((name, frame.columns))
        return stage(frame, name, *rest)

    monkeypatch.setattr(ingest, "stage", watched)
    rounds.start_rounds(store, rounds.landed_files(spark, str(tmp_path / "landed")), lambda: spark.read.parquet(str(tmp_path / "pages")),
                        rounds.RoundSettings("chat", (det.Site("a.com", "sections"),), ("sql",)), str(tmp_path / "checkpoint")).awaitTermination()
    assert [name for name, _ in seen] == ["ids", "ids"] and not any("description" in columns for _, columns in seen)
    rows = store.read("details").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, n + 1)) == [r.job_id for r in rows] and all(len(r.description) > 2900 for r in rows)
    assert {r.job_url for r in rows} == {f"https://a.com/{i}" for i in range(n)}
    unsent = store.folders("unsent", [store.state(1)["unsent"]])
    assert unsent.count() == 100 and unsent.filter("description IS NULL").count() == 0

"""Incremental rounds: new listings in, messages out.

Each micro-batch ingests landed listings, extracts details of pending postings, and renders what is unsent and matches. A
round reads its own batch and what the round before left: the pending and the unsent postings, the stored keys by
bucket, and the log entries that came since. It never reads the tables of postings, details or deliveries as a whole,
unless they were changed outside rounds. All it writes becomes visible in one commit, and a replayed batch takes the
place of what it wrote before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postmill.functions.keywords import parse_keyword_list
from postmill.functions.text import absolute_url
from postmill.operators import details as det
from postmill.operators import ingest, mutate, notify, queries
from postmill.schemas import DETAIL_FIELDS, LISTING, PENDING, UNSENT
from postmill.sources.staging import scratch, stage
from postmill.sources.store import Change, Entry, Store

ARRIVAL = ["_file_time", "_file", "pos"]
#: Column of lines that are no listing.
BAD = "_bad"
#: Key folders that a round finds before it writes them anew as one.
MERGE = 16


@dataclass(frozen=True)
class RoundSettings:
    chat_id: str
    sites: Sequence[det.Site] = ()
    keywords: Sequence[str] = field(default_factory=parse_keyword_list)
    site_root: str = ""
    # Root of each source whose listings may hold relative URLs.
    source_roots: Mapping[str, str] = field(default_factory=dict)
    # Seconds after which a message without a result counts as lost and is rendered again; None: never.
    resend_after: int | None = None
    # Part of the path that files of each source have, so that a failed file can be told to be that source's.
    source_folders: Mapping[str, str] = field(default_factory=dict)


# -- landing -------------------------------------------------------------------

def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


_LANDED = f"{_ddl(LISTING)}, {BAD} string"


def _with_file(listings: DataFrame) -> DataFrame:
    return listings.select(
        "*", F.col("_metadata.file_modification_time").alias("_file_time"), F.col("_metadata.file_path").alias("_file"))


def landed_listings(spark: SparkSession, path: str, files_per_round: int | None = None) -> DataFrame:
    """Stream of landed listing files, one JSON object per line.

    Lines that are no JSON come as rows with the line in ``_bad`` and go to the table of rejected ones. A file that cannot
    be read fails the round and comes again at the next start; ``landed_files`` sets such files aside instead.
    """
    reader = spark.readStream.schema(_LANDED).option("columnNameOfCorruptRecord", BAD).option("recursiveFileLookup", "true")
    if files_per_round:
        reader = reader.option("maxFilesPerTrigger", files_per_round)
    return _with_file(reader.json(path))


def landed_files(spark: SparkSession, path: str, files_per_round: int | None = None) -> DataFrame:
    """Stream of the names of landed files. The round reads them, so that one that cannot be read does not stop the others."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if files_per_round:
        reader = reader.option("maxFilesPerTrigger", files_per_round)
    return reader.load(path).select("path")


def read_files(spark: SparkSession, files: Sequence[str], name: str = "landed") -> tuple[list[DataFrame], dict[str, str]]:
    """Listings of the files, and those that could not be read with the reason.

    All are read together. If that fails they are halved until those that cannot be read stand alone, so good files cost
    one job and a bad one a few more. What was read is staged, so nothing is read twice.
    """
    if not files:
        return [], {}
    reader = spark.read.schema(_LANDED).option("columnNameOfCorruptRecord", BAD)
    try:
        return [stage(_with_file(reader.json([re.sub(r"([\[\]{}*?])", r"\\\1", f) for f in files])), name)], {}
    except (PySparkException, Py4JJavaError) as e:
        if len(files) == 1:
            lines = [x for x in str(e).splitlines() if x.strip()]
            cause = [x for x in lines if x.startswith("Caused by")] or lines or [type(e).__name__]
            return [], {files[0]: cause[-1].strip()[:500]}
    half = len(files) // 2
    good, bad = read_files(spark, files[:half], name)
    more, worse = read_files(spark, files[half:], name)
    return good + more, bad | worse


def _failed_before(store: Store, batch_id: int) -> list[str]:
    """Files set aside by earlier rounds and not read since."""
    log = store.read("files", batch_id).groupBy("file").agg(F.max_by("outcome", F.struct("batch_id", "at")).alias("outcome"))
    return [r.file for r in log.filter(F.col("outcome") == "failed").collect()]  # failed files only


# -- what rounds carry on ------------------------------------------------------

@dataclass(frozen=True)
class State:
    """Pending and unsent postings before a batch, the stored keys, and the log entries that are not taken into account yet."""

    pending: DataFrame
    unsent: DataFrame
    #: Stored URLs, folder by folder, with the number of buckets of each.
    keys: dict[str, list[tuple[DataFrame, int]]]
    #: Those folders; none where they have to be written.
    key_entries: dict[str, list[Entry]]
    log: DataFrame
    consumed: list[str]


def _unsent_from_tables(store: Store, batch_id: int) -> DataFrame:
    log = store.read("delivery", batch_id)
    flagged = mutate.with_sent_flag(store.read("postings", batch_id), log)
    rows = queries.unsent_with_details(flagged, store.read("details", batch_id), ordered=False)
    return rows.join(mutate.on_their_way(log), "id", "left").select(*UNSENT.names)


def state_before(store: Store, batch_id: int) -> State:
    """As the round before left it; made from the tables where they were changed since, or a posting was reset."""
    kept = store.state(batch_id)
    log = store.entries("delivery", batch_id)
    if kept is not None:
        new = store.folders("delivery", [e for e in log if e["part"] not in set(kept["consumed"])])
        if new.filter(F.col("outcome") == mutate.RESET).isEmpty():
            one = lambda name: store.folders(name, [kept[name]]).drop("batch_id")
            keys = {n: [(store.folders(n, [e]), e["buckets"]) for e in kept[n]] for n in ("posting_keys", "detail_keys")}
            return State(one("pending"), one("unsent"), keys, {n: kept[n] for n in keys}, new, [e["part"] for e in log])
    postings, details = store.read("postings", batch_id), store.read("details", batch_id)
    pending = queries.pending_details(postings, details, ordered=False).select("id", "job_url")
    keys = {"posting_keys": [(postings.filter(F.col("job_url").isNotNull()), 1)], "detail_keys": [(details.filter(F.col("job_url").isNotNull()), 1)]}
    return State(pending, _unsent_from_tables(store, batch_id), keys, {}, store.folders("delivery", []), [e["part"] for e in log])


def _keep_keys(change: Change, name: str, state: State, new: DataFrame, rows: int, batch_id: int) -> list[Entry]:
    """Folders of all keys after the round: the new ones beside the others, or all written as one when they have become many."""
    store, held = change.store, state.key_entries.get(name)

    def written(keys: DataFrame, n: int, batch: int) -> list[Entry]:
        buckets = ingest.buckets_for(n)
        return [{**store.write(name, ingest.keys_of(keys, buckets), batch), "buckets": buckets}] if n else []

    if held is None or len(held) >= MERGE:
        table = "postings" if name == "posting_keys" else "details"
        before = sum(e["rows"] for e in (store.entries(table, batch_id) if held is None else held))
        every = None
        for keys, _ in state.keys[name]:
            every = keys.select("job_url") if every is None else every.unionAll(keys.select("job_url"))
        held = written(every, before, batch_id - 1)
    return held + written(new, rows, batch_id)


def _after_deliveries(unsent: DataFrame, log: DataFrame) -> DataFrame:
    """Unsent rows after further log entries (resets apart): what was sent or skipped goes, what failed may be rendered again."""
    failed = F.col("outcome") == mutate.FAILED
    last = log.filter(F.col("outcome") != mutate.RENDERED).groupBy(F.col("job_id").alias("id")).agg(
        F.max(~failed).alias("_done"), F.max(F.when(failed, F.col("batch_id"))).alias("_failed"))
    known = unsent.join(last, "id", "left").filter(~F.coalesce("_done", F.lit(False)))
    again = F.coalesce(F.col("_failed") >= F.col("rendered_batch"), F.lit(False))
    return known.withColumns({c: F.when(~again, F.col(c)) for c in ("rendered_at", "rendered_batch")}).drop("_done", "_failed")


def _with_details(unsent: DataFrame, details: DataFrame) -> DataFrame:
    """Unsent rows with the details that came with this batch; a posting gets them once."""
    names = [n for n in UNSENT.names if n in DETAIL_FIELDS]
    new = details.select(F.col("job_id").alias("id"), *[F.col(n).alias(f"_{n}") for n in names])
    return unsent.join(new, "id", "left").withColumns({n: F.coalesce(n, f"_{n}") for n in names}).drop(*[f"_{n}" for n in names])


# -- rounds --------------------------------------------------------------------

def run_round(store: Store, landed: DataFrame, pages: DataFrame, settings: RoundSettings, batch_id: int) -> None:
    """One batch of landed files, or of listings."""
    with scratch(store.spark):
        _run_round(store.pin(), landed, pages, settings, batch_id)


def _listings(store: Store, landed: DataFrame, settings: RoundSettings, batch_id: int) -> tuple[DataFrame, dict, dict[str, str], list[str]]:
    """Staged listings with absolute URLs, the numbers of good and bad lines, files that failed, and files that no longer do."""
    spark, failed, cured = store.spark, {}, []
    if "path" in landed.columns:
        before = _failed_before(store, batch_id)
        files = sorted({r.path for r in landed.collect()} | set(before))  # names only; the stream lists them as well
        read, failed = read_files(spark, files)
        cured = [f for f in before if f not in failed]
        listings = read[0] if read else spark.createDataFrame([], _LANDED + ", _file_time timestamp, _file string")
        for more in read[1:]:
            listings = listings.unionAll(more)
    else:
        listings = landed
    if BAD not in listings.columns:
        listings = listings.withColumn(BAD, F.lit(None).cast("string"))
    # URLs are made absolute before they serve as keys.
    url = F.col("job_url")
    for source, root in settings.source_roots.items():
        url = F.when(F.col("source") == source, absolute_url(F.col("job_url"), root)).otherwise(url)
    seen = Observation()
    counted = listings.withColumn("job_url", url).observe(
        seen, F.count_if(F.col(BAD).isNull()).alias("good"), F.count_if(F.col(BAD).isNotNull()).alias("bad"))
    return stage(counted, "listings"), seen, failed, cured


def _run_round(store: Store, landed: DataFrame, pages: DataFrame, settings: RoundSettings, batch_id: int) -> None:
    spark, now = store.spark, F.current_timestamp()
    change = store.change(in_round=True)
    state = state_before(store, batch_id)
    listings, lines, failed, cured = _listings(store, landed, settings, batch_id)
    good = listings.filter(F.col(BAD).isNull())
    order = [c for c in ARRIVAL if c in listings.columns]

    # Ingest. Only what earlier batches stored counts as stored, or a replay would refuse its own rows.
    stored = ingest.stored_keys(state.keys["posting_keys"], good)
    new = ingest.ingest_new(good, stored, order, store.highest_id("postings", batch_id))
    posted = change.put("postings", new.withColumns({"created_at": now, "updated_at": now}), batch_id)
    fresh = store.folders("postings", [posted])

    # Details. Extraction is the costly step, so its result is written once. What becomes of it is found on narrow rows, and
    # the texts are moved once more, to their ids.
    pending = state.pending.unionAll(fresh.select("id", "job_url"))
    wanted = det.wanted_of(pending, settings.sites)
    texts = stage(det.read_details(wanted, pages, settings.sites).withColumns({
        "_content": det.content(), "_page": F.monotonically_increasing_id()}), "details", compact=True)
    read = Observation()
    extracted = stage(det.outcomes(wanted, texts, F.col("_content"), ["_page"]).observe(
        read, F.count(F.lit(1)).alias("all"), F.count_if(F.col("status") == "ok").alias("ok")), "detail-outcomes")
    detailed = {"rows": 0}
    if read.get["ok"]:
        ready = extracted.filter(F.col("status") == "ok").select("job_id", "job_url", "_page")
        # A pending posting has no details under its id; under its URL an orphan may be left.
        taken = ingest.stored_keys(state.keys["detail_keys"], ready).select(F.lit(None).cast("long").alias("job_id"), "job_url")
        accepted = ingest.ingest_details(ready, taken, paired=True)
        numbered = ingest.assign_ids(accepted, ["job_id"], store.highest_id("details", batch_id))
        whole = numbered.join(texts.select("_page", *DETAIL_FIELDS), "_page")
        detailed = change.put("details", whole.withColumn("scraped_at", now), batch_id)
    else:
        change.drop("details", batch_id)
    details = store.folders("details", [detailed])

    # Messages: what failed is tried again, what is on its way is not.
    blank = {f.name: F.lit(None).cast(f.dataType) for f in UNSENT.fields if f.name not in fresh.columns}
    waiting = _after_deliveries(state.unsent, state.log).select(*UNSENT.names).unionAll(fresh.withColumns(blank).select(*UNSENT.names))
    free = F.col("rendered_at").isNull()
    if settings.resend_after is not None:
        free = free | (F.col("rendered_at") < now - F.expr(f"INTERVAL {int(settings.resend_after)} SECONDS"))
    matched = notify.select_for_delivery(_with_details(waiting, details), list(settings.keywords)).withColumns({
        "outcome": F.when(free, F.col("outcome")).otherwise("wait"), "mark": F.col("mark") & free})
    chosen = Observation()
    outcome = F.col("outcome")
    counted = matched.observe(
        chosen, F.count_if(outcome == "send").alias("send"), F.count_if(outcome == "skip").alias("skip"),
        F.count_if((outcome == "skip") & ~F.col("mark")).alias("skip_no_details"))
    # What is done with is logged by its id; nobody needs its texts again.
    selected = stage(counted.withColumns({n: F.when(~F.col("mark"), F.col(n)) for n in UNSENT.names if n in DETAIL_FIELDS}), "selected", compact=True)
    sent = selected.filter(outcome == "send")
    counts = chosen.get
    consumed = list(state.consumed)
    for name, step, rows, n in (
            ("outbox", None, notify.render_messages(sent, settings.chat_id, now, settings.site_root), counts["send"]),
            ("delivery", mutate.RENDERED, mutate.log_rows(sent, mutate.RENDERED, now), counts["send"]),
            ("delivery", mutate.SKIPPED, notify.skipped_log(selected, now), counts["skip"] - counts["skip_no_details"])):
        if n:
            consumed.append(change.put(name, rows, batch_id, step)["part"])
        else:
            change.drop(name, batch_id, step)

    # What the next round needs, and the report.
    left = pending.join(details.select(F.col("job_id").alias("id")), "id", "left_anti") if detailed["rows"] else pending
    on_way = {"rendered_at": F.when(outcome == "send", now).otherwise(F.col("rendered_at")),
              "rendered_batch": F.when(outcome == "send", F.lit(batch_id).cast("long")).otherwise(F.col("rendered_batch"))}
    change.keep_state(batch_id, {
        "pending": store.write("pending", left.select(*PENDING.names), batch_id),
        "unsent": store.write("unsent", selected.filter(~F.col("mark")).withColumns(on_way).select(*UNSENT.names), batch_id),
        "posting_keys": _keep_keys(change, "posting_keys", state, fresh, posted["rows"], batch_id),
        "detail_keys": _keep_keys(change, "detail_keys", state, details, detailed["rows"], batch_id),
        "consumed": consumed})
    _report(change, listings, lines.get, failed, cured, batch_id)
    log = [(f, "failed", r) for f, r in failed.items()] + [(f, "read", None) for f in cured]
    if log:
        change.put("files", spark.createDataFrame(log, "file string, outcome string, reason string").withColumn("at", now), batch_id)
    else:
        change.drop("files", batch_id)
    lost = sum(any(part in f for f in failed) for part in settings.source_folders.values())
    change.put("metrics", spark.createDataFrame([(
        posted["rows"], lines.get["good"] - posted["rows"], detailed["rows"], read.get["all"] - detailed["rows"],
        counts["send"], counts["skip"], counts["skip_no_details"], lines.get["bad"], len(failed), lost)], store.schema("metrics").fieldNames()[:-1]), batch_id)
    change.commit()


def _report(change: Change, listings: DataFrame, lines: dict, failed: dict[str, str], cured: list[str], batch_id: int) -> None:
    """Rejected lines with their file, and files that could not be read."""
    if not lines["bad"] and not failed:
        change.drop("rejected", batch_id)
        return
    file = F.col("_file") if "_file" in listings.columns else F.lit(None).cast("string")
    rows = listings.filter(F.col(BAD).isNotNull()).select(file.alias("file"), F.col(BAD).alias("line"), F.lit("malformed").alias("reason"))
    if failed:
        rows = rows.unionAll(change.store.spark.createDataFrame([(f, None, r) for f, r in failed.items()], "file string, line string, reason string"))
    change.put("rejected", rows.withColumn("at", F.current_timestamp()), batch_id)


def start_rounds(store: Store, landed: DataFrame, pages: Callable[[], DataFrame], settings: RoundSettings,
                 checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run over what has landed (``landed_files`` or ``landed_listings``) and stop, or go on at the given interval, e.g.
    ``180 minutes``.

    An error stops the query; the next start replays that batch.
    """
    writer = landed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: run_round(store, batch, pages(), settings, batch_id))
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def deliver(store: Store, results: DataFrame, batch_id: int) -> None:
    """Record delivery results for the outbox of a batch, in as many parts as they come; doing so again changes nothing.

    What is recorded as failed is tried again in the next round.
    """
    outbox = store.folders("outbox", [e for e in store.entries("outbox") if e["batch"] == batch_id])
    store.add_to_log(notify.apply_outcomes(outbox, results, F.current_timestamp()), batch_id, "result")


def stream_dedupe(listings: DataFrame, within: str | None = None, time: str = "_file_time", stored: DataFrame | None = None) -> DataFrame:
    """Each URL once over the whole stream, kept in stream state instead of in the tables.

    State grows with the number of URLs; with ``within`` (e.g. ``30 days``) it is bounded and a
    URL may pass again after that time. NULL URLs never collide, so each gets a key of its own. URLs of ``stored``, a table,
    count as seen: each micro-batch is held against it, so state holds the new ones only and a restart loses nothing.
    """
    if stored is not None:
        listings = listings.join(stored.select("job_url").dropna().distinct(), "job_url", "left_anti").select(*listings.columns)
    own = F.when(F.col("job_url").isNull(), F.struct("_file", "pos"))
    keyed = listings.withColumn("_own", own)
    if within is None:
        return keyed.dropDuplicates(["job_url", "_own"]).drop("_own")
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["job_url", "_own"]).drop("_own")

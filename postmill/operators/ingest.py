"""First-wins dedupe, ingest under unique keys, and id assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.sources.staging import stage, unstage

#: Most parts that stored URLs of one folder are dealt to, and URLs that make a part worth while.
BUCKETS, BUCKET_ROWS = 4096, 50_000


def _tie(df: DataFrame) -> Column:
    """Tells rows of one place in the order apart by what they hold, so that the order is total."""
    return F.xxhash64(*sorted(df.columns))


def _first_of_each(df: DataFrame, key: str, order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """First row of each non-NULL key in arrival order.

    The rank filter is applied in each task before the shuffle, so a key that holds a third of
    the rows sends one row per task.
    """
    order = Window.partitionBy(*within, key).orderBy(*order_by, _tie(df))
    return (
        df.filter(F.col(key).isNotNull())
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def dedupe_first_wins(df: DataFrame, key: str, order_by: Sequence[str] = ("pos",),
                      within: Sequence[str] = (), unique_order: bool = False) -> DataFrame:
    """First row of each key in arrival order; rows whose key is NULL are all kept.

    NULL keys take a branch of their own without any shuffle. Where the order columns are known
    to tell every two rows apart, ``unique_order`` does it in one pass over the input: each NULL
    row is then a group by itself.
    """
    if not unique_order:
        return _first_of_each(df, key, order_by, within).union(df.filter(F.col(key).isNull()))
    alone = F.when(F.col(key).isNull(), F.struct(*order_by))
    order = Window.partitionBy(*within, key, alone).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def accept_by_key(batch: DataFrame, stored: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """First row of each key that is not stored yet; rows whose key is NULL never collide.

    The rank and the anti join use one partitioning by the key. Stored keys are merged, never broadcast: a round that
    sent what is stored to the driver would do so again and again.
    """
    first = _first_of_each(batch, key, order_by).join(stored.select(key).hint("merge"), key, "left_anti")
    return first.select(*batch.columns).union(batch.filter(F.col(key).isNull()))


def existing_urls(postings: DataFrame) -> DataFrame:
    return postings.select("job_url").distinct()


def url_exists(urls: DataFrame, postings: DataFrame) -> DataFrame:
    """Given URLs that are stored."""
    return urls.join(postings.select("job_url"), "job_url", "left_semi")


def accept_new(batch: DataFrame, stored: DataFrame, order_by: Sequence[str] = ("pos",)) -> DataFrame:
    """Rows that may be stored: title present, first of their URL, URL not stored yet.

    Rows without a title go first, as a rejected row must not claim its URL.
    """
    return accept_by_key(batch.filter(F.col("title").isNotNull()), stored, "job_url", order_by)


def max_id(df: DataFrame, column: str = "id") -> DataFrame:
    """One row: the highest id, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("max_id"))


def assign_ids(df: DataFrame, order_by: Sequence[str], start: DataFrame) -> DataFrame:
    """Consecutive ids after ``start.max_id`` in the given order (equal places by content), without a global window.

    Rows are range-partitioned by the order and written once; counts per partition give each
    partition its offset. The running sum is over partitions, not rows: at most one row per
    shuffle partition.
    """
    place = F.monotonically_increasing_id()  # partition number, then row number within it
    total = [*order_by, "_tie"]
    ranged = df.withColumn("_tie", _tie(df)).repartitionByRange(*total).sortWithinPartitions(*total)  # small ranges are merged at run time
    placed = stage(ranged.drop("_tie").withColumn("_place", place), "ids")
    part = F.shiftright("_place", 33)
    row = F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    counts = counts.unionAll(start.select(F.lit(-1).cast("long"), "max_id"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.sum("n").over(before).alias("offset"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("id", F.col("offset") + row + 1)
        .select("id", *df.columns)
    )


def ingest_new(batch: DataFrame, stored: DataFrame, order_by: Sequence[str] = ("pos",),
               start: DataFrame | None = None) -> DataFrame:
    """Accepted rows with ids continuing after the stored ones."""
    accepted = accept_new(batch.drop("id"), stored, order_by)
    return assign_ids(accepted, order_by, max_id(stored) if start is None else start)


def ingest_counts(batch: DataFrame, accepted: DataFrame) -> DataFrame:
    """Inserted and skipped; they add up to the batch."""
    ones = batch.select(F.lit(0).alias("kept")).unionAll(accepted.select(F.lit(1)))
    return ones.agg(
        F.count_if(F.col("kept") == 1).alias("inserted"),
        (F.count_if(F.col("kept") == 0) - F.count_if(F.col("kept") == 1)).alias("skipped"))


def bucket(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def buckets_for(rows: int) -> int:
    """A power of two, so that the buckets of a large folder are parts of those of a small one."""
    return min(BUCKETS, 1 << max(0, (rows // BUCKET_ROWS).bit_length() - 1))


def stored_keys(folders: Sequence[tuple[DataFrame, int]], batch: DataFrame) -> DataFrame:
    """Stored URLs out of the buckets that the batch's URLs fall into; the others are not read.

    Each folder of keys ``(job_url, bucket)`` comes with its number of buckets. At most ``BUCKETS`` numbers reach the driver. NULL
    URLs are nobody's keys.
    """
    most = max((n for _, n in folders), default=1)
    urls = batch.filter(F.col("job_url").isNotNull())
    wanted = {r[0] for r in urls.select(bucket(F.col("job_url"), most)).distinct().collect()} if most > 1 else {0}
    found = batch.select("job_url").limit(0)
    for keys, n in folders:
        some = {w % n for w in wanted}
        found = found.unionAll((keys if len(some) == n else keys.filter(F.col("bucket").isin(sorted(some)))).select("job_url"))
    return found


def keys_of(rows: DataFrame, buckets: int) -> DataFrame:
    """Keys to be stored, one file per bucket."""
    return rows.filter(F.col("job_url").isNotNull()).select("job_url", bucket(F.col("job_url"), buckets).alias("bucket")).repartition("bucket")


def _pair_keys() -> tuple[Column, Column]:
    """Both keys of a detail row; a NULL one gets a value no stored key has, made from the other, so that NULLs spread.

    Stored ids are positive and stored URLs hold no such character.
    """
    return (F.coalesce("job_id", -1 - F.shiftrightunsigned(F.xxhash64("job_url"), 1)),
            F.coalesce("job_url", F.concat(F.lit("\u0000"), F.col("job_id").cast("string"))))


ACCEPTED, STORED, TAKEN = "accepted", "stored", "taken"


def accept_details(batch: DataFrame, stored: DataFrame, order_by: Sequence[str] = ("job_id",)) -> DataFrame:
    """The batch with ``outcome``: what comes of inserting its rows one by one in the given order, where neither an id nor a
    URL may be there twice.

    ``stored``: the id or the URL was there before; ``taken``: an earlier row of the batch got one of them; else
    ``accepted``. NULL keys never collide. Equal places in the order are told apart by content, equal rows by chance.

    Accepted rows are the first matching of ids with URLs. It is found in rounds: a row that comes first for both its
    id and its URL, among the rows still open, is accepted, and the rows that share a key with it go. Rows whose keys are
    theirs alone are done in the first round; chains of rows that each wait for the one before take as many rounds as they are
    long. Each round is minima per key, so a key that holds a third of all rows is folded in the tasks, and is written to
    the shared folder.
    """
    id_key, url_key = _pair_keys()
    rows = stage(batch.withColumns({"_tie": _tie(batch), "_row": F.monotonically_increasing_id()}), "detail-batch")
    edges = rows.filter(F.col("job_id").isNotNull() | F.col("job_url").isNotNull()).select(
        "_row", F.struct(*order_by, "_tie", "_row").alias("_at"), id_key.alias("_id"), url_key.alias("_url"))
    ids = stored.select(F.col("job_id").alias("_id")).dropna().distinct()
    urls = stored.select(F.col("job_url").alias("_url")).dropna().distinct()
    free = edges.join(ids, "_id", "left_anti").join(urls, "_url", "left_anti")
    # Of equal pairs only the first can be accepted.
    first = Window.partitionBy("_id", "_url").orderBy("_at")
    open_ = stage(free.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank"), "details-open")
    won = None
    while not open_.isEmpty():
        by_id = open_.groupBy("_id").agg(F.min("_at").alias("_first_of_id"))
        by_url = open_.groupBy("_url").agg(F.min("_at").alias("_first_of_url"))
        best = stage(open_.join(by_id, "_id").join(by_url, "_url").filter(
            (F.col("_at") == F.col("_first_of_id")) & (F.col("_at") == F.col("_first_of_url"))).select("_row", "_id", "_url"), "details-accepted")
        won = best if won is None else won.unionAll(best)
        rest = stage(open_.join(best.select("_id"), "_id", "left_anti").join(best.select("_url"), "_url", "left_anti").select(*open_.columns), "details-open")
        unstage(open_)
        open_ = rest
    keyless = F.col("job_id").isNull() & F.col("job_url").isNull()
    good = rows.withColumn("_won", keyless) if won is None else rows.join(
        won.select("_row", F.lit(True).alias("_won")), "_row", "left").withColumn("_won", F.coalesce("_won", keyless))
    known = edges.select("_row", "_id", "_url")
    before = known.join(ids, "_id", "left_semi").select("_row").unionAll(known.join(urls, "_url", "left_semi").select("_row")).distinct()
    return good.join(before.withColumn("_before", F.lit(True)), "_row", "left").select(
        *batch.columns, F.when(F.col("_won"), ACCEPTED).when(F.col("_before"), STORED).otherwise(TAKEN).alias("outcome"))


def ingest_details(batch: DataFrame, stored: DataFrame, order_by: Sequence[str] = ("job_id",),
                   paired: bool = False) -> DataFrame:
    """Detail rows accepted one by one in the given order: id and URL are both new.

    ``paired`` says that ids and URLs of the batch pair one to one, as those made from pending postings do. Then one rank
    by both keys does the dedupe and two anti joins do the rest, and no job runs until the rows are asked for.
    """
    if not paired:
        return accept_details(batch, stored, order_by).filter(F.col("outcome") == ACCEPTED).drop("outcome")
    keyless = F.col("job_id").isNull() & F.col("job_url").isNull()
    pair = Window.partitionBy("job_id", "job_url").orderBy(*order_by, _tie(batch))
    first = batch.filter(~keyless).withColumn("_rank", F.row_number().over(pair)).filter(F.col("_rank") == 1)
    id_key, url_key = _pair_keys()
    ids = stored.select(F.col("job_id").alias("_stored_id"))
    urls = stored.select(F.col("job_url").alias("_stored_url"))
    new = first.join(ids, id_key == F.col("_stored_id"), "left_anti").join(
        urls, url_key == F.col("_stored_url"), "left_anti")
    return new.select(*batch.columns).union(batch.filter(keyless))

"""Changes of state as table-to-table transforms.

Deletes return the rows that stay, to be published as a new snapshot. Delivery state is an
append-only log; the flag of a posting follows from its latest entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.queries import details_in_matching_postings, empty_detail, ids_in, not_in_details

SENT, SKIPPED, FAILED, RESET, RENDERED = "sent", "skipped", "failed", "reset", "rendered"


# -- delivery log --------------------------------------------------------------

def delivery_state(log: DataFrame) -> DataFrame:
    """One row per job: is it marked as sent. Rendering and failures leave the state as it was."""
    order = F.struct("batch_id", "at")
    return (
        log.filter(~F.col("outcome").isin(FAILED, RENDERED))
        .groupBy("job_id")
        .agg(F.max_by(F.col("outcome") != RESET, order).alias("is_sent"))
    )


def with_sent_flag(postings: DataFrame, log: DataFrame) -> DataFrame:
    state = delivery_state(log).filter("is_sent").select(F.col("job_id").alias("id"), "is_sent")
    return postings.drop("is_sent").join(state, "id", "left").withColumn(
        "is_sent", F.coalesce("is_sent", F.lit(False)))


def on_their_way(log: DataFrame, since: Column | None = None) -> DataFrame:
    """Jobs whose last entry says that a message was rendered, when and in which batch: its result is not known yet.

    With ``since``, messages rendered before that time count as lost and are left out.
    """
    order = F.struct("batch_id", "at", F.col("outcome") != RENDERED)
    last = log.groupBy("job_id").agg(F.max_by(F.struct("outcome", "at", "batch_id"), order).alias("last")).filter(F.col("last.outcome") == RENDERED)
    return (last if since is None else last.filter(F.col("last.at") >= since)).select(
        F.col("job_id").alias("id"), F.col("last.at").alias("rendered_at"), F.col("last.batch_id").alias("rendered_batch"))


def log_rows(ids: DataFrame, outcome: str, at: Column) -> DataFrame:
    """Log rows of one outcome; ``step`` keeps rows of different origin in one batch apart, ``call`` repeated actions."""
    return ids.select(
        F.col("id").alias("job_id"), F.lit(outcome).alias("outcome"),
        F.lit(None).cast("string").alias("error"), at.alias("at"), F.lit(outcome).alias("call"), F.lit(outcome).alias("step"))


def mark_sent(postings: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Log rows for the given ids that exist; a repeated id counts once, sent ones count too."""
    return log_rows(ids_in(postings, ids), SENT, at)


def reset_sent_without_details(postings: DataFrame, details: DataFrame, at: Column) -> DataFrame:
    return log_rows(not_in_details(postings.filter("is_sent"), details), RESET, at)


# -- deletes -------------------------------------------------------------------

def _minus(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return df.join(doomed.select(key), key, "left_anti").select(*df.columns)


def clear_postings(postings: DataFrame, details: DataFrame,
                   keep_orphans: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables after all postings are deleted.

    Details of the deleted postings go too, as they would block their URLs for ever.
    """
    if keep_orphans:
        return postings.filter(F.lit(False)), details
    return postings.filter(F.lit(False)), _minus(details, postings.withColumnRenamed("id", "job_id"), "job_id")


def clear_details(details: DataFrame) -> DataFrame:
    return details.filter(F.lit(False))


def empty_details(details: DataFrame, postings: DataFrame | None = None,
                  url_pattern: str | None = None) -> DataFrame:
    """Detail rows without description and requirements; with a pattern only those whose posting
    matches it, so rows without a posting never do."""
    empty = details.filter(empty_detail())
    return empty if url_pattern is None else details_in_matching_postings(empty, postings, url_pattern)


def delete_empty_details(details: DataFrame, postings: DataFrame | None = None,
                         url_pattern: str | None = None) -> DataFrame:
    """The rows that stay."""
    if url_pattern is None:
        return details.filter(~empty_detail())
    # Only empty rows are compared; rows with text pass by without a shuffle.
    empty = details.filter(empty_detail())
    doomed = details_in_matching_postings(empty, postings, url_pattern).select(F.col("job_id").alias("_doomed")).distinct()
    left = empty.join(doomed, F.col("job_id") == F.col("_doomed"), "left_anti")
    return details.filter(~empty_detail()).unionAll(left)

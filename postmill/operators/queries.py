"""Queries over postings and details."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import as_date
from postmill.functions.text import like_contains

POSTING_COLUMNS = ["id", "title", "company", "location", "job_url", "posted_date", "is_sent",
                   "created_at", "updated_at"]
DETAIL_COLUMNS = ["description", "requirements", "job_type", "job_level", "education", "category",
                  "salary", "deadline", "views", "scraped_at"]
# Unsent postings come without these two.
UNSENT_DETAIL_COLUMNS = [c for c in DETAIL_COLUMNS if c not in ("education", "scraped_at")]


# -- order ---------------------------------------------------------------------

def newest_first(df: DataFrame) -> DataFrame:
    """Latest date first, rows without a date last, equal dates by id."""
    return df.orderBy(F.desc_nulls_last("posted_date"), "id")


def id_desc(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("id"))


def limit_one(df: DataFrame) -> DataFrame:
    """Existence probe: stops at the first row found."""
    return df.limit(1)


# -- predicates ----------------------------------------------------------------

def posted_on(postings: DataFrame, day: datetime.date | str) -> DataFrame:
    return id_desc(postings.filter(F.col("posted_date") == as_date(day)))


def posted_within(postings: DataFrame, days: int, as_of: datetime.date | str) -> DataFrame:
    """Posted at most ``days`` days before ``as_of``; later dates count, missing ones do not."""
    return newest_first(postings.filter(F.col("posted_date") >= F.date_sub(as_date(as_of), days)))


def search_text(postings: DataFrame, word: str) -> DataFrame:
    return newest_first(postings.filter(
        like_contains(F.col("title"), word) | like_contains(F.col("company"), word)))


def url_like(df: DataFrame, pattern: str | None) -> DataFrame:
    return df if pattern is None else df.filter(like_contains(F.col("job_url"), pattern))


def empty_detail() -> Column:
    return F.col("description").isNull() & F.col("requirements").isNull()


def has_details() -> Column:
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return some("description") | some("requirements")


def unsent(postings: DataFrame) -> DataFrame:
    return postings.filter(~F.col("is_sent"))


# -- joins ---------------------------------------------------------------------

def pending_details(postings: DataFrame, details: DataFrame, url_pattern: str | None = None,
                    ordered: bool = True) -> DataFrame:
    """Postings without a detail row. Only the id column of the details is read."""
    pending = url_like(postings, url_pattern).join(
        details.select("job_id"), F.col("id") == F.col("job_id"), "left_anti")
    return newest_first(pending) if ordered else pending


def _detail_columns(details: DataFrame, names: list[str]) -> DataFrame:
    have = set(details.columns)
    return details.select("job_id", *[
        F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])


def _posting_columns(postings: DataFrame) -> list[str]:
    return [c for c in POSTING_COLUMNS if c in postings.columns]


def postings_with_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    joined = postings.select(*_posting_columns(postings)).join(
        _detail_columns(details, DETAIL_COLUMNS), F.col("id") == F.col("job_id"))
    return newest_first(joined.drop("job_id"))


def unsent_with_details(postings: DataFrame, details: DataFrame, ordered: bool = True) -> DataFrame:
    """Unsent postings with their details where there are any."""
    joined = unsent(postings).select(*_posting_columns(postings)).join(
        _detail_columns(details, UNSENT_DETAIL_COLUMNS), F.col("id") == F.col("job_id"), "left")
    joined = joined.drop("job_id")
    return newest_first(joined) if ordered else joined


def details_in_matching_postings(details: DataFrame, postings: DataFrame, url_pattern: str) -> DataFrame:
    ids = url_like(postings, url_pattern).select(F.col("id").alias("job_id"))
    return details.join(ids, "job_id", "left_semi")


def not_in_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    """``id NOT IN (SELECT job_id ...)``: a single NULL ``job_id`` makes it select nothing.

    Whether there is one is an aggregate of one row inside the plan; the rest is a plain anti join of any size, where
    ``NOT IN`` would broadcast all ids.
    """
    some_null = details.agg(F.coalesce(F.max(F.col("job_id").isNull()), F.lit(False)).alias("some_null")).scalar()
    return postings.join(details.select("job_id"), F.col("id") == F.col("job_id"), "left_anti").filter(~some_null)


def ids_in(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings whose id is in the one-column frame ``ids``.

    Repeated ids are folded in each task before the shuffle, so a hot one does no harm.
    """
    return postings.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")


def detail_by_id(details: DataFrame, ids: DataFrame | int) -> DataFrame:
    if isinstance(ids, int):
        return details.filter(F.col("job_id") == ids)
    return details.join(ids.select(F.col(ids.columns[0]).alias("job_id")).distinct(), "job_id", "left_semi")


# -- counts --------------------------------------------------------------------

def posting_count(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count("*").alias("n"))


def detail_count(details: DataFrame) -> DataFrame:
    return details.agg(F.count("*").alias("n"))


def unsent_count(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count_if(~F.col("is_sent")).alias("n"))

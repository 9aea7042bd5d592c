"""Readers of landed data. Schemas are always given; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import absolute_url, default_unknown
from postmill.operators.queries import newest_first
from postmill.schemas import DETAIL, LISTING, LISTING_PAYLOAD, PAGE, POSTING


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """All postings, newest first."""
    return newest_first(spark.read.schema(POSTING).parquet(path))


def read_details(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETAIL).parquet(path)


def read_listings(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed listing batches; a file that cannot be read fails the read instead of losing rows."""
    return (
        spark.read.schema(LISTING)
        .option("pathGlobFilter", f"*.{fmt}").option("recursiveFileLookup", "true")
        .format(fmt).load(path)
    )


def listings_from_payload(payloads: DataFrame, payload: str, site_root: str, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """Listings out of a column of JSON arrays; absent keys get the reader's defaults.

    ``pos`` counts within a payload, so columns that tell payloads apart (file, number) are kept for the order of arrival.
    """
    cards = payloads.select(*keep, F.posexplode(F.from_json(payload, LISTING_PAYLOAD)).alias("pos", "card"))
    card = lambda n: F.col("card")[n]
    return cards.select(
        *keep, F.lit(source).alias("source"), F.col("pos").cast("long").alias("pos"),
        default_unknown(card("title")).alias("title"), default_unknown(card("company")).alias("company"),
        default_unknown(card("location")).alias("location"), F.lit(None).cast("date").alias("posted_date"),
        absolute_url(F.coalesce(card("url"), F.lit("")), site_root).alias("job_url"),
    )


def usable_page(columns: list[str]) -> Column:
    """Only bodies of successful fetches count."""
    body = F.col("html").isNotNull() & (F.col("html") != "")
    return body & (F.col("status") == 200) if "status" in columns else body


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(PAGE).parquet(path)
    return pages.filter(usable_page(pages.columns))

"""Crawl logs: how far each crawl had to scroll.

Facts about scrolls (last dates, growth, standstills) cover every scroll of the log; only cutting a log applies a bound,
and each site has its own (``SITE_RULES``). Cards are reduced to one narrow row per scroll before any window.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.dates import days_ago, looks_like_date, parse_posted_date
from postmill.functions.text import strip
from postmill.operators.ingest import dedupe_first_wins

CRAWL = ["site", "crawl_id"]
SCROLL = [*CRAWL, "scroll_no"]


@dataclass(frozen=True)
class SiteRule:
    """When a crawl of a site stops: at ``max_scrolls``; after ``streak`` scrolls that changed neither the height nor the
    count (of cards, or of ``distinct_urls``); and at dates ``target_days`` old, where ``by_age`` says so."""

    max_scrolls: int
    streak: int = 1
    distinct_urls: bool = False
    by_age: bool = True


#: Fixed values of the two sites.
SITE_RULES = {"A": SiteRule(100), "B": SiteRule(30, streak=3, distinct_urls=True, by_age=False)}


def _within(log: DataFrame, max_scrolls: int | None) -> DataFrame:
    return log if max_scrolls is None else log.filter(F.col("scroll_no") <= max_scrolls)


def _scrolls(log: DataFrame, max_scrolls: int | None, with_lines: bool = False) -> DataFrame:
    """One row per scroll: height, number of cards, and the lines of the last card if asked for."""
    counted = [F.max("height").alias("height"), F.count("*").alias("cards")]
    if with_lines:
        counted.append(F.max_by("card_lines", "pos").alias("lines"))
    return _within(log, max_scrolls).groupBy(*SCROLL).agg(*counted)


def _last_date(as_of: Column | datetime.date | str) -> Column:
    """First line of ``lines`` that is a date, as ``struct<date, text>``."""
    dated = F.transform("lines", lambda x: F.struct(
        F.when(looks_like_date(x), parse_posted_date(x, as_of)).alias("date"), strip(x).alias("text")))
    return F.try_element_at(F.filter(dated, lambda s: s["date"].isNotNull()), F.lit(1))


def last_visible_date(log: DataFrame, as_of: Column | datetime.date | str, max_scrolls: int | None = None) -> DataFrame:
    """Date and text of the first date line of the last card, per scroll."""
    last = _scrolls(log, max_scrolls, with_lines=True).withColumn("_last", _last_date(as_of))
    return last.select(*SCROLL, F.col("_last.date").alias("last_date"), F.col("_last.text").alias("last_text"))


def cutoff_by_age(log: DataFrame, target_days: int, as_of: Column | datetime.date | str,
                  max_scrolls: int | None = None) -> DataFrame:
    """First scroll whose last date is at least ``target_days`` old; NULL when there is none."""
    old = days_ago(F.col("last_date"), as_of) >= target_days
    return last_visible_date(log, as_of, max_scrolls).groupBy(*CRAWL).agg(
        F.min(F.when(old, F.col("scroll_no"))).alias("age_cutoff"))


def _with_growth(log: DataFrame, scrolls: DataFrame, max_scrolls: int | None) -> DataFrame:
    """Add new and running distinct URLs. A URL counts in the first scroll that shows it."""
    first_seen = (
        _within(log, max_scrolls).filter(F.col("url").isNotNull())
        .groupBy(*CRAWL, "url").agg(F.min("scroll_no").alias("scroll_no"))
        .groupBy(*SCROLL).agg(F.count("*").alias("new_urls"))
    )
    running = Window.partitionBy(*CRAWL).orderBy("scroll_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        scrolls.join(first_seen, SCROLL, "left")
        .withColumn("new_urls", F.coalesce("new_urls", F.lit(0)))
        .withColumn("total_urls", F.sum("new_urls").over(running))
    )


def distinct_growth(log: DataFrame, max_scrolls: int | None = None) -> DataFrame:
    """New and running distinct URLs per scroll, with height and number of cards."""
    return _with_growth(log, _scrolls(log, max_scrolls), max_scrolls)


def _with_stall_length(scrolls: DataFrame, count: str) -> DataFrame:
    """Add ``stalled``: how many scrolls in a row, up to this one, changed nothing.

    The scroll before the first counts as zero high and empty.
    """
    order = Window.partitionBy(*CRAWL).orderBy("scroll_no")
    before = lambda c: F.coalesce(F.lag(c, 1).over(order), F.lit(0))
    same = (F.col("height") == before("height")) & (F.col(count) == before(count))
    runs = scrolls.withColumn("_same", same).withColumn(
        "_run", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(order))
    in_run = Window.partitionBy(*CRAWL, "_run").orderBy("scroll_no")
    return runs.withColumn("stalled", F.sum(F.when(F.col("_same"), 1).otherwise(0)).over(in_run)).drop("_same", "_run")


def _counted(log: DataFrame, distinct_urls: bool, max_scrolls: int | None, with_lines: bool = False) -> tuple[DataFrame, str]:
    """Scrolls, and the column whose standstill ends a crawl: cards, or running distinct URLs."""
    scrolls = _scrolls(log, max_scrolls, with_lines)
    return (_with_growth(log, scrolls, max_scrolls), "total_urls") if distinct_urls else (scrolls, "cards")


def cutoff_stalled(log: DataFrame, streak: int = 1, distinct_urls: bool = False,
                   max_scrolls: int | None = None) -> DataFrame:
    """First scroll ending a run of ``streak`` scrolls that changed neither height nor count."""
    stalled = _with_stall_length(*_counted(log, distinct_urls, max_scrolls))
    return stalled.groupBy(*CRAWL).agg(
        F.min(F.when(F.col("stalled") >= streak, F.col("scroll_no"))).alias("stall_cutoff"))


def loaded_scrolls(log: DataFrame, as_of: Column | datetime.date | str, target_days: int | None = None,
                   streak: int = 1, distinct_urls: bool = False, max_scrolls: int = 100) -> DataFrame:
    """Scrolls each crawl needs: up to the first that is old enough (when asked for) or ends a
    standstill, and never beyond the limit. One partitioning by crawl serves all the windows."""
    by_age = target_days is not None
    scrolls = _with_stall_length(*_counted(log, distinct_urls, max_scrolls, with_lines=by_age))
    stop = F.col("stalled") >= streak
    if by_age:
        old = days_ago(_last_date(as_of)["date"], as_of) >= target_days
        stop = stop | F.coalesce(old, F.lit(False))
    first_stop = F.min(F.when(stop, F.col("scroll_no"))).over(Window.partitionBy(*CRAWL))
    return scrolls.withColumn("cutoff", F.least(first_stop, F.lit(max_scrolls))).filter(
        F.col("scroll_no") <= F.col("cutoff")).select(*SCROLL, "cutoff")


def apply_cutoff(log: DataFrame, as_of: Column | datetime.date | str, target_days: int | None = None,
                 streak: int = 1, distinct_urls: bool = False, max_scrolls: int = 100) -> DataFrame:
    """Cards loaded up to the cutoff of their crawl, each URL of a crawl once.

    The join goes by scroll, not by crawl, so one huge crawl is spread over its scrolls.
    """
    kept = loaded_scrolls(log, as_of, target_days, streak, distinct_urls, max_scrolls)
    cards = dedupe_first_wins(
        _within(log, max_scrolls), "url", ["scroll_no", "pos"], within=CRAWL, unique_order=True)
    return cards.join(kept.select(*SCROLL), SCROLL, "left_semi").select(*log.columns)


def apply_site_rules(log: DataFrame, as_of: Column | datetime.date | str, target_days: int,
                     rules: Mapping[str, SiteRule] = SITE_RULES) -> DataFrame:
    """Cut a log of several sites, each by its own rule; sites without a rule keep all their cards, each URL once.

    The rules are a small table joined to the log, so that bound, streak and kind of count are columns: however many sites
    there are, one pass over the scrolls and one over the cards does it.
    """
    kinds = {"max_scrolls": "int", "streak": "int", "distinct_urls": "boolean", "by_age": "boolean"}
    names = {f"_{n}": k for n, k in kinds.items()}
    table = log.sparkSession.createDataFrame(
        [(site, *[getattr(r, n) for n in kinds]) for site, r in rules.items()], "site string, " + ", ".join(f"{n} {k}" for n, k in names.items()))
    within = log.join(table, "site", "left").filter(F.col("_max_scrolls").isNull() | (F.col("scroll_no") <= F.col("_max_scrolls")))
    scrolls = within.groupBy(*SCROLL, *names).agg(
        F.max("height").alias("height"), F.count("*").alias("cards"), F.max_by("card_lines", "pos").alias("lines"))
    grown = _with_growth(within, scrolls, None).withColumn("_count", F.when(F.col("_distinct_urls"), F.col("total_urls")).otherwise(F.col("cards")))
    old = F.col("_by_age") & (days_ago(_last_date(as_of)["date"], as_of) >= target_days)
    stop = F.coalesce(F.col("stalled") >= F.col("_streak"), F.lit(False)) | F.coalesce(old, F.lit(False))
    first_stop = F.min(F.when(stop, F.col("scroll_no"))).over(Window.partitionBy(*CRAWL))
    kept = _with_stall_length(grown, "_count").withColumn("_cutoff", first_stop).filter(
        F.col("_cutoff").isNull() | (F.col("scroll_no") <= F.col("_cutoff"))).select(*[F.col(c).alias(f"_kept_{c}") for c in SCROLL])
    cards = dedupe_first_wins(within, "url", ["scroll_no", "pos"], within=CRAWL, unique_order=True)
    same = F.lit(True)
    for c in SCROLL:
        same = same & F.col(c).eqNullSafe(F.col(f"_kept_{c}"))
    return cards.join(kept, same, "left_semi").select(*log.columns)

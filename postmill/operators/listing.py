"""Listing extraction: pages to links, cards to listing fields, union of the sites."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions import dates, text
from postmill.functions import fixed_values as fv
from postmill.operators.ingest import dedupe_first_wins

_ANCHOR = r"(?is)(<a\b[^>]*>.*?</a\s*>)"
_HREF = r"(?is)^<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
_INNER = r"(?is)^<a\b[^>]*>(.*)</a\s*>$"
_MAIN = r"(?is)<main\b[^>]*>(.*?)</main\s*>"
_BLOCK = r"(?i)</?(?:address|article|aside|br|dd|div|dl|dt|footer|h[1-6]|header|hr|li|main|nav|ol|p|section|table|tr|ul)\b[^>]*>"
_H3 = r"(?is)<h3\b[^>]*>(.*?)</h3\s*>"


# -- links ---------------------------------------------------------------------

def _href(anchor: Column) -> Column:
    """Value of ``href`` in any quoting; NULL when there is none."""
    found = F.when(
        anchor.rlike(_HREF),
        F.concat(*[F.regexp_extract(anchor, _HREF, g) for g in (1, 2, 3)]),
    )
    return text.decode_entities(found)


def _anchors(html: Column) -> Column:
    """Links of a page in document order as ``array<struct<href, inner>>``."""
    found = F.regexp_extract_all(text.remove_hidden(html), F.lit(_ANCHOR), 1)
    return F.transform(found, lambda a: F.struct(
        _href(a).alias("href"), F.regexp_extract(a, _INNER, 1).alias("inner")))


def _explode_links(pages: DataFrame, links: Column, keys: Sequence[str], rendered: bool = False) -> DataFrame:
    inner = F.col("link.inner")
    shown = F.regexp_replace(inner, _BLOCK, "\n") if rendered else inner
    return pages.select(*keys, F.posexplode(links).alias("pos", "link")).select(
        *keys, F.col("pos").cast("long").alias("pos"),
        F.col("link.href").alias("href"), inner.alias("inner"),
        text.visible_text(shown).alias("text"),
    )


def extract_link_cards(pages: DataFrame, keys: Sequence[str] = ("page_id",), rendered: bool = False) -> DataFrame:
    """One row per link that has an address: position, href, inner HTML and text.

    The text is what the markup holds; with ``rendered`` block elements also start a new line,
    as on a screen.
    """
    links = F.filter(_anchors(F.col("html")), lambda x: x["href"].isNotNull())
    return _explode_links(pages, links, keys, rendered)


def is_posting_link(href: Column, host: str | None = None, paths: Sequence[str] = fv.POSTING_PATHS) -> Column:
    """The address holds one of the path parts, or the host of the site."""
    return text.contains_any(href, [*paths, *([host] if host else [])])


def is_posting_link_lenient(href: Column, host: str | None = None) -> Column:
    """Single-card rule: any case, and three query parts count as well."""
    return is_posting_link(F.lower(href), host, [*fv.POSTING_PATHS, *fv.POSTING_QUERIES])


def filter_job_links(cards: DataFrame, host: str | None = None,
                     paths: Sequence[str] = fv.POSTING_PATHS, lenient: bool = False) -> DataFrame:
    rule = is_posting_link_lenient(F.col("href"), host) if lenient else is_posting_link(F.col("href"), host, paths)
    return cards.filter(rule)


def link_strategy_fallback(pages: DataFrame, keys: Sequence[str] = ("page_id",),
                           paths: Sequence[str] = fv.POSTING_PATHS) -> DataFrame:
    """Links of the first tier that finds any, page by page.

    Tiers: path parts, ``id=`` links, links inside ``<main>``, all links. The choice is made
    inside the row, before the links are exploded, so no shuffle is needed. The first two tiers
    hold each address once per page.
    """
    both = pages.select(*keys, _anchors(F.col("html")).alias("all"),
                        _anchors(F.regexp_extract("html", _MAIN, 1)).alias("main"))
    by_path = F.filter("all", lambda x: text.contains_any(x["href"], paths))
    by_id = F.filter("all", lambda x: x["href"].contains(fv.ID_QUERY))
    tiers = both.select(*keys, F.array(by_path, by_id, F.col("main"), F.col("all")).alias("tiers"))
    tier = F.array_position(F.transform("tiers", lambda t: F.size(t) > 0), F.lit(True)).cast("int")
    chosen = tiers.withColumn("tier", tier)
    # A page without links has tier 0: nothing to explode.
    rows = _explode_links(chosen, F.try_element_at("tiers", F.nullif("tier", F.lit(0))), [*keys, "tier"])
    marked = rows.filter(F.col("href").isNotNull()).withColumn("_once", F.when(F.col("tier") <= 2, F.col("href")))
    return dedupe_first_wins(marked, "_once", ["pos"], within=list(keys), unique_order=True).drop("_once")


def first_n_cards(pages: DataFrame, n: int = 20, keys: Sequence[str] = ("page_id",),
                  paths: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` links of each page in order, cut before the links are exploded."""
    links = F.filter(_anchors(F.col("html")), lambda x: x["href"].isNotNull() if paths is None
                     else text.contains_any(x["href"], paths))
    return _explode_links(pages, F.slice(links, 1, n), keys)


# -- cards ---------------------------------------------------------------------

def card_lines(cards: DataFrame, min_lines: int = 2, min_chars: int = 0) -> DataFrame:
    """Add the stripped, non-empty lines; drop cards with too few lines or too little text."""
    kept = cards.withColumn("lines", text.lines(F.col("text")))
    kept = kept.filter(F.size("lines") >= min_lines)
    return kept.filter(F.length(text.strip(F.col("text"))) >= min_chars) if min_chars else kept


def card_title(inner: Column, lines: Column) -> Column:
    """Text of the ``<h3>`` when the card has one, else the first line."""
    heading = text.strip(text.visible_text(F.regexp_extract(inner, _H3, 1)))
    return F.when(inner.rlike(_H3), heading).otherwise(F.try_element_at(lines, F.lit(1)))


def card_fields_separator(cards: DataFrame, as_of: Column | datetime.date | str,
                          separator: str = fv.CARD_SEPARATOR) -> DataFrame:
    """Title, company, location and date of cards whose company line holds a separator sign.

    The last date line and the last separator line win; a line that reads as a date is never
    taken for a separator line.
    """
    dated = cards.withColumn("_dated", F.transform("lines", lambda x: F.struct(
        x.alias("line"), dates.parse_posted_date(x, as_of).alias("date"))))
    date = F.try_element_at(F.filter("_dated", lambda d: d["date"].isNotNull()), F.lit(-1))["date"]
    company = F.try_element_at(
        F.filter("_dated", lambda d: d["date"].isNull() & d["line"].contains(separator)), F.lit(-1))["line"]
    part = lambda k: F.coalesce(text.strip(F.try_element_at("_parts", F.lit(k))), F.lit(fv.UNKNOWN))
    return dated.withColumn("_parts", F.split(company, re.escape(separator))).select(
        *[c for c in cards.columns if c not in ("inner", "text", "lines")],
        card_title(F.col("inner"), F.col("lines")).alias("title"),
        part(1).alias("company"), part(2).alias("location"), date.alias("posted_date"),
    )


def card_fields_positional(cards: DataFrame, use_heading: bool = False) -> DataFrame:
    """Lines 1, 2 and 3 are title, company and location."""
    line = lambda k: F.try_element_at("lines", F.lit(k))
    title = card_title(F.col("inner"), F.col("lines")) if use_heading else line(1)
    return cards.withColumns({
        "title": text.default_unknown(title),
        "company": text.default_unknown(line(2)),
        "location": text.default_unknown(line(3)),
        "posted_date": F.lit(None).cast("date"),
    }).drop("inner", "text")


def location_keyword_override(cards: DataFrame, words: Sequence[str] = fv.PLACE_WORDS) -> DataFrame:
    """The last line holding a place word, in any case, replaces the location."""
    lowered = [w.lower() for w in words]
    hits = F.filter("lines", lambda x: text.contains_any(F.lower(x), lowered))
    return cards.withColumn("location", F.coalesce(F.try_element_at(hits, F.lit(-1)), F.col("location")))


def _skip_reason(site: str, host: str | None) -> Column:
    lines = F.size(text.lines(F.col("text")))
    if site == "separator":
        return (F.when(~F.coalesce(F.col("href").contains(fv.SEPARATOR_SITE_PATH), F.lit(False)), "no_url")
                .when(lines < 2, "few_lines").otherwise("kept"))
    usable = F.coalesce(is_posting_link_lenient(F.col("href"), host), F.lit(False))
    usable = usable & (F.length(text.strip(F.col("text"))) >= 3) & (lines >= 2)
    return F.when(~usable, "parse").otherwise("kept")


def card_skip_reasons(cards: DataFrame, site: str = "separator", host: str | None = None,
                      within: Sequence[str] = ("page_id",)) -> DataFrame:
    """Number of cards kept and skipped, by reason.

    ``separator`` cards are skipped for want of an address or of lines; ``positional`` cards
    also when an earlier kept card of the page has the same address.
    """
    marked = cards.select(*within, "href", _skip_reason(site, host).alias("reason"))
    per_href = marked.groupBy("reason", *within, "href").count()
    if site != "separator":
        # All copies of a kept address but the first are duplicates: a count per address tells.
        kept = F.col("reason") == "kept"
        per_href = per_href.select(F.explode(F.array(
            F.struct("reason", F.when(kept, F.lit(1)).otherwise(F.col("count")).alias("n")),
            F.struct(F.lit("duplicate").alias("reason"), F.when(kept, F.col("count") - 1).otherwise(0).alias("n")),
        )).alias("x")).select("x.reason", "x.n")
    else:
        per_href = per_href.select("reason", F.col("count").alias("n"))
    return per_href.groupBy("reason").agg(F.sum("n").alias("cards")).filter(F.col("cards") > 0)


# -- union of the sites --------------------------------------------------------

def union_sources(batches: Mapping[str, DataFrame]) -> DataFrame:
    """Bag union with a ``source`` column; columns a source lacks are NULL."""
    result = None
    for name, batch in batches.items():
        tagged = batch.withColumn("source", F.lit(name))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


def read_guarded(readers: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], list[str]]:
    """Open each source on its own; a source that cannot be opened does not lose the others."""
    opened, failed = {}, []
    for name, reader in readers.items():
        try:
            opened[name] = reader()
        except PySparkException:
            failed.append(name)
    return opened, failed


def source_summary(spark: SparkSession, listings: DataFrame, expected: Sequence[str], failed: Sequence[str] | None = None) -> DataFrame:
    """Rows per expected source, and whether it failed: it is among ``failed``, or, where that is not known, it has no rows."""
    names = spark.createDataFrame([(n,) for n in expected], "source string")
    counts = listings.groupBy("source").agg(F.count("*").alias("rows"))
    return names.join(counts, "source", "left").select(
        "source", F.coalesce("rows", F.lit(0)).alias("rows"),
        (F.col("rows").isNull() if failed is None else F.col("source").isin(list(failed))).alias("failed"))


def sample_head(listings: DataFrame, n: int = 3, order_by: Sequence[str] = ("pos",)) -> DataFrame:
    """First ``n`` rows of each source and how many more there are.

    The rank filter is pushed below the shuffle (each task sends at most ``n`` rows per source),
    and the counts are one row per source.
    """
    first = Window.partitionBy("source").orderBy(*order_by)
    head = listings.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
    more = listings.groupBy("source").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return head.join(more, "source")

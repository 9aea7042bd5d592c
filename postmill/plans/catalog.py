"""Every operator bound to the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schemas
from postmill.feed import Feed
from postmill.functions import dates, keywords, numbers, text
from postmill.functions import fixed_values as fv
from postmill.operators import crawl, ingest, listing, mutate, notify, queries
from postmill.operators import details as det
from postmill.plans import views as v
from postmill.plans.views import with_views
from postmill.sources import readers
from postmill.sources.readers import listings_from_payload, usable_page
from postmill.sources.staging import COMPACT, create_once, shared_folder
from postmill.sources.store import Store
from postmill.streaming import rounds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

def AT():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")

WORDS = keywords.parse_keyword_list(" License, und ,")
SITE_ROOT = "https://site.example.com"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


# -- queries over postings and details -----------------------------------------

_PENDING = "SELECT * FROM postings p WHERE NOT EXISTS (SELECT 1 FROM details d WHERE d.job_id = p.id)"


@query("pending_details", with_views(_PENDING, "postings", "details"))
def pending_details(spark, sf):
    return queries.pending_details(v.postings(spark, sf), v.details(spark, sf))


@query("pending_details_by_url", with_views(
    _PENDING + " AND translate(job_url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%en.example%'",
    "postings", "details"))
def pending_details_by_url(spark, sf):
    return queries.pending_details(v.postings(spark, sf), v.details(spark, sf), "EN.example")


@query("postings_with_details", with_views("""
    SELECT id, title, company, location, p.job_url, posted_date, is_sent, description, requirements,
           CAST(NULL AS VARCHAR) AS job_type, CAST(NULL AS VARCHAR) AS job_level, CAST(NULL AS VARCHAR) AS education,
           CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS salary, CAST(NULL AS VARCHAR) AS deadline,
           views, CAST(NULL AS VARCHAR) AS scraped_at
    FROM flagged_postings p JOIN details d ON d.job_id = p.id""", "flagged_postings", "details"))
def postings_with_details(spark, sf):
    return queries.postings_with_details(v.flagged_postings(spark, sf), v.details(spark, sf))


_UNSENT = """
    SELECT id, title, company, location, p.job_url, posted_date, is_sent, description, requirements,
           CAST(NULL AS VARCHAR) AS job_type, CAST(NULL AS VARCHAR) AS job_level,
           CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS salary, CAST(NULL AS VARCHAR) AS deadline, views
    FROM flagged_postings p LEFT JOIN details d ON d.job_id = p.id WHERE NOT is_sent"""


def _unsent(spark, sf, ordered=False):
    return queries.unsent_with_details(v.flagged_postings(spark, sf), v.details(spark, sf), ordered)


@query("unsent_with_details", with_views(_UNSENT, "flagged_postings", "details"))
def unsent_with_details(spark, sf):
    return _unsent(spark, sf, ordered=True)


@query("posted_on", with_views("SELECT * FROM postings WHERE posted_date = DATE '2024-01-05'", "postings"))
def posted_on(spark, sf):
    return queries.posted_on(v.postings(spark, sf), "2024-01-05")


@query("posted_within", with_views("SELECT * FROM postings WHERE posted_date >= DATE '2024-01-24'", "postings"))
def posted_within(spark, sf):
    return queries.posted_within(v.postings(spark, sf), 7, v.AS_OF)


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("search_text", with_views(
    f"SELECT * FROM postings WHERE {_FOLD.format('title')} LIKE '%the_%' OR {_FOLD.format('company')} LIKE '%the_%'",
    "postings"))
def search_text(spark, sf):
    return queries.search_text(v.postings(spark, sf), "The_")


@query("detail_by_id", with_views(
    "SELECT * FROM details WHERE job_id IN (SELECT user_id FROM events)", "details"))
def detail_by_id(spark, sf):
    return queries.detail_by_id(v.details(spark, sf), v.table(spark, sf, "events").select("user_id"))


@query("url_exists", with_views(
    "SELECT job_url FROM arriving WHERE job_url IN (SELECT job_url FROM stored WHERE job_url IS NOT NULL)",
    "stored", "arriving"))
def url_exists(spark, sf):
    batch = v.posting_batch(spark, sf)
    return ingest.url_exists(batch.filter(~v.stored_feeds(batch)).select("job_url"), batch.filter(v.stored_feeds(batch)))


@query("ids_in", with_views("SELECT * FROM postings WHERE id IN (SELECT user_id FROM events)", "postings"))
def ids_in(spark, sf):
    return queries.ids_in(v.postings(spark, sf), v.table(spark, sf, "events").select("user_id"))


@query("not_in_details", with_views(
    "SELECT * FROM postings WHERE id NOT IN (SELECT job_id FROM details)", "postings", "details"))
def not_in_details(spark, sf):
    return queries.not_in_details(v.postings(spark, sf), v.details(spark, sf))


@query("details_in_matching_postings", with_views(
    "SELECT * FROM details WHERE job_id IN (SELECT id FROM postings WHERE job_url LIKE '%fr.example%')",
    "postings", "details"))
def details_in_matching_postings(spark, sf):
    return queries.details_in_matching_postings(v.details(spark, sf), v.postings(spark, sf), "fr.example")


@query("posting_count", with_views("SELECT count(*) AS n FROM postings", "postings"))
def posting_count(spark, sf):
    return queries.posting_count(v.postings(spark, sf))


@query("detail_count", with_views("SELECT count(*) AS n FROM details", "details"))
def detail_count(spark, sf):
    return queries.detail_count(v.details(spark, sf))


@query("unsent_count", with_views("SELECT count(*) AS n FROM flagged_postings WHERE NOT is_sent", "flagged_postings"))
def unsent_count(spark, sf):
    return queries.unsent_count(v.flagged_postings(spark, sf))


@query("match_any_keyword", r"""
    SELECT conv_id, turn, role FROM conversations
    WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(the|pour|und)([^\p{L}\p{N}_]|$)')
      AND regexp_matches(lower(role), '(^|[^\p{L}\p{N}_])user([^\p{L}\p{N}_]|$)')""")
def match_any_keyword(spark, sf):
    none = F.lit(None).cast("string")
    turns = v.table(spark, sf, "conversations")
    hit = keywords.match_any_keyword(none, F.col("text"), none, keywords.parse_keyword_list("the, Pour,und"))
    by_user = keywords.match_any_keyword(F.col("role"), none, none, ["user"])
    return turns.filter(hit & by_user).select("conv_id", "turn", "role")


@query("keyword_list", r"""
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: lower(trim(x, ' ' || chr(10)))), lambda x: x <> ''), '|') AS words
    FROM documents""")
def keyword_list(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", F.array_join(keywords.keyword_list(F.col("text")), "|").alias("words"))


# -- ingest --------------------------------------------------------------------

def _split_feeds(spark, sf):
    batch = v.posting_batch(spark, sf)
    return batch.filter(~v.stored_feeds(batch)), batch.filter(v.stored_feeds(batch))


@query("dedupe_first_wins", with_views("SELECT * FROM postings", "postings"))
def dedupe_first_wins(spark, sf):
    return ingest.dedupe_first_wins(v.posting_batch(spark, sf), "job_url").drop("pos")


@query("existing_urls", with_views("SELECT DISTINCT job_url FROM posting_batch", "posting_batch"))
def existing_urls(spark, sf):
    return ingest.existing_urls(v.posting_batch(spark, sf))


@query("ingest_new", with_views("""
    SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY pos) AS id,
           pos, source, title, company, location, job_url, posted_date FROM accepted""", "accepted"))
def ingest_new(spark, sf):
    arriving, stored = _split_feeds(spark, sf)
    return ingest.ingest_new(arriving, stored)


@query("ingest_counts", with_views(
    "SELECT (SELECT count(*) FROM accepted) AS inserted, count(*) - (SELECT count(*) FROM accepted) AS skipped FROM arriving",
    "accepted"))
def ingest_counts(spark, sf):
    arriving, stored = _split_feeds(spark, sf)
    return ingest.ingest_counts(arriving, ingest.accept_new(arriving, stored))


@query("ingest_details", with_views("""
    SELECT d.* FROM details d JOIN postings p ON p.id = d.job_id
    WHERE NOT EXISTS (SELECT 1 FROM details s JOIN arriving a ON a.id = s.job_id
                      WHERE s.job_id = d.job_id OR s.job_url = d.job_url)""", "details", "arriving"))
def ingest_details(spark, sf):
    arriving, _ = _split_feeds(spark, sf)
    all_details = v.details(spark, sf)
    stored = queries.detail_by_id(all_details, arriving.select("id"))
    return ingest.ingest_details(all_details, stored)


@query("union_sources", """
    SELECT doc_id, text, lang, 'documents' AS source, CAST(NULL AS BIGINT) AS conv_id FROM documents
    UNION ALL SELECT NULL, text, NULL, 'conversations', conv_id FROM conversations""")
def union_sources(spark, sf):
    return listing.union_sources({
        "documents": v.table(spark, sf, "documents").select("doc_id", "text", "lang"),
        "conversations": v.table(spark, sf, "conversations").select("conv_id", "text"),
    }).select("doc_id", "text", "lang", "source", "conv_id")


@query("source_summary", """
    SELECT s.source, coalesce(n, 0) AS rows, n IS NULL AS failed
    FROM (VALUES ('src0'), ('src1'), ('lost')) s(source)
    LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) c ON c.source = s.source""")
def source_summary(spark, sf):
    return listing.source_summary(spark, v.table(spark, sf, "documents"), ["src0", "src1", "lost"])


@query("sample_head", with_views("""
    SELECT b.id, b.source, b.title, rank, more FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rank FROM posting_batch) b
    JOIN (SELECT source, greatest(count(*) - 3, 0) AS more FROM posting_batch GROUP BY source) c ON c.source = b.source
    WHERE rank <= 3""", "posting_batch"))
def sample_head(spark, sf):
    return listing.sample_head(v.posting_batch(spark, sf)).select("id", "source", "title", "rank", "more")


# -- changes of state ----------------------------------------------------------

@query("delivery_state", with_views("SELECT id, is_sent FROM flagged_postings", "flagged_postings"))
def delivery_state(spark, sf):
    return v.flagged_postings(spark, sf).select("id", "is_sent")


@query("clear_postings", with_views("""
    SELECT (SELECT count(*) FROM postings) AS deleted, 0::BIGINT AS postings_left, 0::BIGINT AS details_left,
           (SELECT count(*) FROM details) AS orphans_if_kept""", "postings", "details"))
def clear_postings(spark, sf):
    old, old_details = v.postings(spark, sf), v.details(spark, sf)
    left, details_left = mutate.clear_postings(old, old_details)
    _, orphans = mutate.clear_postings(old, old_details, keep_orphans=True)
    tagged = None
    for name, df in (("deleted", old), ("postings_left", left), ("details_left", details_left), ("orphans_if_kept", orphans)):
        one = df.select(F.lit(name).alias("name"))
        tagged = one if tagged is None else tagged.unionAll(one)
    return tagged.agg(*[F.count_if(F.col("name") == n).alias(n)
                        for n in ("deleted", "postings_left", "details_left", "orphans_if_kept")])


@query("clear_details", with_views("SELECT count(*) AS deleted, 0::BIGINT AS details_left FROM details", "details"))
def clear_details(spark, sf):
    old = v.details(spark, sf)
    both = old.select(F.lit(True).alias("old")).unionAll(mutate.clear_details(old).select(F.lit(False)))
    return both.agg(F.count_if("old").alias("deleted"), F.count_if(~F.col("old")).alias("details_left"))


@query("delete_empty_details", with_views(
    "SELECT * FROM details WHERE NOT (description IS NULL AND requirements IS NULL)", "details"))
def delete_empty_details(spark, sf):
    return mutate.delete_empty_details(v.details(spark, sf))


@query("delete_empty_details_by_url", with_views("""
    SELECT * FROM details WHERE NOT (description IS NULL AND requirements IS NULL
      AND job_id IN (SELECT id FROM postings WHERE job_url LIKE '%en.example%'))""", "details", "postings"))
def delete_empty_details_by_url(spark, sf):
    return mutate.delete_empty_details(v.details(spark, sf), v.postings(spark, sf), "en.example")


@query("mark_sent", with_views(
    "SELECT DISTINCT id AS job_id, 'sent' AS outcome FROM postings WHERE id IN (SELECT user_id FROM events)", "postings"))
def mark_sent(spark, sf):
    ids = v.table(spark, sf, "events").select("user_id")
    return mutate.mark_sent(v.postings(spark, sf), ids, AT()).select("job_id", "outcome")


@query("reset_sent", with_views("""
    SELECT id AS job_id, 'reset' AS outcome FROM flagged_postings
    WHERE is_sent AND id NOT IN (SELECT job_id FROM details)""", "flagged_postings", "details"))
def reset_sent(spark, sf):
    return mutate.reset_sent_without_details(
        v.flagged_postings(spark, sf), v.details(spark, sf), AT()).select("job_id", "outcome")


# -- links and cards -----------------------------------------------------------

_LINKS = r"""
    links AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS anchor FROM (
        SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
               '(?s)<script.*?</script>', '', 'g'), '(?s)<a\b[^>]*>.*?</a>') AS a FROM pages)),
    cards AS (SELECT page_id, pos, regexp_extract(anchor, 'href="([^"]*)"', 1) AS href,
                     regexp_extract(anchor, '(?s)^<a\b[^>]*>(.*)</a>$', 1) AS inner_html FROM links)"""
_DECODED = "replace(replace(replace(replace(inner_html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


@query("extract_link_cards", f"WITH {_LINKS} SELECT page_id, pos, href, inner_html AS inner, {_DECODED} AS text FROM cards")
def extract_link_cards(spark, sf):
    return listing.extract_link_cards(v.table(spark, sf, "pages"))


@query("filter_job_links", f"WITH {_LINKS} SELECT page_id, pos, href FROM cards WHERE contains(href, '/th') OR contains(href, '/de') OR contains(href, 'ion')")
def filter_job_links(spark, sf):
    cards = listing.extract_link_cards(v.table(spark, sf, "pages"))
    return listing.filter_job_links(cards, "ion", ["/th", "/de"]).select("page_id", "pos", "href")


@query("link_tiers", f"""
    WITH {_LINKS}, tiered AS (SELECT *, CASE WHEN contains(href, '/des') OR contains(href, '/oue') THEN 1 ELSE 4 END AS tier FROM cards),
    best AS (SELECT *, min(tier) OVER (PARTITION BY page_id) AS chosen FROM tiered),
    kept AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS rn,
             row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS place FROM best WHERE tier = chosen OR chosen = 4)
    SELECT page_id, place AS pos, href, tier FROM kept WHERE tier = 4 OR rn = 1""")
def link_tiers(spark, sf):
    return listing.link_strategy_fallback(v.table(spark, sf, "pages"), paths=["/des", "/oue"]).select(
        "page_id", "pos", "href", "tier")


@query("first_n_cards", f"WITH {_LINKS} SELECT page_id, pos, href FROM cards WHERE pos < 4")
def first_n_cards(spark, sf):
    return listing.first_n_cards(v.table(spark, sf, "pages"), 4).select("page_id", "pos", "href")


@query("card_skip_reasons", f"""
    WITH {_LINKS} SELECT CASE WHEN NOT contains(href, '/vacancies/') THEN 'no_url' ELSE 'few_lines' END AS reason, count(*) AS cards
    FROM cards GROUP BY 1""")
def card_skip_reasons(spark, sf):
    return listing.card_skip_reasons(listing.extract_link_cards(v.table(spark, sf, "pages")))


@query("card_skip_reasons_positional", """
    SELECT CASE WHEN rn = 1 THEN 'kept' ELSE 'duplicate' END AS reason, count(*) AS cards
    FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1""")
def card_skip_reasons_positional(spark, sf):
    cards = v.order_cards(spark, sf, "/job/", "o_custkey")
    return listing.card_skip_reasons(cards, "positional", within=[])


_ORDER_LINES = "o_orderpriority || ' ● ' || place"


@query("card_lines", with_views(
    f"SELECT o_orderkey AS page_id, title || '|' || {_ORDER_LINES} || '|' || CASE WHEN o_orderstatus = 'P' THEN 'Dünən' "
    "ELSE 'since ' || strftime(o_orderdate, '%d-%m-%Y') END AS joined FROM order_fields", "order_fields"))
def card_lines(spark, sf):
    cards = listing.card_lines(v.order_cards(spark, sf), min_lines=2, min_chars=3)
    return cards.select("page_id", F.array_join("lines", "|").alias("joined"))


@query("card_fields_separator", with_views("""
    SELECT o_orderkey AS page_id, '/vacancies/' || o_orderkey AS href, title, o_orderpriority AS company,
           place AS location, card_date AS posted_date FROM order_fields""", "order_fields"))
def card_fields_separator(spark, sf):
    return listing.card_fields_separator(listing.card_lines(v.order_cards(spark, sf)), v.AS_OF)


@query("card_fields_positional", with_views(f"""
    SELECT o_orderkey AS page_id, title, {_ORDER_LINES} AS company, CASE WHEN o_orderstatus = 'P' THEN 'Dünən'
           ELSE 'since ' || strftime(o_orderdate, '%d-%m-%Y') END AS location FROM order_fields""", "order_fields"))
def card_fields_positional(spark, sf):
    return listing.card_fields_positional(listing.card_lines(v.order_cards(spark, sf))).select(
        "page_id", "title", "company", "location")


@query("location_override", with_views(f"""
    SELECT o_orderkey AS page_id, CASE WHEN o_orderstatus = 'P' THEN 'Dünən' ELSE {_ORDER_LINES} END AS location
    FROM order_fields""", "order_fields"))
def location_override(spark, sf):
    cards = listing.card_fields_positional(listing.card_lines(v.order_cards(spark, sf)))
    return listing.location_keyword_override(cards).select("page_id", "location")


@query("parse_posted_date", with_views(
    "SELECT o_orderkey AS page_id, card_date AS posted_date, CAST(date_diff('day', card_date, DATE '2024-01-31') AS INTEGER) AS days_ago FROM order_fields",
    "order_fields"))
def parse_posted_date(spark, sf):
    last = F.element_at(F.split("text", "\n"), -1)
    return v.order_cards(spark, sf).select("page_id", dates.parse_posted_date(last, v.AS_OF).alias("posted_date")).withColumn(
        "days_ago", dates.days_ago(F.col("posted_date"), v.AS_OF))


@query("absolute_url", f"WITH {_LINKS} SELECT page_id, pos, '{SITE_ROOT}' || href AS url FROM cards WHERE starts_with(href, '/')")
def absolute_url(spark, sf):
    cards = listing.extract_link_cards(v.table(spark, sf, "pages"))
    return cards.select("page_id", "pos", text.absolute_url(F.col("href"), SITE_ROOT + "/").alias("url"))


@query("default_unknown", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'Unknown' ELSE l_returnflag END AS flag FROM lineitem""")
def default_unknown(spark, sf):
    flag = F.translate("l_returnflag", "N", "")
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.default_unknown(flag).alias("flag"))


@query("listings_from_payload", f"""
    SELECT 'B' AS source, pos, CASE WHEN title = '' THEN 'Unknown' ELSE title END AS title, company, 'Unknown' AS location,
           CAST(NULL AS DATE) AS posted_date, '{SITE_ROOT}/job/' || doc_id AS job_url
    FROM (SELECT doc_id, source AS company, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
                 unnest(string_split(text, chr(10))) AS title FROM documents)""")
def listings_from_payload_query(spark, sf):
    """Each document is a payload: one listing per line."""
    url = F.concat(F.lit("/job/"), F.col("doc_id").cast("string"))
    payload = F.to_json(F.transform(F.split("text", "\n"), lambda line: F.struct(
        url.alias("url"), line.alias("title"), F.col("source").alias("company"), F.lit("").alias("location"))))
    payloads = v.table(spark, sf, "documents").select(payload.alias("payload"))
    return listings_from_payload(payloads, "payload", SITE_ROOT, "B")


# -- crawls --------------------------------------------------------------------

_CRAWL_SCROLLS = """
    seen AS (SELECT crawl_id, url, min(scroll_no) AS scroll_no FROM crawl_log GROUP BY ALL),
    fresh AS (SELECT crawl_id, scroll_no, count(*) AS new_urls FROM seen GROUP BY ALL),
    scrolls AS (SELECT site, c.crawl_id, c.scroll_no, max(height) AS height, count(*) AS cards FROM crawl_log c GROUP BY ALL),
    grown AS (SELECT s.*, coalesce(new_urls, 0) AS new_urls,
              CAST(sum(coalesce(new_urls, 0)) OVER (PARTITION BY s.crawl_id ORDER BY s.scroll_no) AS BIGINT) AS total_urls
              FROM scrolls s LEFT JOIN fresh f ON f.crawl_id = s.crawl_id AND f.scroll_no = s.scroll_no),
    steps AS (SELECT *, height = lag(height, 1, 0) OVER w AS same FROM grown WINDOW w AS (PARTITION BY crawl_id ORDER BY scroll_no)),
    runs AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY crawl_id ORDER BY scroll_no) AS run FROM steps),
    by_height AS (SELECT crawl_id, min(scroll_no) AS cutoff FROM (
        SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY crawl_id, run ORDER BY scroll_no) AS streak FROM runs)
        WHERE streak >= 2 GROUP BY crawl_id),
    aged AS (SELECT site, crawl_id, CAST(min(CASE WHEN scroll_no >= 14 THEN scroll_no END) AS INTEGER) AS age_cutoff FROM scrolls GROUP BY ALL)"""


def _crawl_sql(body: str) -> str:
    return with_views("", "crawl_log").rstrip() + "," + _CRAWL_SCROLLS + body


@query("last_visible_date", with_views("""
    SELECT site, crawl_id, scroll_no, max(card_date) AS last_date, strftime(max(card_date), '%d-%m-%Y') AS last_text
    FROM crawl_log GROUP BY ALL""", "crawl_log"))
def last_visible_date(spark, sf):
    return crawl.last_visible_date(v.crawl_log(spark, sf), v.AS_OF)


@query("cutoff_by_age", _crawl_sql("SELECT * FROM aged"))
def cutoff_by_age(spark, sf):
    return crawl.cutoff_by_age(v.crawl_log(spark, sf), 14, v.AS_OF)


@query("distinct_growth", _crawl_sql("SELECT * FROM grown"))
def distinct_growth(spark, sf):
    return crawl.distinct_growth(v.crawl_log(spark, sf))


def _steady(log: DataFrame) -> DataFrame:
    """The log with one card per scroll, so that the card count never changes."""
    return log.groupBy(*crawl.SCROLL).agg(F.max("height").alias("height"), F.max("pos").alias("pos"), F.lit("u").alias("url"))


@query("cutoff_stalled", _crawl_sql("""
    , same_count AS (SELECT site, crawl_id, scroll_no, height,
             height = lag(height, 1, 0) OVER w AND lag(scroll_no) OVER w IS NOT NULL AS same
             FROM scrolls WINDOW w AS (PARTITION BY crawl_id ORDER BY scroll_no)),
    islands AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY crawl_id ORDER BY scroll_no) AS run FROM same_count)
    SELECT site, crawl_id, min(CASE WHEN streak >= 3 THEN scroll_no END) AS stall_cutoff FROM (
      SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY crawl_id, run ORDER BY scroll_no) AS streak FROM islands)
    GROUP BY ALL"""))
def cutoff_stalled(spark, sf):
    return crawl.cutoff_stalled(_steady(v.crawl_log(spark, sf)), streak=3)


@query("apply_cutoff", _crawl_sql("""
    SELECT c.site, c.crawl_id, c.scroll_no, c.url, c.pos FROM (
      SELECT *, row_number() OVER (PARTITION BY crawl_id, url ORDER BY scroll_no, pos) AS rn FROM crawl_log) c
    JOIN aged a ON a.crawl_id = c.crawl_id
    LEFT JOIN (SELECT crawl_id, min(scroll_no) AS stop FROM (
        SELECT *, height = lag(height, 1, 0) OVER w AND total_urls = lag(total_urls, 1, 0) OVER w AS still FROM grown
        WINDOW w AS (PARTITION BY crawl_id ORDER BY scroll_no)) WHERE still GROUP BY crawl_id) s ON s.crawl_id = c.crawl_id
    WHERE rn = 1 AND c.scroll_no <= least(coalesce(age_cutoff, 100), coalesce(stop, 100), 100)"""))
def apply_cutoff(spark, sf):
    kept = crawl.apply_cutoff(v.crawl_log(spark, sf), v.AS_OF, target_days=14, distinct_urls=True)
    return kept.select("site", "crawl_id", "scroll_no", "url", "pos")


_SITE_SCROLLS = """
    limits (site, bound, streak, by_age) AS (VALUES ('A', 100, 1, true), ('B', 30, 3, false)),
    within AS (SELECT l.*, streak, by_age FROM site_log l LEFT JOIN limits ON limits.site = l.site WHERE bound IS NULL OR scroll_no <= bound),
    seen AS (SELECT crawl_id, url, min(scroll_no) AS scroll_no FROM within GROUP BY ALL),
    fresh AS (SELECT crawl_id, scroll_no, count(*) AS new_urls FROM seen GROUP BY ALL),
    scrolls AS (SELECT site, streak, by_age, w.crawl_id, w.scroll_no, max(height) AS height, count(*) AS cards, max(days) AS days FROM within w GROUP BY ALL),
    grown AS (SELECT s.*, sum(coalesce(new_urls, 0)) OVER (PARTITION BY s.crawl_id ORDER BY s.scroll_no) AS total_urls
              FROM scrolls s LEFT JOIN fresh f ON f.crawl_id = s.crawl_id AND f.scroll_no = s.scroll_no),
    steps AS (SELECT *, height = lag(height, 1, 0) OVER w AND n = lag(n, 1, 0) OVER w AS same
              FROM (SELECT *, CASE WHEN site = 'B' THEN total_urls ELSE cards END AS n FROM grown) WINDOW w AS (PARTITION BY crawl_id ORDER BY scroll_no)),
    runs AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY crawl_id ORDER BY scroll_no) AS run FROM steps),
    stalls AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY crawl_id, run ORDER BY scroll_no) AS stalled FROM runs)"""


@query("apply_site_rules", with_views("", "site_log").rstrip() + "," + _SITE_SCROLLS + """,
    stops AS (SELECT crawl_id, min(scroll_no) AS stop FROM stalls WHERE stalled >= streak OR (by_age AND days >= 60) GROUP BY crawl_id),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, url ORDER BY scroll_no, pos) AS rn FROM within)
    SELECT f.site, f.crawl_id, f.scroll_no, f.url, f.pos FROM firsts f LEFT JOIN stops ON stops.crawl_id = f.crawl_id
    WHERE rn = 1 AND (stop IS NULL OR f.scroll_no <= stop)""")
def apply_site_rules(spark, sf):
    """Two sites cut by their own rules, a third that has none."""
    return crawl.apply_site_rules(v.site_log(spark, sf), v.AS_OF, 60).select("site", "crawl_id", "scroll_no", "url", "pos")


@query("cutoff_stalled_by_cards", with_views("", "site_log").rstrip() + """,
    scrolls AS (SELECT site, crawl_id, scroll_no, max(height) AS height, count(*) AS cards FROM site_log GROUP BY ALL),
    steps AS (SELECT *, height = lag(height, 1, 0) OVER w AND cards = lag(cards, 1, 0) OVER w AS same FROM scrolls WINDOW w AS (PARTITION BY crawl_id ORDER BY scroll_no))
    SELECT site, crawl_id, min(CASE WHEN same THEN scroll_no END) AS stall_cutoff FROM steps GROUP BY ALL""")
def cutoff_stalled_by_cards(spark, sf):
    """Standstill of height and of a card count that changes."""
    return crawl.cutoff_stalled(v.site_log(spark, sf))


# -- detail extraction ---------------------------------------------------------

_STRIPPED = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@query("section_extract", f"""
    SELECT doc_id AS page_id, {_STRIPPED} AS description, CAST(NULL AS VARCHAR) AS requirements, source AS category FROM documents""")
def section_extract(spark, sf):
    return det.section_details(v.section_pages(spark, sf)).select("page_id", "description", "requirements", "category")


@query("label_value_fields", """
    SELECT doc_id AS page_id, lang AS deadline, CAST(NULL AS VARCHAR) AS job_level, source AS education, n_chars AS views FROM documents""")
def label_value_fields(spark, sf):
    return det.section_details(v.section_pages(spark, sf)).select("page_id", "deadline", "job_level", "education", "views")


@query("title_and_sections", """
    SELECT doc_id AS page_id, trim(split_part(text, chr(10), 1)) AS title, lang AS description, '' AS requirements FROM documents""")
def title_and_sections(spark, sf):
    return det.title_and_sections_loose(v.section_pages(spark, sf))


@query("salary_span", "SELECT doc_id AS page_id, '500 - ' || n_chars || ' azn' AS salary FROM documents")
def salary_span(spark, sf):
    shown = text.visible_text(F.col("html"), " ")
    return v.section_pages(spark, sf).select("page_id", numbers.salary_span(shown).alias("salary"))


@query("vocabulary_hit", """
    SELECT doc_id, CASE WHEN contains(text, 'license') THEN 'license' WHEN contains(text, 'License') THEN 'License'
                        WHEN contains(text, 'the') THEN 'the' END AS word FROM documents""")
def vocabulary_hit(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", text.first_word_in_order(F.col("text"), ["license", "License", "the"]).alias("word"))


@query("compact_number", """
    SELECT o_orderkey, CASE o_orderstatus
        WHEN 'O' THEN NULLIF(o_custkey, 0)
        WHEN 'F' THEN CAST(trunc(CAST((o_custkey % 100) || '.5' AS DOUBLE) * 1000) AS BIGINT)
        ELSE NULL END AS n FROM orders""")
def compact_number(spark, sf):
    key = F.col("o_custkey").cast("string")
    tail = (F.col("o_custkey") % 100).cast("string")
    shown = F.when(F.col("o_orderstatus") == "O", key).when(
        F.col("o_orderstatus") == "F", F.concat(tail, F.lit(".5K"))).otherwise(F.concat(key, F.lit(".234")))
    return v.table(spark, sf, "orders").select("o_orderkey", numbers.compact_number(shown).alias("n"))


@query("visible_text", r"""
    SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'),
        '<[!/a-zA-Z][^>]*>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS text FROM pages""")
def visible_text(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", text.visible_text(F.col("html")).alias("text"))


@query("decoded_references", """
    SELECT doc_id, source || '+' || chr(8211) || chr(8204) || '&nosuch;' || lang || '&' || chr(10878) || chr(233) AS text FROM documents""")
def decoded_references(spark, sf):
    """Named and numeric references from all over the list, known and unknown."""
    marked = F.concat("source", F.lit("&plus;&#150;&zwnj;&nosuch;"), "lang", F.lit("&amp;&ges;&#xe9;"))
    return v.table(spark, sf, "documents").select("doc_id", text.visible_text(marked).alias("text"))


@query("meta_description", """
    SELECT doc_id AS page_id, nullif(lang || ' "' || source || '"', '') AS description FROM documents""")
def meta_description(spark, sf):
    """Pages whose only text is in the meta tag."""
    tag = F.concat(F.lit('<html><head><meta name="x" content="no"><META content="'), "lang", F.lit(" &quot;"), "source",
                   F.lit('&quot;" property="og:description"></head><script>'), F.replace("text", F.lit("<"), F.lit(" ")), F.lit("</script></html>"))
    empty = F.lit(None).cast("string")
    return v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), det.meta_fallback(empty, det.meta_description(tag)).alias("description"))


@query("meta_fallback", """
    SELECT o_orderkey AS page_id, 'read ' || o_orderkey AS description FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT o_orderkey, 'a b' FROM orders WHERE o_orderstatus = 'P'""")
def meta_fallback(spark, sf):
    own = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("read "), F.col("o_orderkey").cast("string")))
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"), det.meta_fallback(own, F.lit("a b")).alias("description"))


@query("payload_details", """
    SELECT o_orderkey AS page_id, 'Responsibilities for order ' || o_orderkey || ' {contract}' AS description,
           'Requirements: customer ' || o_custkey AS requirements, 'Contract' AS job_type, CAST(NULL AS VARCHAR) AS education,
           o_orderpriority AS category, strftime(o_orderdate, '%Y-%m-%d') AS deadline, o_orderkey AS views,
           CASE o_orderstatus WHEN 'O' THEN CAST(floor(o_totalprice) AS BIGINT) || ' AZN' WHEN 'F' THEN 'by talk' END AS salary
    FROM orders""")
def payload_details(spark, sf):
    return det.payload_details(v.payload_pages(spark, sf)).select(
        "page_id", "description", "requirements", "job_type", "education", "category", "deadline", "views", "salary")


@query("split_sections", """
    WITH marked AS (SELECT doc_id, text,
        CASE WHEN contains(text, 'License') THEN strpos(text, 'License') WHEN contains(text, 'with') THEN strpos(text, 'with') END AS r,
        CASE WHEN contains(text, 'the') THEN strpos(text, 'the') END AS d FROM documents),
    cut AS (SELECT doc_id, text,
        CASE WHEN r IS NULL AND d IS NULL THEN text
             WHEN d IS NULL THEN trim(substr(text, 1, r - 1), ' ' || chr(10))
             WHEN d < r THEN trim(substr(text, d, r - d), ' ' || chr(10))
             ELSE trim(substr(text, d), ' ' || chr(10)) END AS description,
        CASE WHEN r < d THEN trim(substr(text, r, d - r), ' ' || chr(10))
             WHEN r IS NOT NULL THEN trim(substr(text, r), ' ' || chr(10)) END AS requirements FROM marked)
    SELECT doc_id, coalesce(nullif(description, ''), text) AS description, nullif(requirements, '') AS requirements FROM cut""")
def split_sections(spark, sf):
    cut = det.split_sections(v.table(spark, sf, "documents"), "text", ["License", "with"], ["the"])
    return cut.select("doc_id", "description", "requirements")


@query("classify_by_keyword", """
    SELECT doc_id, CASE WHEN contains(t, 'license') THEN 'Licensed' WHEN contains(t, 'tion') THEN 'Tion'
                        WHEN contains(t, 'src1') THEN 'One' END AS label
    FROM (SELECT doc_id, lower(text || chr(10) || source) AS t FROM documents WHERE text <> '')""")
def classify_by_keyword(spark, sf):
    pairs = [("license", "Licensed"), ("tion", "Tion"), ("src1", "One")]
    return v.table(spark, sf, "documents").select(
        "doc_id", det.classify_by_keyword(F.col("text"), F.col("source"), pairs).alias("label"))


def _detail_pages(spark, sf):
    """Pages of all postings but those of one feed, each with the posting's URL."""
    pages = v.section_pages(spark, sf).drop("url")
    urls = v.posting_batch(spark, sf).filter(F.col("source") != "src3").select(F.col("id").alias("page_id"), F.col("job_url").alias("url"))
    return pages.join(urls, "page_id")


_SITES = [det.Site("en.example.com", "sections"), det.Site("fr.example.com", "payload")]
_JOB = """
    landed AS (SELECT job_url, max(pos) AS doc_id FROM posting_batch WHERE source <> 'src3' GROUP BY job_url),
    wanted AS (SELECT id, p.job_url FROM postings p WHERE NOT EXISTS (SELECT 1 FROM details d WHERE d.job_id = p.id)
               AND (contains(job_url, 'en.example.com') OR contains(job_url, 'fr.example.com'))),
    job AS (SELECT w.id AS job_id, w.job_url, CASE WHEN contains(w.job_url, 'en.') THEN """ + _STRIPPED + """ END AS description,
            CASE WHEN contains(w.job_url, 'en.') THEN source END AS category, CASE WHEN contains(w.job_url, 'en.') THEN n_chars END AS views,
            CASE WHEN l.doc_id IS NULL THEN 'no_page' ELSE 'ok' END AS status
     FROM wanted w LEFT JOIN landed l ON l.job_url = w.job_url LEFT JOIN documents d ON d.doc_id = l.doc_id)"""


def _details_job(spark, sf):
    pending = queries.pending_details(v.postings(spark, sf), v.details(spark, sf), ordered=False)
    pages = _detail_pages(spark, sf)
    return det.details_job(pending, pages.filter(usable_page(pages.columns)), _SITES)


@query("details_job", with_views("", "postings", "details").rstrip() + "," + _JOB + " SELECT * FROM job")
def details_job(spark, sf):
    return _details_job(spark, sf).select("job_id", "job_url", "description", "category", "views", "status")


@query("extract_counts", with_views("", "postings", "details").rstrip() + "," + _JOB
       + " SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed FROM job")
def extract_counts(spark, sf):
    return det.extract_counts(_details_job(spark, sf))


# -- notification --------------------------------------------------------------

_WHOLE_WORD = r"(^|[^\p{L}\p{N}_])(license|und)([^\p{L}\p{N}_]|$)"
_SELECTED = f"""
    unsent AS ({_UNSENT}),
    selected AS (SELECT *, CASE WHEN hit THEN 'send' ELSE 'skip' END AS outcome,
                 NOT hit AND (coalesce(description, '') <> '' OR coalesce(requirements, '') <> '') AS mark
          FROM (SELECT *, regexp_matches(lower(title) || ' ' || lower(coalesce(description, '')) || ' ' || lower(coalesce(requirements, '')), '{_WHOLE_WORD}') AS hit
                FROM unsent))"""
_MESSAGE = """
    parts AS (SELECT id, outcome, '💼 <b>' || title || '</b>' || chr(10) || '🏢 ' || company || chr(10) || '📍 ' || location
                 || coalesce(chr(10) || '📅 Paylaşılıb: ' || posted_date, '')
                 || CASE WHEN views <> 0 THEN chr(10) || '👁 Baxış: ' || views ELSE '' END AS header,
              coalesce(chr(10) || '🔗 <a href="' || job_url || '">Ətraflı bax</a>', '') AS link,
              nullif(description, '') AS d, nullif(requirements, '') AS r FROM selected),
    sized AS (SELECT *, CASE WHEN d IS NOT NULL AND r IS NOT NULL THEN floor((4046 - length(header) - length(link)) / 2)
                             ELSE 4046 - length(header) - length(link) END AS space FROM parts),
    messages AS (SELECT id, outcome, header
          || coalesce(chr(10) || chr(10) || '📝 <b>Təsvir:</b>' || chr(10) || CASE WHEN length(d) > space THEN substr(d, 1, CAST(greatest(space - 3, 0) AS BIGINT)) || '...' ELSE d END, '')
          || coalesce(chr(10) || chr(10) || '✅ <b>Tələblər:</b>' || chr(10) || CASE WHEN length(r) > space THEN substr(r, 1, CAST(greatest(space - 3, 0) AS BIGINT)) || '...' ELSE r END, '')
          || CASE WHEN link <> '' THEN chr(10) || link ELSE '' END AS message FROM sized)"""


def _notify_sql(body: str, message: bool = False) -> str:
    return with_views("", "flagged_postings", "details").rstrip() + "," + _SELECTED + ("," + _MESSAGE if message else "") + body


def _selected(spark, sf):
    return notify.select_for_delivery(_unsent(spark, sf), WORDS)


@query("select_for_delivery", _notify_sql(" SELECT id, outcome, mark FROM selected"))
def select_for_delivery(spark, sf):
    return _selected(spark, sf).select("id", "outcome", "mark")


@query("render_message", _notify_sql(" SELECT id, message FROM messages", message=True))
def render_message(spark, sf):
    return notify.with_message(_unsent(spark, sf), SITE_ROOT).select("id", "message")


@query("outbox", _notify_sql(" SELECT id AS job_id, 'chat' AS chat_id, message FROM messages WHERE outcome = 'send'", message=True))
def outbox(spark, sf):
    chosen = _selected(spark, sf).filter(F.col("outcome") == "send")
    return notify.render_messages(chosen, "chat", AT(), SITE_ROOT).select("job_id", "chat_id", "message")


@query("apply_outcomes", _notify_sql(
    ", " + f"results AS ({v.SQL_VIEWS['delivery_results']})"
    " SELECT job_id, CASE WHEN ok THEN 'sent' ELSE 'failed' END AS outcome, error FROM results"
    " WHERE job_id IN (SELECT id FROM selected WHERE outcome = 'send')"))
def apply_outcomes(spark, sf):
    sent = _selected(spark, sf).filter(F.col("outcome") == "send").select(F.col("id").alias("job_id"))
    return notify.apply_outcomes(sent, v.delivery_results(spark, sf), AT()).select("job_id", "outcome", "error")


@query("retry_after", """
    SELECT event_id AS job_id, CASE WHEN event_type = 'error' THEN CAST(floor(value) AS INTEGER) ELSE 0 END AS retry_after FROM events""")
def retry_after(spark, sf):
    return notify.retry_after(v.delivery_results(spark, sf)).select("job_id", "retry_after")


@query("delivery_counts", _notify_sql("""
    SELECT count(*) FILTER (outcome = 'send') AS sent, count(*) FILTER (outcome = 'skip') AS skipped,
           count(*) FILTER (outcome = 'skip' AND NOT mark) AS skipped_without_details, 0::BIGINT AS failed FROM selected"""))
def delivery_counts(spark, sf):
    return notify.delivery_counts(_selected(spark, sf))


@query("truncate_body", """
    SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS body FROM documents""")
def truncate_body(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", notify.budget_truncate(F.col("text"), F.lit(500)).alias("body"))


# -- orders as postings --------------------------------------------------------

@query("ingest_new_orders", with_views("""
    SELECT (SELECT max(id) FROM order_postings WHERE source = 'O') + row_number() OVER (ORDER BY pos) AS id, pos, source, title, job_url, posted_date
    FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY pos) AS rn FROM order_postings WHERE source <> 'O') a
    WHERE rn = 1 AND job_url NOT IN (SELECT job_url FROM order_postings WHERE source = 'O')""", "order_postings"))
def ingest_new_orders(spark, sf):
    both = v.order_postings(spark, sf)
    return ingest.ingest_new(both.filter("source <> 'O'"), both.filter("source = 'O'"))


@query("pending_details_orders", with_views(
    "SELECT * FROM order_postings p WHERE NOT EXISTS (SELECT 1 FROM line_details d WHERE d.job_id = p.id)",
    "order_postings", "line_details"))
def pending_details_orders(spark, sf):
    return queries.pending_details(v.order_postings(spark, sf), v.line_details(spark, sf))


@query("unsent_with_details_orders", with_views("""
    SELECT id, title, posted_date, coalesce(s.outcome, '') <> '' AS logged, views FROM order_postings p
    LEFT JOIN (SELECT DISTINCT job_id, 'x' AS outcome FROM delivery_log) s ON s.job_id = p.id
    LEFT JOIN line_details d ON d.job_id = p.id""", "order_postings", "line_details", "delivery_log"))
def unsent_with_details_orders(spark, sf):
    """All orders with the first returned line, and whether the delivery log knows them."""
    logged = v.delivery_log(spark, sf).select(F.col("job_id").alias("id")).distinct().withColumn("logged", F.lit(True))
    flagged = v.order_postings(spark, sf).withColumn("is_sent", F.lit(False))
    return queries.unsent_with_details(flagged, v.line_details(spark, sf), ordered=False).join(logged, "id", "left").select(
        "id", "title", "posted_date", F.coalesce("logged", F.lit(False)).alias("logged"), "views")


@query("ingest_from_payload", f"""
    WITH cards AS (SELECT doc_id AS payload, pos, CASE WHEN title = '' THEN 'Unknown' ELSE title END AS title, '{SITE_ROOT}/job/' || title AS job_url
        FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS title FROM documents)),
    first AS (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY payload, pos) AS rn FROM cards)
    SELECT row_number() OVER (ORDER BY payload, pos) AS id, payload, pos, title, job_url FROM first WHERE rn = 1""")
def ingest_from_payload(spark, sf):
    """Each document is a payload with a listing per line, so first cards of all payloads share a place."""
    payload = F.to_json(F.transform(F.split("text", "\n"), lambda line: F.struct(F.concat(F.lit("/job/"), line).alias("url"), line.alias("title"))))
    payloads = v.table(spark, sf, "documents").select(F.col("doc_id").alias("payload"), payload.alias("cards"))
    listings = listings_from_payload(payloads, "cards", SITE_ROOT, "B", keep=["payload"])
    nothing = spark.createDataFrame([], "id long, job_url string")
    return ingest.ingest_new(listings, nothing, ["payload", "pos"]).select("id", "payload", "pos", "title", "job_url")


_DETAIL_ROWS = """
    SELECT doc_id AS pos, CASE WHEN doc_id % 11 <> 0 THEN doc_id // 2 END AS job_id,
           CASE WHEN source <> 'src7' THEN md5(text[:12]) END AS job_url FROM documents"""


@query("accept_details", f"""
    WITH RECURSIVE all_rows AS ({_DETAIL_ROWS}),
    stored AS (SELECT job_id, job_url FROM all_rows WHERE pos % 17 = 0),
    batch AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM all_rows WHERE pos % 17 <> 0),
    known AS (SELECT *, coalesce(job_id IN (SELECT job_id FROM stored WHERE job_id IS NOT NULL), false)
                     OR coalesce(job_url IN (SELECT job_url FROM stored WHERE job_url IS NOT NULL), false) AS before FROM batch),
    steps AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS ids, []::VARCHAR[] AS urls, NULL::BIGINT AS pos, NULL::BIGINT AS job_id, NULL::VARCHAR AS job_url, '' AS outcome
        UNION ALL SELECT k.n,
            CASE WHEN good AND k.job_id IS NOT NULL THEN list_append(s.ids, k.job_id) ELSE s.ids END,
            CASE WHEN good AND k.job_url IS NOT NULL THEN list_append(s.urls, k.job_url) ELSE s.urls END,
            k.pos, k.job_id, k.job_url, CASE WHEN k.before THEN 'stored' WHEN good THEN 'accepted' ELSE 'taken' END
        FROM steps s JOIN (SELECT * FROM known) k ON k.n = s.n + 1,
             LATERAL (SELECT NOT k.before AND NOT coalesce(list_contains(s.ids, k.job_id), false) AND NOT coalesce(list_contains(s.urls, k.job_url), false) AS good))
    SELECT pos, job_id, job_url, outcome FROM steps WHERE n > 0""")
def accept_details(spark, sf):
    """Detail rows whose ids and URLs do not pair: two documents share an id, copies share a URL."""
    rows = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 11 != 0, F.floor(F.col("doc_id") / 2)).alias("job_id"),
        F.when(F.col("source") != "src7", F.md5(F.substring("text", 1, 12).cast("binary"))).alias("job_url"))
    stored = F.col("pos") % 17 == 0
    return ingest.accept_details(rows.filter(~stored), rows.filter(stored), ["pos"])


# -- incremental rounds --------------------------------------------------------

def _land(spark, sf, files_per_round=None, sites=()):
    """The feeds landed as JSON files in the shared folder, an empty store, and what runs rounds over them."""
    folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    # As few files as their size allows, or the number of rounds would follow that of the tasks that wrote them.
    v.posting_batch(spark, sf).drop("id").withColumn("feed", F.col("source")).hint("rebalance", "feed").write.partitionBy("feed").json(f"{folder}/landed")
    store = Store(spark, f"{folder}/store").init()
    urls = v.posting_batch(spark, sf).select(F.col("id").alias("page_id"), F.col("job_url").alias("url"))
    if sites:
        # The merge deals the pages out by id, so that a table of one row group is no single task.
        pages = v.section_pages(spark, sf).drop("url").join(urls.hint("merge"), "page_id")
        pages.withColumns({"status": F.lit(200), "length": F.octet_length("html")}).write.option("compression", COMPACT).parquet(f"{folder}/pages")
    else:
        spark.createDataFrame([], schemas.PAGE).write.parquet(f"{folder}/pages")
    settings = rounds.RoundSettings("chat", sites, WORDS, SITE_ROOT, source_folders={"lost": "feed=lost"})

    def run():
        landed = rounds.landed_files(spark, f"{folder}/landed", files_per_round)
        pages = lambda: spark.read.parquet(f"{folder}/pages")
        rounds.start_rounds(store, landed, pages, settings, f"{folder}/checkpoint").awaitTermination()

    return folder, store, run


def _run_rounds(spark, sf, sites, files_per_round=None) -> Store:
    _, store, run = _land(spark, sf, files_per_round, sites)
    run()
    return store


@query("incremental_rounds", with_views("SELECT job_url, title, location FROM postings", "postings"))
def incremental_rounds(spark, sf):
    """Several rounds over the landed files store the same postings as one batch would."""
    return _run_rounds(spark, sf, (), files_per_round=10).read("postings").select("job_url", "title", "location")


@query("round_metrics", with_views("", "postings").rstrip() + f""",
    read AS (SELECT p.title, CASE WHEN p.job_url IS NOT NULL THEN {_STRIPPED} END AS description, p.job_url FROM postings p JOIN documents d ON d.doc_id = p.id),
    chosen AS (SELECT *, regexp_matches(lower(title) || ' ' || lower(coalesce(description, '')) || ' ', '{_WHOLE_WORD}') AS hit FROM read)
    SELECT count(*) AS inserted, (SELECT count(*) FROM documents) - count(*) AS skipped, count(job_url) AS details_ok,
           0::BIGINT AS details_failed, count(*) FILTER (hit) AS send, count(*) FILTER (NOT hit) AS skip,
           count(*) FILTER (NOT hit AND coalesce(description, '') = '') AS skip_no_details FROM chosen""")
def round_metrics(spark, sf):
    """Counters of one full round: listings, details out of pages, selection."""
    store = _run_rounds(spark, sf, (det.Site("example.com", "sections"),))
    return store.read("metrics").select("inserted", "skipped", "details_ok", "details_failed", "send", "skip", "skip_no_details")


_SITE = (det.Site("example.com", "sections"),)
_ROUND = with_views("", "postings").rstrip() + f""",
    read AS (SELECT p.id, p.title, CASE WHEN p.job_url IS NOT NULL THEN {_STRIPPED} END AS description, p.job_url FROM postings p JOIN documents d ON d.doc_id = p.id),
    chosen AS (SELECT *, regexp_matches(lower(title) || ' ' || lower(coalesce(description, '')) || ' ', '{_WHOLE_WORD}') AS hit FROM read)"""


def _messages(store: Store, batch_id: int) -> DataFrame:
    """URL and first line of the messages of a batch."""
    urls = store.read("postings").select(F.col("id").alias("job_id"), "job_url")
    return store.read("outbox").filter(F.col("batch_id") == batch_id).join(urls, "job_id").select(
        "job_url", F.split_part("message", F.lit("\n"), F.lit(1)).alias("headline"))


@query("outbox_rounds", _ROUND + " SELECT job_url, '💼 <b>' || title || '</b>' AS headline FROM chosen WHERE hit")
def outbox_rounds(spark, sf):
    """The outbox that a round over listings and pages leaves."""
    return _messages(_run_rounds(spark, sf, _SITE), 0)


@query("retry_undelivered", _ROUND + """
    SELECT job_url, '💼 <b>' || title || '</b>' AS headline FROM chosen WHERE hit AND length(job_url) + length(title) > 0 AND ascii(right(job_url, 1)) % 2 = 0""")
def retry_undelivered(spark, sf):
    """Messages of a first round whose sending failed come again in the second, the others do not."""
    folder, store, run = _land(spark, sf, sites=_SITE)
    run()
    failed = F.ascii(F.right("job_url", F.lit(1))) % 2 == 0
    sent = store.read("outbox").join(store.read("postings").select(F.col("id").alias("job_id"), "job_url"), "job_id")
    rounds.deliver(store, sent.filter("job_url IS NOT NULL").select(
        "job_id", (~failed).alias("ok"), F.when(failed, "lost").alias("error")), 0)
    v.posting_batch(spark, sf).drop("id").filter("job_url IS NOT NULL").write.json(f"{folder}/landed/feed=again")  # nothing new, but a round
    run()
    return _messages(store, 1)


@query("rejected_listings", """
    SELECT '{"pos": ' || doc_id || ', "title": "cut' AS line, 'malformed' AS reason FROM documents WHERE n_chars % 10 = 0
    UNION ALL SELECT NULL, 'unreadable'
    UNION ALL SELECT 'read ' || (SELECT count(*) FROM documents), 'listings'""")
def rejected_listings(spark, sf):
    """Broken lines, a file that cannot be read, and how many listings of the other files went through."""
    folder, store, run = _land(spark, sf)
    broken = v.table(spark, sf, "documents").filter("n_chars % 10 = 0").select(
        F.concat(F.lit('{"pos": '), F.col("doc_id").cast("string"), F.lit(', "title": "cut')).alias("value"))
    broken.write.text(f"{folder}/landed/feed=broken")
    create_once(spark, f"{folder}/landed/feed=lost/part.json.gz", "this is no compressed file")
    run()
    totals = store.read("metrics").agg(
        F.sum(F.col("inserted") + F.col("skipped")).alias("read"), F.sum("failed_files").alias("files"), F.sum("failed_sources").alias("sources"))
    whole = totals.filter("files = 1 AND sources = 1").select(F.concat(F.lit("read "), F.col("read").cast("string")).alias("line"), F.lit("listings").alias("reason"))
    return store.read("rejected").select(
        "line", F.when(F.col("line").isNull() & F.endswith("file", F.lit("part.json.gz")), "unreadable").otherwise(F.col("reason")).alias("reason")).unionAll(whole)


# -- the store -----------------------------------------------------------------

def _filled(spark, sf) -> Store:
    """A store with the postings and details of the driver tables."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}").init()
    blank = lambda df, name: df.select(*[
        c if c in df.columns else F.lit(None).cast(store.schema(name)[c].dataType).alias(c) for c in store.schema(name).names if c != "batch_id"])
    store.append("postings", blank(v.postings(spark, sf), "postings"), -1)
    store.append("details", blank(v.details(spark, sf).withColumn("id", F.col("job_id")), "details"), -1)
    return store


@query("publish_and_read", with_views("""
    SELECT p.id, title, p.job_url, description, requirements FROM postings p
    LEFT JOIN (SELECT * FROM details WHERE NOT (description IS NULL AND requirements IS NULL)) d ON d.job_id = p.id""", "postings", "details"))
def publish_and_read(spark, sf):
    """Both tables written, empty details deleted in a new version, and both read back by the file readers."""
    store = _filled(spark, sf)
    Feed(store).delete_empty_details()
    path = lambda name: f"{store.root}/{name}/part={store.entries(name)[0]['part']}"
    details = readers.read_details(spark, path("details")).select(F.col("job_id").alias("id"), "description", "requirements")
    return readers.read_postings(spark, path("postings")).select("id", "title", "job_url").join(details, "id", "left")


@query("mark_reset_mark", with_views("""
    SELECT id, coalesce(id IN (SELECT job_id FROM details), false) AND id IN (SELECT user_id FROM events)
               OR id IN (SELECT user_id FROM events WHERE event_type = 'click') AS is_sent FROM postings""", "postings", "details"))
def mark_reset_mark(spark, sf):
    """Marked by hand, reset where there are no details, and some marked again: every action counts."""
    feed = Feed(_filled(spark, sf))
    users = v.table(spark, sf, "events").select("user_id", "event_type")
    feed.mark_sent(users.select("user_id"))
    feed.reset_sent_without_details()
    feed.mark_sent(users.filter("event_type = 'click'").select("user_id"))
    return feed.postings().select("id", "is_sent")


@query("deliver_in_parts", f"""
    WITH results AS ({v.SQL_VIEWS['delivery_results']})
    SELECT job_id, CASE WHEN ok THEN 'sent' ELSE 'failed' END AS outcome, error FROM results WHERE job_id IN (SELECT o_orderkey FROM orders)""")
def deliver_in_parts(spark, sf):
    """Results of one batch in two parts, the first of them twice."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}").init()
    store.append("outbox", v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.lit("chat").alias("chat_id"), F.lit("text").alias("message"), AT().alias("rendered_at")), 0)
    results = v.delivery_results(spark, sf)
    for part in (0, 1, 0):
        rounds.deliver(store, results.filter(F.col("job_id") % 2 == part), 0)
    return store.read("delivery").filter("step = 'result'").select("job_id", "outcome", "error")


@query("read_pages", """
    SELECT page_id, url FROM pages WHERE page_id % 3 = 0 AND html <> ''""")
def read_pages(spark, sf):
    """Landed pages of which a third was fetched well."""
    status = F.when(F.col("page_id") % 3 == 0, 200).when(F.col("page_id") % 3 == 1, 404)
    landed = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    v.table(spark, sf, "pages").withColumn("status", status).write.parquet(landed)
    return readers.read_pages(spark, landed).select("page_id", "url")


@query("limit_one", with_views("SELECT least(count(*), 1) AS n FROM postings WHERE job_url LIKE '%en.example%'", "postings"))
def limit_one(spark, sf):
    """Is there a posting of the site."""
    return queries.posting_count(queries.limit_one(queries.url_like(v.postings(spark, sf), "en.example")))


@query("stream_dedupe_seeded", with_views("""
    SELECT DISTINCT job_url FROM arriving WHERE job_url NOT IN (SELECT job_url FROM stored WHERE job_url IS NOT NULL)
    UNION ALL SELECT NULL FROM arriving WHERE job_url IS NULL""", "arriving", "stored"))
def stream_dedupe_seeded(spark, sf):
    """A stream of listings against postings that were stored before it began."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    arriving, stored = _split_feeds(spark, sf)
    arriving.drop("id").repartition(4, "pos").write.json(f"{folder}/landed")
    fresh = rounds.stream_dedupe(rounds.landed_listings(spark, f"{folder}/landed", files_per_round=2), stored=stored)
    fresh.select("job_url").writeStream.format("parquet").option("path", f"{folder}/fresh").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("job_url string").parquet(f"{folder}/fresh")

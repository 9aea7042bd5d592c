"""Postings, details, logs and pages as views over the driver tables, in Spark and in SQL.

The documents are the postings of twenty feeds: the first line is the title, the text decides
the URL, so copies collide. Feed ``src7`` gives no links, ``src11`` gives no dates. Events are
the delivery log and the crawl log.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.ingest import dedupe_first_wins
from postmill.operators.mutate import with_sent_flag

AS_OF = datetime.date(2024, 1, 31)
NO_LINK_FEED, NO_DATE_FEED = "src7", "src11"
# Feeds that count as stored when new ones arrive.
STORED_FEEDS = ["src0", "src1", "src2", "src3", "src7", "src11", "src15"]
OUTCOMES = {"click": "sent", "purchase": "sent", "signup": "skipped", "error": "failed", "view": "reset"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- postings and details ------------------------------------------------------

def posting_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://"), "lang", F.lit(".example.com/"), F.md5(F.col("text").cast("binary")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 30).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "source",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("company"), F.col("lang").alias("location"),
        F.when(F.col("source") != NO_LINK_FEED, url).alias("job_url"),
        F.when(F.col("source") != NO_DATE_FEED, day).alias("posted_date"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_first_wins(posting_batch(spark, sf_dir), "job_url", ["pos"], unique_order=True).drop("pos")


def flagged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sent_flag(postings(spark, sf_dir), delivery_log(spark, sf_dir))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled postings have details: text when of good quality, requirements when toxic."""
    body = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return postings(spark, sf_dir).select("id", "job_url").join(labels, "id").join(body, "id").select(
        F.col("id").alias("job_id"), "job_url",
        F.when(F.col("quality") == 1, F.col("text")).alias("description"),
        F.when(F.col("toxic") == 1, F.col("text")).alias("requirements"),
        F.col("n_chars").alias("views"))


def stored_feeds(df: DataFrame) -> Column:
    return df["source"].isin(STORED_FEEDS)


# -- logs ----------------------------------------------------------------------

def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in OUTCOMES.items()])
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 10).alias("job_id"), outcome.alias("outcome"),
        F.dayofmonth("ts").cast("long").alias("batch_id"), F.col("ts").alias("at"))


def delivery_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    waited = F.concat(F.lit("Flood control exceeded. Retry in "), F.floor("value").cast("string"), F.lit(" seconds"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), (~failed).alias("ok"), F.when(failed, waited).alias("error"))


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl per user, one scroll per day; the height follows the day of the month in steps,
    so that some scrolls change nothing."""
    day = F.dayofmonth("ts")
    shown = F.date_format(F.date_sub(F.lit(AS_OF), day), "dd-MM-yyyy")
    return table(spark, sf_dir, "events").select(
        F.lit("A").alias("site"), F.col("user_id").alias("crawl_id"), day.alias("scroll_no"),
        (F.floor(day / 4) * 100).alias("height"), F.col("event_id").alias("pos"),
        F.concat_ws("/", "event_type", F.floor("value").cast("string")).alias("url"),
        F.array(F.col("event_type"), F.lit("Company ● City"), shown).alias("card_lines"))


def site_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls of two sites, longer than either allows: scrolls of five hours, heights in steps of five scrolls, dates that
    grow old at three speeds, and as many cards in a scroll as there were events."""
    crawl, scroll = F.col("user_id") % 24, F.floor((F.dayofmonth("ts") * 24 + F.hour("ts")) / 5).cast("int")
    days = F.floor(scroll / (1 + crawl % 3)).cast("int")
    return table(spark, sf_dir, "events").select(
        F.when(crawl % 2 == 0, "A").when(crawl % 4 == 1, "B").otherwise("C").alias("site"), crawl.alias("crawl_id"), scroll.alias("scroll_no"),
        (F.floor(scroll / 5) * 100).alias("height"), F.col("event_id").alias("pos"),
        F.concat_ws("/", "event_type", (F.floor("value") % 7).cast("string")).alias("url"),
        F.array(F.col("event_type"), F.lit("Company"), F.date_format(F.date_sub(F.lit(AS_OF), days), "dd-MM-yyyy")).alias("card_lines"))


# -- a wider binding: orders as postings, lines as details ----------------------

def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and priority share a URL."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("source"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("https://c.example.com/"), F.col("o_custkey").cast("string"), F.lit("/"), "o_orderpriority").alias("job_url"),
        F.to_date("o_orderdate").alias("posted_date"))


def line_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first returned line of each order."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    return lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.min(F.struct("l_linenumber", "l_partkey")).alias("first")).select("job_id", F.col("first.l_partkey").alias("views"))


# -- pages built from columns --------------------------------------------------

def _escape(c: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-rendered pages of the documents; every line of the text is a paragraph."""
    lines = F.split(_escape(F.col("text")), "\n")
    body = F.concat(F.lit("<p>"), F.array_join(lines, "</p><p>"), F.lit("</p>"))
    row = lambda label, value: F.concat(
        F.lit(f'<div class="flex justify-between"><span>{label}</span><b>'), value, F.lit("</b></div>"))
    html = F.concat(
        F.lit("<html><body><h1>"), _escape(F.split_part("text", F.lit("\n"), F.lit(1))),
        F.lit('</h1><div class="flex items-center"><p>new</p><p>'), F.format_number(F.col("n_chars"), 0),
        F.lit('</p></div><section><h3> Təsvir </h3><i>x</i><div class="description-html big">'), body,
        F.lit("</div><h3>Kateqoriya</h3><span>"), F.col("source"),
        F.lit("</span></section><aside><h3>Vakansiya haqqında</h3>"),
        row("Son tarix:", F.col("lang")), row("Təhsil", F.lit("?")), row("Təhsil", F.col("source")),
        F.lit('<div class="flex justify-between"><span>Vakansiya növü</span></div></aside>'
              "<h2>Təsvir ətraflı</h2><p>"), F.col("lang"),
        F.lit("</p><p>500 - "), F.col("n_chars").cast("string"), F.lit(" azn</p></body></html>"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("doc_id").cast("string").alias("url"), html.alias("html"))


def _script_string(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def payload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-page-site pages of the orders. Category, salary and text are passed as arguments.

    Orders are few bytes in the file and much work as pages, so they are dealt out first: their row groups are too few tasks.
    """
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"]
    price = F.floor("o_totalprice").cast("string")
    text = F.concat(
        F.lit("<p>Responsibilities for order "), F.col("o_orderkey").cast("string"),
        F.lit(" {contract}</p><p>Requirements: customer "), F.col("o_custkey").cast("string"), F.lit("</p>"))
    html = F.concat(
        F.lit('<html><head><meta property="og:description" content="short"></head><body><script>other()</script>'
              "<script>window.__NUXT__=(function(a,b,c,d){return {state:{title:\"vacancy:{text:1}\",tab_data:{id:1,"
              "vacancy:{company:{text:\"inner\"},text:d,category:{id:7,title:b},deadline_at:\""),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00",salary:c,v_count:'),
        F.col("o_orderkey").cast("string"), F.lit("}}}}})({},"), _script_string(F.col("o_orderpriority")),
        F.lit(","), F.when(F.col("o_orderstatus") == "O", price).when(F.col("o_orderstatus") == "F", _script_string(F.lit(" by talk "))).otherwise("void 0"),
        F.lit(","), _script_string(text), F.lit("))</script></body></html>"))
    orders = table(spark, sf_dir, "orders").select(*columns).repartition(F.xxhash64(*columns))
    return orders.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


def order_cards(spark: SparkSession, sf_dir: str, path: str = "/vacancies/", key: str = "o_orderkey") -> DataFrame:
    """Listing cards of the orders: title, separator line, date line; some name a place."""
    place = F.when(F.col("o_orderstatus") == "O", "Bakı ofisi").when(F.col("o_orderstatus") == "F", "REMOTE work").otherwise("Paris")
    day = F.when(F.col("o_orderstatus") == "P", F.lit(" Dünən ")).otherwise(
        F.concat(F.lit("since "), F.date_format("o_orderdate", "dd-MM-yyyy")))
    title = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    inner = F.concat(
        F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("<h3> Urgent &amp; "), title, F.lit("</h3>\n"))).otherwise(F.concat(title, F.lit("\n"))),
        F.col("o_orderpriority"), F.lit(" ● "), place, F.lit("\n  \n"), day)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit(path), F.col(key).cast("string")).alias("href"), inner.alias("inner"),
        F.replace(F.regexp_replace(inner, "<[^>]+>", ""), F.lit("&amp;"), F.lit("&")).alias("text"))


# -- the same in SQL -----------------------------------------------------------

_IN_FEEDS = ", ".join(f"'{s}'" for s in STORED_FEEDS)
_CASE_OUTCOME = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOMES.items()) + " END"

SQL_VIEWS = {
    "posting_batch": f"""
        SELECT doc_id AS id, doc_id AS pos, source, split_part(text, chr(10), 1) AS title,
               source AS company, lang AS location,
               CASE WHEN source <> '{NO_LINK_FEED}' THEN 'https://' || lang || '.example.com/' || md5(text) END AS job_url,
               CASE WHEN source <> '{NO_DATE_FEED}' THEN CAST(DATE '2024-01-01' + CAST(n_chars % 30 AS INTEGER) AS DATE) END AS posted_date
        FROM documents""",
    "postings": """
        SELECT id, source, title, company, location, job_url, posted_date FROM (
          SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY pos) AS rn FROM posting_batch)
        WHERE rn = 1 OR job_url IS NULL""",
    "delivery_log": f"""
        SELECT event_id // 10 AS job_id, {_CASE_OUTCOME} AS outcome, extract(day FROM ts) AS batch_id, ts AS logged
        FROM events""",
    "flagged_postings": """
        SELECT p.*, coalesce(s.is_sent, false) AS is_sent FROM postings p LEFT JOIN (
          SELECT job_id, outcome <> 'reset' AS is_sent FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY batch_id DESC, logged DESC) AS rn
            FROM delivery_log WHERE outcome <> 'failed') WHERE rn = 1) s ON s.job_id = p.id""",
    "details": """
        SELECT p.id AS job_id, p.job_url, CASE WHEN quality = 1 THEN text END AS description,
               CASE WHEN toxic = 1 THEN text END AS requirements, n_chars AS views
        FROM postings p JOIN labels l ON l.doc_id = p.id JOIN documents d ON d.doc_id = p.id""",
    "stored": f"SELECT * FROM posting_batch WHERE source IN ({_IN_FEEDS})",
    "arriving": f"SELECT * FROM posting_batch WHERE source NOT IN ({_IN_FEEDS})",
    "accepted": """
        SELECT a.* FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY pos) AS rn
                         FROM arriving WHERE title IS NOT NULL) a
        WHERE (rn = 1 OR job_url IS NULL)
          AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.job_url = a.job_url)""",
    "delivery_results": """
        SELECT event_id AS job_id, event_type <> 'error' AS ok,
               CASE WHEN event_type = 'error' THEN 'Flood control exceeded. Retry in ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' seconds' END AS error
        FROM events""",
    "crawl_log": """
        SELECT 'A' AS site, user_id AS crawl_id, CAST(extract(day FROM ts) AS INTEGER) AS scroll_no,
               CAST(extract(day FROM ts) // 4 * 100 AS BIGINT) AS height, event_id AS pos,
               event_type || '/' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS url,
               CAST(DATE '2024-01-31' - CAST(extract(day FROM ts) AS INTEGER) AS DATE) AS card_date
        FROM events""",
    "site_log": """
        SELECT CASE WHEN c % 2 = 0 THEN 'A' WHEN c % 4 = 1 THEN 'B' ELSE 'C' END AS site, c AS crawl_id, CAST(s AS INTEGER) AS scroll_no,
               CAST(s // 5 * 100 AS BIGINT) AS height, event_id AS pos, event_type || '/' || CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) AS url,
               s // (1 + c % 3) AS days
        FROM (SELECT *, user_id % 24 AS c, (extract(day FROM ts) * 24 + extract(hour FROM ts)) // 5 AS s FROM events)""",
    "order_postings": """
        SELECT o_orderkey AS id, o_orderkey AS pos, o_orderstatus AS source, 'Order ' || o_orderkey AS title,
               'https://c.example.com/' || o_custkey || '/' || o_orderpriority AS job_url, CAST(o_orderdate AS DATE) AS posted_date
        FROM orders""",
    "line_details": """
        SELECT l_orderkey AS job_id, l_partkey AS views FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn
          FROM lineitem WHERE l_returnflag = 'R') WHERE rn = 1""",
    "order_fields": """
        SELECT *, CASE o_orderstatus WHEN 'O' THEN 'Bakı ofisi' WHEN 'F' THEN 'REMOTE work' ELSE 'Paris' END AS place,
               CASE WHEN o_orderpriority = '2-HIGH' THEN 'Urgent & ' ELSE '' END || 'Order ' || o_orderkey AS title,
               CASE WHEN o_orderstatus = 'P' THEN DATE '2024-01-30' ELSE CAST(o_orderdate AS DATE) END AS card_date
        FROM orders""",
}
_NEEDS = {
    "postings": ["posting_batch"], "flagged_postings": ["postings", "delivery_log"], "details": ["postings"],
    "stored": ["posting_batch"], "arriving": ["posting_batch"], "accepted": ["stored", "arriving"],
}


def with_views(body: str, *names: str) -> str:
    """The query with the views it uses, each after those it is made of."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order) + "\n" + body

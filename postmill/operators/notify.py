"""Selection, message text and delivery outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed_values as fv
from postmill.functions.keywords import match_any_keyword
from postmill.functions.numbers import retry_after_seconds
from postmill.functions.text import absolute_url
from postmill.operators import mutate
from postmill.operators.queries import has_details


def _label(name: str, value: Column) -> Column:
    before, after = fv.MESSAGE_LABELS[name].split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def _escaped(value: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(sign), F.lit(code))
    return value


def budget_truncate(body: Column, space: Column) -> Column:
    """The body, cut to the space with an ellipsis when it is longer."""
    keep = F.greatest(space - len(fv.ELLIPSIS), F.lit(0)).cast("int")
    return F.when(F.length(body) > space, F.concat(F.substring(body, F.lit(1), keep), F.lit(fv.ELLIPSIS))).otherwise(body)


def with_message(postings: DataFrame, site_root: str = "", escape_html: bool = False) -> DataFrame:
    """Add the message of each posting.

    Title, company and location always appear; other lines only when they hold something.
    Description and requirements share what the header leaves of the limit. Header length is
    computed once, as a column of its own.
    """
    clean = _escaped if escape_html else (lambda c: c)
    have = set(postings.columns)
    col = lambda n: clean(F.col(n).cast("string")) if n in have else F.lit(None).cast("string")
    filled = lambda c: F.nullif(c, F.lit(""))

    head = [_label(n, F.coalesce(col(n), F.lit("None"))) for n in ("title", "company", "location")]
    for n in ("job_type", "job_level", "category", "salary", "posted_date", "deadline"):
        head.append(F.when(filled(col(n)).isNotNull(), _label(n, col(n))))
    if "views" in have:
        head.append(F.when(F.col("views") != 0, _label("views", F.col("views"))))

    url = filled(absolute_url(F.col("job_url"), site_root))
    link = F.when(url.isNotNull(), _label("link", url))
    desc, req = filled(col("description")), filled(col("requirements"))

    staged = postings.withColumns({
        "_header": F.concat_ws("\n", *head), "_link": link, "_desc": desc, "_req": req,
    })
    space = F.lit(fv.MESSAGE_LIMIT - fv.LABEL_ALLOWANCE) - F.length("_header") - F.coalesce(F.length("_link"), F.lit(0))
    staged = staged.withColumn("_space", F.when(
        F.col("_desc").isNotNull() & F.col("_req").isNotNull(), F.floor(space / 2)).otherwise(space))
    body = lambda n: budget_truncate(F.col(n), F.col("_space"))
    message = F.concat_ws("\n", "_header", _label("description", body("_desc")),
                          _label("requirements", body("_req")), "_link")
    return staged.withColumn("message", message).drop("_header", "_link", "_desc", "_req", "_space")


def render_messages(selected: DataFrame, chat_id: str, at: Column, site_root: str = "",
                    escape_html: bool = False) -> DataFrame:
    """Outbox rows."""
    return with_message(selected, site_root, escape_html).select(
        F.col("id").alias("job_id"), F.lit(chat_id).alias("chat_id"), "message", at.alias("rendered_at"))


def select_for_delivery(unsent: DataFrame, words: Sequence[str]) -> DataFrame:
    """Unsent postings with ``outcome`` and ``mark``.

    Matching ones are to be sent; the others are skipped, and of these only those that already
    have details are marked as done.
    """
    match = match_any_keyword(F.col("title"), F.col("description"), F.col("requirements"), words)
    return unsent.withColumn("outcome", F.when(match, "send").otherwise("skip")).withColumn(
        "mark", (F.col("outcome") == "skip") & has_details())


def skipped_log(selected: DataFrame, at: Column) -> DataFrame:
    """Log rows for skipped postings that have details."""
    return mutate.log_rows(selected.filter("mark"), mutate.SKIPPED, at)


def apply_outcomes(outbox: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Log rows for delivery results ``(job_id, ok, error)`` of messages in the outbox.

    A job with several results counts as sent if any of them was good. The outbox is merged, never broadcast: its ids are
    few bytes in the file and many in the driver.
    """
    best = results.groupBy("job_id").agg(F.max("ok").alias("ok"), F.max("error").alias("error"))
    known = best.join(outbox.select("job_id").hint("merge"), "job_id", "left_semi")
    return known.select(
        "job_id", F.when(F.col("ok"), mutate.SENT).otherwise(mutate.FAILED).alias("outcome"),
        F.when(~F.col("ok"), F.col("error")).alias("error"), at.alias("at"),
        F.lit("result").alias("call"), F.lit("result").alias("step"))


def retry_after(results: DataFrame) -> DataFrame:
    return results.withColumn("retry_after", retry_after_seconds(F.col("error")))


def delivery_counts(selected: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Sent, skipped, of these without details, and failed.

    Without results every selected message counts as sent.
    """
    rows = selected.select("outcome", "mark")
    if log is not None:
        rows = rows.filter(F.col("outcome") == "skip").unionAll(
            log.select(F.col("outcome"), F.lit(False)))
    return rows.agg(
        F.count_if(F.col("outcome").isin("send", mutate.SENT)).alias("sent"),
        F.count_if(F.col("outcome") == "skip").alias("skipped"),
        F.count_if((F.col("outcome") == "skip") & ~F.col("mark")).alias("skipped_without_details"),
        F.count_if(F.col("outcome") == mutate.FAILED).alias("failed"))

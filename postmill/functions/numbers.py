"""Numbers found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.fixed_values import CURRENCY_WORDS, RETRY_PATTERN

COMPACT = r"^[\d,\.]+[KkMm]?$"


def _compact_value(text: Column) -> Column:
    """Value of ``208``, ``1.2K``, ``3M``; NULL when it cannot be read. Zero stays zero."""
    plain = F.upper(F.replace(text, F.lit(","), F.lit("")))
    digits = F.translate(plain, "KM", "").try_cast("double")
    return (
        F.when(plain.endswith("K"), (digits * 1000).try_cast("bigint"))
        .when(plain.endswith("M"), (digits * 1000000).try_cast("bigint"))
        .when(plain.rlike(r"^\d+$"), plain.try_cast("bigint"))
    )


def compact_number(c: Column) -> Column:
    """Number of one text; unreadable texts and zero are NULL."""
    return F.when(c.rlike(COMPACT), F.nullif(_compact_value(c), F.lit(0).cast("bigint")))


def first_compact_number(texts: Column) -> Column:
    """First number in the list that is not zero; an unreadable one before it ends the search."""
    values = F.transform(texts, _compact_value)
    return F.try_element_at(F.filter(values, lambda v: v.isNull() | (v != 0)), F.lit(1))


def salary_span(text: Column) -> Column:
    """First ``n`` or ``n - m`` followed by a currency word, as written."""
    pattern = r"(?iU)(\d+(?:\s*-\s*\d+)?)\s*(?:" + "|".join(CURRENCY_WORDS) + ")"
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def retry_after_seconds(error: Column) -> Column:
    seconds = F.nullif(F.regexp_extract(error, RETRY_PATTERN, 1), F.lit(""))
    return F.coalesce(seconds.try_cast("int"), F.lit(0))

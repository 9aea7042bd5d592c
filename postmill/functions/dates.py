"""Dates. ``as_of`` is always given; nothing reads the clock."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.fixed_values import TODAY, YESTERDAY
from postmill.functions.text import strip

DAY_FIRST = r"[0-9]{2}-[0-9]{2}-[0-9]{4}"


def as_date(as_of: Column | datetime.date | str) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def parse_posted_date(c: Column, as_of: Column | datetime.date | str) -> Column:
    """Local words for yesterday and today, else the first ``dd-MM-yyyy``; bad dates are NULL.

    A text without a date never reaches the date parser, whose failures are costly.
    """
    day = as_date(as_of)
    text = strip(c)
    word = F.lower(text)
    return (
        F.when(word == YESTERDAY, F.date_sub(day, 1))
        .when(word == TODAY, day)
        .otherwise(F.try_to_date(F.nullif(F.regexp_extract(text, DAY_FIRST, 0), F.lit("")), "dd-MM-yyyy"))
    )


def looks_like_date(c: Column) -> Column:
    """The stripped line starts with a date or is one of the two words."""
    text = strip(c)
    return text.rlike("^" + DAY_FIRST) | F.lower(text).isin(YESTERDAY, TODAY)


def days_ago(date: Column, as_of: Column | datetime.date | str) -> Column:
    return F.datediff(as_date(as_of), date)

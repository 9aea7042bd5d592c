"""Keyword lists and whole-word matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.fixed_values import DEFAULT_KEYWORDS
from postmill.functions.text import strip


def parse_keyword_list(setting: str | None = None) -> list[str]:
    """Comma list to stripped lower-case words; the default list when unset."""
    setting = DEFAULT_KEYWORDS if setting is None else setting
    return [w.strip().lower() for w in setting.split(",") if w.strip()]


def keyword_list(setting: Column) -> Column:
    """The same for a column holding comma lists."""
    words = F.split(F.coalesce(setting, F.lit(DEFAULT_KEYWORDS)), ",")
    return F.filter(F.transform(words, lambda w: F.lower(strip(w))), lambda w: w != "")


def _quoted(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def whole_word_pattern(words: Sequence[str]) -> str:
    """One regular expression for all words; ``\\b`` knows Unicode letters."""
    return r"(?U)\b(?:" + "|".join(_quoted(w) for w in words) + r")\b"


def match_any_keyword(title: Column, description: Column, requirements: Column,
                      words: Sequence[str]) -> Column:
    """Any keyword occurs as a whole word in the three texts joined by one space."""
    if not words:
        return F.lit(True)
    empty = F.lit("")
    text = F.lower(F.concat(
        F.coalesce(title, empty), F.lit(" "),
        F.coalesce(description, empty), F.lit(" "),
        F.coalesce(requirements, empty),
    ))
    return text.rlike(whole_word_pattern(words))

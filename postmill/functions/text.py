"""Text expressions. Everything here is built in, so it stays in the JVM."""

from __future__ import annotations

import html.entities
import json
import string
import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.fixed_values import UNKNOWN

WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Both patterns begin with a fixed character, which lets the matcher pass over plain text quickly.
_HIDDEN = r"(?is)<(?:!--.*?-->|(script|style|template)\b.*?</\1\s*>)"
_MARKUP = r"(?is)<(?:!--.*?-->|(script|style|template)\b.*?</\1\s*>|[!/?a-z][^>]*>)"
_BREAK = "\u0001"  # stands for "markup was here"; not a character of any HTML text

# A map is searched from its beginning, so the names are dealt by hash to many small ones.
_DEALT = 512
_NAMED = json.dumps([
    {n[:-1]: c for n, c in html.entities.html5.items() if n.endswith(";") and zlib.crc32(n[:-1].encode()) % _DEALT == i} for i in range(_DEALT)])
# Numbers 128 to 159 stand for the signs of the Windows code page, as in HTML; five of them have none.
_WINDOWS = json.dumps({str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)})


def strip(c: Column) -> Column:
    """Remove all Unicode whitespace at both ends (``trim`` alone removes spaces)."""
    return F.trim(c, F.lit(WHITESPACE))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _ascii_fold_word(word: str) -> str:
    return word.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def like_contains(c: Column, word: str) -> Column:
    """``c LIKE '%word%'``: ASCII case ignored, ``%`` and ``_`` live, no escape character.

    A word without wildcards is reduced by the optimizer to a plain substring test.
    """
    pattern = f"%{_ascii_fold_word(word)}%"
    unused = next(chr(i) for i in range(1, 0x110000) if chr(i) not in pattern)
    return F.like(ascii_fold(c), F.lit(pattern), F.lit(unused))


def default_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))


def absolute_url(url: Column, site_root: str) -> Column:
    """Put the site root before URLs that start with ``/``."""
    return F.when(url.startswith("/"), F.concat(F.lit(site_root.rstrip("/")), url)).otherwise(url)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def first_word_in_order(c: Column, words: Sequence[str]) -> Column:
    """The first of the words, in list order, that occurs in the text."""
    return F.coalesce(*[F.when(c.contains(w), F.lit(w)) for w in words])


def first_label_in_order(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(c.contains(w), F.lit(label)) for w, label in pairs])


def lines(text: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _entity(segment: Column) -> Column:
    """Decode the entity a segment starts with; the segment follows an ``&``."""
    name = F.regexp_extract(segment, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
    number = F.when(
        name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10).try_cast("int")
    ).otherwise(F.substring(name, 2, 7).try_cast("int"))
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    windows = F.try_element_at(F.from_json(F.lit(_WINDOWS), "map<string,string>"), number.cast("string"))
    char = F.coalesce(F.when(number.between(128, 159), windows), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))
    value = F.when(name.startswith("#"), char).otherwise(
        F.try_element_at(F.get(F.from_json(F.lit(_NAMED), "array<map<string,string>>"), (F.crc32(name) % _DEALT).cast("int")), name)
    )
    rest = F.substring(segment, F.length(name) + 2, F.length(segment))
    return F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), segment))


def decode_entities(c: Column) -> Column:
    """Decode named (HTML 5) and numeric character references in one pass."""
    parts = F.split(c, "&")
    decoded = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _entity)
    return F.when(c.contains("&"), F.concat(parts[0], F.array_join(decoded, ""))).otherwise(c)


def remove_hidden(html_text: Column) -> Column:
    """Drop comments, scripts, styles and templates."""
    return F.regexp_replace(html_text, _HIDDEN, "")


def visible_text(html_text: Column, sep: str = "", stripped: bool = False) -> Column:
    """Text of flat or slightly broken HTML, its pieces joined by ``sep``.

    With ``stripped`` each piece is stripped and empty pieces are dropped before joining.
    Pages whose structure matters go through the details job instead.
    """
    if sep == "" and not stripped:
        return decode_entities(F.regexp_replace(html_text, _MARKUP, ""))
    marked = F.regexp_replace(html_text, _MARKUP, _BREAK)
    if stripped:
        pieces = F.filter(F.transform(F.split(decode_entities(marked), _BREAK), strip), lambda x: x != "")
        return F.array_join(pieces, sep)
    inner = F.regexp_replace(marked, f"^{_BREAK}+|(?<!{_BREAK}){_BREAK}+$", "")
    return decode_entities(F.regexp_replace(inner, _BREAK + "+", sep))

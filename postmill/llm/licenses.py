"""Licence scan by a positional index of rare words, with built-in expressions only.

Words are runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased. Each notice is indexed by the
``INDEXED`` words of its key phrase with the highest IDF over all documents, with their positions. A file looks up every
indexed word it holds, however many notices it quotes; a word at ``i`` that a key phrase holds at ``p`` proposes that
phrase at ``i - p``. A proposal stands if at least two indexed words agree on it and the key phrase stands there word for
word. Its score is the share of the notice's words found in place; those before the file's first word are missing, and the
notice's start is negative then. Base phrases are found where their words stand consecutively, and always keep their
labels, with score 1.

All of it happens within a row, in one scan without a shuffle, after one scan that counts documents per licence
word (one row per word of the notices goes to the driver).

Defined results: NULL counts as empty; without words all counts are 0, positions NULL, labels empty and the score
0. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.licence_texts import BASE, NOTICES

INDEXED = 5
AGREEING = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    spaced = F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _words(text: str) -> list[str]:
    return text.split(" ")


def word_idf(docs: DataFrame, text: str = "text", notices: Sequence[tuple[str, str, str]] = NOTICES) -> dict[str, float]:
    """IDF over all documents of every word of the notices."""
    vocabulary = sorted({w for _, t, _ in notices for w in _words(t)})
    held = F.array_intersect(word_array(F.col(text)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}  # at most one row per word of the notices
    n = found.pop("", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def _literal(value: object, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _base_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase, given that its words are in the text."""
    parts = _words(phrase)

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return hit

    rare = max(parts, key=len)
    possible = F.array_contains(words, rare) & (F.size(words) >= len(parts))
    return F.when(possible, F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(
        F.array().cast("array<int>"))


def scan(docs: DataFrame, idf: dict[str, float], text: str = "text", notices: Sequence[tuple[str, str, str]] = NOTICES) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` (starts per label), ``found`` (label, start, share), ``labels`` and ``score``."""
    templates, postings = [], []
    for t, (label, body, phrase) in enumerate(notices):
        words, key = _words(body), _words(phrase)
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        rare = sorted(set(key), key=lambda w: (-idf[w], w))[:INDEXED]
        index = [{"p": p, "w": w} for p, w in enumerate(key) if w in rare]
        postings += [{"w": x["w"], "t": t, "p": x["p"]} for x in index]
        templates.append({"label": label, "words": words, "at": at, "key": key, "index": index})
    indexed = sorted({p["w"] for p in postings})
    table = _literal(templates, "array<struct<label string, words array<string>, at int, key array<string>, index array<struct<p int, w string>>>>")
    listed = _literal(postings, "array<struct<w string, t int, p int>>")
    rows = docs.withColumn("_words", word_array(F.col(text)))
    words = F.col("_words")
    rows = rows.withColumn("_held", F.array_intersect(F.array(*map(F.lit, indexed)), words))
    # Proposals as numbers, notice and start of its key phrase, so that repeats fall together cheaply.
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(indexed))
    proposed = F.flatten(F.transform(hits, lambda h: F.transform(
        F.filter(listed, lambda p: p["w"] == h["w"]),
        lambda p: p["t"].cast("long") * (1 << 40) + (h["i"] - p["p"]).cast("long"))))
    proposed = F.filter(F.array_distinct(proposed), lambda c: (c % (1 << 40) >= 0) & (c % (1 << 40) < (1 << 39)) & (c >= 0))
    rows = rows.withColumn("_proposed", F.when(F.size("_held") >= AGREEING, proposed).otherwise(F.array().cast("array<bigint>")))

    def stands(c: Column) -> Column:
        notice = F.get(table, F.floor(c / (1 << 40)).cast("int"))
        start = (c % (1 << 40)).cast("int")
        agree = F.size(F.filter(notice["index"], lambda x: F.get(words, start + x["p"]) == x["w"])) >= AGREEING
        return agree & (F.slice(words, start + 1, F.size(notice["key"])) == notice["key"])

    def describe(c: Column) -> Column:
        notice = F.get(table, F.floor(c / (1 << 40)).cast("int"))
        start = (c % (1 << 40)).cast("int") - notice["at"]
        same = F.size(F.filter(F.transform(notice["words"], lambda w, i: F.get(words, start + i) == w), lambda x: x))
        return F.struct(notice["label"].alias("label"), start.alias("start"), (same / F.size(notice["words"])).alias("share"))

    rows = rows.withColumn("found", F.transform(F.filter("_proposed", stands), describe))
    rows = rows.withColumn("base", F.array(*[
        F.struct(F.lit(label).alias("label"), _base_places(words, phrase).alias("starts")) for label, phrase in BASE]))
    rows = rows.withColumn("base_labels", F.array_sort(F.transform(F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])))
    rows = rows.withColumn("labels", F.array_sort(F.array_union("base_labels", F.array_distinct(F.transform("found", lambda f: f["label"])))))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)))
    return rows.withColumn("score", score).withColumn("n_words", F.size("_words").cast("long")).drop("_words", "_held", "_proposed")

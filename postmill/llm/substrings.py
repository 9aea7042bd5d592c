"""Substring dedup: repeated word runs found by seed and extend.

Seeds are winnowed anchors: of the ``k``-word hashes inside each window of ``length`` words the smallest, leftmost
one. Equal windows have equal anchors at equal places, so every repeat of ``length`` words or more meets itself
on an anchor. Documents are joined on anchors; an anchor that occurs in one document only is given up.

Extension: an occurrence's hull is the run of words in all windows that chose this anchor, i.e. the anchor with
its context both ways. Equal hulls match in full and are settled at once. Of different hulls on one anchor, all
windows are compared, which tells how far they agree to both sides. A window is covered if it also starts in a
document with a smaller key. The union of covered windows over neighbouring anchors is the maximal repeat.
Occurrences are compared as sets (smallest key per hull and per window), never as pairs, so a passage in a
third of all documents costs rows in proportion.

Repeated anchors, those with different hulls, and windows that several hulls share, reach the later steps as filters
of fixed size, which may pass too much, never too little; joins on the full hashes follow.

Defined results: NULL, empty texts and those below ``length`` words lose nothing; repeats within one document stay. Rows
with one key count as one holder, so nothing is removed on account of a row with the same key, but each row loses the
windows of its own text only (texts of one key are told apart by a hash); rows without a key lose nothing. Equal rows have
equal results. Very long texts are read whole, alone. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import run_hash, slices, texts_of
from postmill.sources.staging import stage

LENGTH = 50
ANCHOR = 10
FILTER_BITS = 25
WINDOW_BITS = 26


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of ``values[i:i + width]`` for every i where that fits."""
    value, index, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        n = len(value) - step
        if n <= 0:
            return np.zeros(0, np.int64)
        right = value[step:] < value[:n]
        value = np.where(right, value[step:], value[:n])
        index = np.where(right, index[step:], index[:n])
        size += step
    return index


def _occurrences(batch: pa.RecordBatch, length: int, k: int, passing: np.ndarray | None):
    """Anchor, hull, text, first window and number of windows of each occurrence, and the hashes of its windows."""
    words = texts_of(batch, lower=False)
    word = words.hashes()
    n = np.maximum(words.counts() - length + 1, 0)
    if not n.sum():
        return None
    gram = run_hash(word, np.arange(len(word) - k + 1), np.arange(k, len(word) + 1))
    least = _least_of(gram, length - k + 1)
    owner = np.repeat(np.arange(words.texts), n)
    start = np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + words.first[owner]
    chosen = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(start)))
    anchor = gram[chosen[heads]]
    if passing is not None:
        slot = (anchor >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        some = (passing[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
        heads, counts, anchor = heads[some], counts[some], anchor[some]
    lo = start[heads]
    return words, word, anchor, run_hash(word, lo, lo + counts + length - 1), owner[heads], lo, counts


def _anchors(docs: DataFrame, key: str, text: str, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _occurrences(batch, length, k, None)
            if found is not None:
                _, _, anchor, _, owner, _, _ = found
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column(0).take(pa.array(owner))], names=["anchor", "doc"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, "anchor long, doc long")


def _hulls(docs: DataFrame, key: str, text: str, length: int, k: int, passing: np.ndarray, with_windows: bool = False) -> DataFrame:
    """Occurrences of the anchors that pass: ``(anchor, hull, doc, content, lo, n[, windows])``; ``content`` is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _occurrences(batch, length, k, passing)
            if found is None or not len(found[2]):
                continue
            words, word, anchor, hull, owner, lo, counts = found
            out = [pa.array(anchor.view(np.int64)), pa.array(hull.view(np.int64)), *(batch.column(i).take(pa.array(owner)) for i in (0, 2)),
                   pa.array(lo - words.first[owner]), pa.array(counts)]
            if with_windows:
                begin = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
                window = run_hash(word, begin, begin + length)
                bounds = np.append(0, np.cumsum(counts)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(window.view(np.int64))))
            yield pa.RecordBatch.from_arrays(out, names=["anchor", "hull", "doc", "content", "lo", "n", "windows"][:len(out)])

    return docs.select(F.col(key), F.col(text).alias("text"), F.xxhash64(text).alias("content")).mapInArrow(
        run, "anchor long, hull long, doc long, content long, lo long, n long" + (", windows array<long>" if with_windows else ""))


def fixed_filter(rows: DataFrame, column: str, width: int = FILTER_BITS) -> np.ndarray:
    """Bits set by the top ``width`` bits of a 64-bit column; the size does not depend on the rows."""
    slot = F.shiftrightunsigned(F.col(column), 64 - width)
    cells = rows.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def _passing_windows(content: DataFrame, passing: np.ndarray) -> DataFrame:
    """``(id, first, at, window)`` of the windows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n = np.diff(lists.offsets.to_numpy())
            window = lists.flatten().to_numpy().view(np.uint64)
            owner, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slot = (window >> np.uint64(64 - WINDOW_BITS)).astype(np.int64)
            some = np.flatnonzero((passing[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(owner[some])) for i in (0, 1)), pa.array(at[some].astype(np.int32)), pa.array(window[some].view(np.int64))],
                names=["id", "first", "at", "window"])

    return content.mapInArrow(run, "id long, first long, at int, window long")


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """``(doc, content, runs)``: for each text with repeats, ``(lo, mask)`` entries; bit i of a mask is the window at word lo + i."""
    if length - k + 1 > 62:
        raise ValueError("the anchor may be at most 61 words shorter than the window")
    docs = docs.filter(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("long"))
    repeated = _anchors(docs, key, text, length, k).groupBy("anchor").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    passing = fixed_filter(repeated, "anchor")
    seen = _hulls(docs, key, text, length, k, passing)
    hulls = stage(seen.groupBy("anchor", "hull").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "hulls")
    # Windows are read only where hulls differ: equal ones are settled already.
    mixed = fixed_filter(hulls.groupBy("anchor").agg(F.count("*").alias("hulls")).filter("hulls > 1"), "anchor")
    content = stage(_hulls(docs, key, text, length, k, mixed, True).groupBy("anchor", "hull").agg(
        F.min("doc").alias("first"), F.any_value("windows").alias("windows")).withColumn("id", F.monotonically_increasing_id()), "windows")
    shared = stage(content.select("first", F.explode("windows").alias("window")).groupBy("window").agg(
        F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most").drop("most"), "shared-windows")
    meeting = _passing_windows(content.select("id", "first", "windows"), fixed_filter(shared, "window", WINDOW_BITS))
    masks = meeting.join(shared, "window").filter("least < first").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    masks = content.select("anchor", "hull", "id").join(masks, "id").drop("id")
    # A table of its own, so that the join with the occurrences is one that adaptive execution may split at hot hulls.
    known = stage(hulls.join(masks, ["anchor", "hull"], "left").filter("first < last OR mask IS NOT NULL"), "known-hulls")
    hit = seen.join(known, ["anchor", "hull"]).select(
        "doc", "content", "lo", F.when(F.col("first") < F.col("doc"), F.expr("shiftleft(1L, cast(n as int)) - 1")).otherwise(F.col("mask")).alias("mask"))
    return hit.filter("mask <> 0").groupBy("doc", "content").agg(F.collect_list(F.struct("lo", "mask")).alias("runs"))


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR,
           with_text: bool = False) -> DataFrame:
    """``(key, n_words, n_removed, kept_sha256[, kept_text])`` for every document."""
    runs = covered(docs, key, text, length, k)
    whole = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    own = (F.col("_key") == F.col("doc")) & (F.xxhash64("_text") == F.col("content"))
    joined = whole.join(runs, own, "left").select(F.col("_key").alias(key), F.col("_text").alias("text"), "runs.lo", "runs.mask")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = texts_of(batch, lower=False)
            raw, counts = words.data.tobytes(), words.counts()
            removed = np.zeros(len(words.start) + 1, np.int64)
            los, masks = batch.column(2), batch.column(3)
            for i in np.flatnonzero(los.is_valid().to_numpy(zero_copy_only=False)).tolist():
                lo = np.array(los[i].as_py(), np.int64) + words.first[i]
                bits = np.array(masks[i].as_py(), np.int64)
                at = (lo[:, None] + np.arange(length - k + 1))[(bits[:, None] >> np.arange(length - k + 1)) & 1 > 0]
                np.add.at(removed, at, 1)
                np.add.at(removed, at + length, -1)
            gone = np.cumsum(removed[:-1]) > 0
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            sums, texts = [], []
            for i in range(words.texts):
                a, b = words.first[i], words.first[i + 1]
                keep = np.flatnonzero(~gone[a:b]) + a
                line = b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
                sums.append(hashlib.sha256(line).hexdigest())
                if with_text:
                    texts.append(line.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(lost), pa.array(sums, pa.string()), *([pa.array(texts, pa.string())] if with_text else [])],
                names=[key, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return joined.mapInArrow(run, f"{key} {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))

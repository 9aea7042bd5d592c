"""Benchmark decontamination: which documents contain which test items.

Documents and items are sets of five-word shingles (words of ASCII letters, digits and non-ASCII signs; A-Z
lower-cased). An item is contained if at least ``CONTAINED`` of its distinct shingles occur in a document.

Items are partitioned by size (powers of two). An item of ``n`` shingles is there if at most ``n - ceil(0.8 n)`` are missing, so of
the ``n - ceil(0.8 n) + t`` smallest shingle hashes, its bottom-k MinHash sketch, a document that contains it holds ``t`` or more, however
long it is. ``t`` grows with the size class: the larger the items, the surer the estimate of the containment that is asked
for, and no item is lost. A document whose hits in a class are fewer than its ``t`` is done with that class. The pairs
that are left are compared by all hashes, and what passes as text.

Items are searched in blocks of about ``BLOCK`` shingles, each sent to all tasks for one pass over the documents, whose result
is written before the next one is made; more items mean more passes, never a larger block or more in the driver.

Defined results: NULL, empty and shorter texts have no shingle, so they contain nothing, and items of fewer
than five words are contained nowhere. Repeated item ids, and items without one, count as one item with all their shingles. Every
text is judged by itself: texts of one document id are told apart by a hash and each reported, equal rows once. Very long
texts are read whole, alone. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import PLAIN, Words, run_hash, slices, texts_of, windows
from postmill.sources.staging import stage

WORDS = 5
CONTAINED = 0.8
#: Shingles in one block of items, about 12 bytes each in every task.
BLOCK = 1 << 20
#: Hits in sketches, times their items, that a task looks at together; those of one text are at most a block.
WIDE = 1 << 18


def _shingle_hashes(words: Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, owner = windows(words, k)
    return run_hash(words.hashes(), first, first + k), first, owner


def _shingle(words: Words, raw: bytes, first: int, k: int = WORDS) -> str:
    return b" ".join(raw[words.start[i]:words.end[i]] for i in range(first, first + k)).decode()


def item_shingles(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, hash, shingle)``: the distinct shingles of each item."""
    schema = f"item {items.schema[item].dataType.simpleString()}, hash long, shingle string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = texts_of(batch, PLAIN)
            h, first, owner = _shingle_hashes(words)
            raw = words.data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array([_shingle(words, raw, i) for i in first], pa.string())],
                names=["item", "hash", "shingle"])

    return items.select(F.col(item), F.col(text).alias("text")).mapInArrow(run, schema).distinct()


@dataclass(frozen=True)
class SizeClass:
    """Sketches of the items of one size: the items of each hash are ``items[start[i]:start[i + 1]]``."""

    least: int
    hashes: np.ndarray
    start: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Block:
    """Items of one block: their ids, hashes ``hashes[start[i]:start[i + 1]]``, how many must be shared, and their sketches."""

    ids: pa.Array
    hashes: np.ndarray
    start: np.ndarray
    needed: np.ndarray
    classes: list[SizeClass]


def _block(items: pa.ChunkedArray, hashes: np.ndarray, share: float) -> Block:
    coded = items.combine_chunks().dictionary_encode(null_encoding="encode")
    owner = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    n = np.bincount(owner)
    start = np.concatenate([[0], np.cumsum(n)])
    needed = np.ceil(share * n - 1e-9).astype(np.int64)
    size = np.log2(n).astype(np.int64)
    classes = []
    for c in np.unique(size).tolist():
        least = max(1, min(c + 1, math.ceil(share * 2**c - 1e-9)))
        rank = np.arange(len(owner)) - start[owner]
        picked = (size[owner] == c) & (rank < (n - needed + least)[owner])
        by_hash = np.lexsort((owner[picked], hashes[picked]))
        kinds, first = np.unique(hashes[picked][by_hash], return_index=True)
        classes.append(SizeClass(least, kinds, np.append(first, len(by_hash)), owner[picked][by_hash]))
    return Block(coded.dictionary, hashes, start, needed, classes)


def _candidates(sizes: SizeClass, h: np.ndarray, owner: np.ndarray, n_items: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts and items of which a text holds enough of the sketch. Made for a few texts at a time, so at most a block is held."""
    place = np.searchsorted(sizes.hashes, h)
    place[place == len(sizes.hashes)] = 0
    hit = np.flatnonzero(sizes.hashes[place] == h)
    kinds = len(sizes.hashes)
    met = np.unique(owner[hit] * kinds + place[hit])
    text, place = met // kinds, met % kinds
    first = np.flatnonzero(np.append(True, np.diff(text) != 0)) if len(text) else np.zeros(0, np.int64)
    bounds = np.append(first, len(text))
    width = np.concatenate([[0], np.cumsum(sizes.start[place + 1] - sizes.start[place])])
    enough = np.flatnonzero(np.diff(bounds) >= sizes.least)
    some: list[int] = []
    held = 0
    for i in [*enough.tolist(), -1]:
        more = int(width[bounds[i + 1]] - width[bounds[i]]) if i >= 0 else 0
        if some and (i < 0 or held + more > WIDE):
            at = np.concatenate([np.arange(bounds[j], bounds[j + 1]) for j in some])
            n = sizes.start[place[at] + 1] - sizes.start[place[at]]
            skipped = np.cumsum(n) - n
            each = np.repeat(np.arange(len(at)), n)
            item = sizes.items[np.arange(len(each)) - skipped[each] + sizes.start[place[at]][each]]
            pair, hits = np.unique(text[at][each] * n_items + item, return_counts=True)
            pair = pair[hits >= sizes.least]
            yield pair // n_items, pair % n_items
            some, held = [], 0
        some.append(i)
        held += more


def _search(block: Block, key: str):
    n_items = len(block.needed)

    def shared(text: int, items: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        have = np.unique(h)
        for item in items.tolist():
            own = block.hashes[block.start[item]:block.start[item + 1]]
            place = np.searchsorted(have, own)
            place[place == len(have)] = 0
            own = own[have[place] == own]
            if len(own) >= block.needed[item]:
                yield item, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = texts_of(batch, PLAIN)
            h, first, owner = _shingle_hashes(words)
            if not len(h):
                continue
            bounds = np.searchsorted(owner, np.arange(words.texts + 1))
            raw = None
            for sizes in block.classes:
                for texts, items in _candidates(sizes, h, owner, n_items):
                    rows, of, shingles = [], [], []
                    for text in np.unique(texts).tolist():
                        low, high = int(bounds[text]), int(bounds[text + 1])
                        for item, own in shared(text, items[texts == text], h[low:high]):
                            raw = words.data.tobytes() if raw is None else raw
                            seen = {_shingle(words, raw, int(first[low + p])) for p in np.flatnonzero(np.isin(h[low:high], own)).tolist()}
                            rows.extend([text] * len(seen))
                            of.extend([item] * len(seen))
                            shingles.extend(sorted(seen))
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(2).take(at), block.ids.take(pa.array(of, pa.int64())), pa.array(shingles, pa.string())],
                        names=[key, "_content", "item", "shingle"])
    return run


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
              share: float = CONTAINED, block: int = BLOCK) -> DataFrame:
    """``(key, item, n_shared, n_shingles, containment)`` for every document that contains an item."""
    spark = docs.sparkSession
    shingles = stage(item_shingles(items, item), "item-shingles")
    sizes = shingles.groupBy("item").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n"), F.max("n")).first()
    kind = docs.schema[key].dataType
    if not total[0]:
        return spark.createDataFrame([], f"{key} {kind.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, "
                                         "n_shared long, n_shingles long, containment double")
    blocks = max(1, -(-2 * total[0] // block))
    numbered = shingles.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    source = docs.select(F.col(key), F.col(text).alias("text"), F.xxhash64(text).alias("_content"))
    item_kind = items.schema[item].dataType.simpleString()
    matches = None
    for b in range(blocks):
        rows = numbered.filter(F.col("block") == b).select("item", "hash").toArrow()
        if not rows.num_rows:
            continue
        run = _search(_block(rows["item"], rows["hash"].to_numpy().view(np.uint64), share), key)
        found = stage(source.mapInArrow(run, f"{key} {kind.simpleString()}, _content long, item {item_kind}, shingle string"), "contained")
        matches = found if matches is None else matches.unionAll(found)
    of = shingles.select(F.col("item").alias("_item"), F.col("shingle").alias("_shingle"))
    verified = (
        matches.distinct().join(of, F.col("item").eqNullSafe(F.col("_item")) & (F.col("shingle") == F.col("_shingle")))
        .groupBy(key, "_content", "item").agg(F.count("*").alias("n_shared"))
        .join(sizes.select(F.col("item").alias("_item"), F.col("n").alias("n_shingles")), F.col("item").eqNullSafe(F.col("_item")))
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
        .filter(F.col("n_shared") >= F.ceil(F.col("n_shingles") * share - 1e-9))
    )
    return verified.select(key, F.col("item").alias(item), "n_shared", "n_shingles", "containment")

"""Ranked lexical search over buckets of impact vectors of similar length (LEMP).

A document is a sparse vector of impacts, one per query term it holds; an item is the vector of its terms' weights, and the
score is their inner product. Items are searched in blocks of at most ``BLOCK`` terms, one after the other, each against
all documents: a block's terms go to all tasks, which write the occurrences of these terms as an index. Counts over the
index give the weights and impacts. Impact vectors are range-sorted by length, longest first, and cut into buckets of
``BUCKET``. The longest vectors of all give every item a first threshold, its lowest score that still ranks.

In a task, a bucket is left out for an item if the product of both lengths stays below the threshold
(Cauchy-Schwarz). Inside, the item's heaviest terms (``FOCUS`` of its squared length) give an exact partial product and
the part of the document's length they use up; what is left of both lengths bounds the rest. Documents whose bound
reaches the threshold are scored in integers over all terms, and the threshold rises. Bounds are in doubles with
a margin; they only pass too much. Every task hands on the best of its own, from which the ranks follow.

Terms are compared as bytes, hashes only find them. Memory of a task: a block's terms, a batch of texts, one bucket.

Defined results: NULL, empty texts and texts without terms are no documents and match nothing; items without terms, or
with terms that no document holds, have no rows. Rows with one item id are one item with all their terms, those
without id too. Documents are rows: those with one id are ranked each, equal scores by id, NULL ids last. Very long texts are
read whole. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.words import PLAIN, run_hash, slices, texts_of
from postmill.sources.staging import stage

RANKS = 10
#: Terms of one block of items (about 50 bytes each in every task), vectors of one bucket, and vectors that set the first thresholds.
BLOCK, BUCKET, FIRST = 1 << 19, 4096, 4096
FOCUS = 0.95
#: Margin of the bounds, far above the rounding of a sum of doubles.
MARGIN = 1 + 1e-9


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, term)``: the distinct terms of each item, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = texts_of(batch, PLAIN)
            raw = words.data.tobytes()
            terms = [raw[s:e] for s, e in zip(words.start.tolist(), words.end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(words.owner())), pa.array(terms, pa.binary())], names=["item", "term"])

    schema = f"item {items.schema[item].dataType.simpleString()}, term binary"
    return items.select(F.col(item), F.col(text).alias("text")).mapInArrow(run, schema).distinct()


@dataclass(frozen=True)
class Vocabulary:
    """Terms of a block in the order of their hashes; ``data[at[i]:at[i + 1]]`` are the bytes of term i."""

    hashes: np.ndarray
    data: np.ndarray
    at: np.ndarray
    #: How many terms share one hash at most.
    alike: int

    @staticmethod
    def of(terms: list[bytes]) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary and the number of each given term (which differ from each other) in it."""
        data = np.frombuffer(b"".join(terms), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        hashes = run_hash(data, at[:-1], at[1:])
        order = np.argsort(hashes, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        sorted_ = [terms[i] for i in order.tolist()]
        alike = int(np.unique(hashes, return_counts=True)[1].max()) if len(hashes) else 0
        return Vocabulary(hashes[order], np.frombuffer(b"".join(sorted_), np.uint8),
                          np.concatenate([[0], np.cumsum([len(t) for t in sorted_])]).astype(np.int64), alike), number

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the term that each run of bytes is, -1 for none."""
        found = np.full(len(start), -1, np.int64)
        if not len(self.hashes) or not len(start):
            return found
        hashes = run_hash(data, start, end)
        left = np.searchsorted(self.hashes, hashes, "left")
        for step in range(self.alike):
            place = np.minimum(left + step, len(self.hashes) - 1)
            some = np.flatnonzero((found < 0) & (self.hashes[place] == hashes) & (end - start == self.at[place + 1] - self.at[place]))
            term = place[some]
            for begin in range(0, len(some), 1 << 18):  # bytes are compared in bounded portions
                s, t = some[begin:begin + (1 << 18)], term[begin:begin + (1 << 18)]
                size = end[s] - start[s]
                head = np.cumsum(size) - size
                inner = np.arange(size.sum()) - np.repeat(head, size)
                same = data[np.repeat(start[s], size) + inner] == self.data[np.repeat(self.at[t], size) + inner]
                equal = np.logical_and.reduceat(same, head)
                found[s[equal]] = t[equal]
        return found


def index(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, terms, tf)`` of every document with a term: all its terms ``n``, and those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary.hashes)
        for batch in slices(batches):
            words = texts_of(batch, PLAIN)
            term = vocabulary.find(words.data, words.start, words.end)
            some = np.flatnonzero(term >= 0)
            entry, tf = np.unique(words.owner()[some] * size + term[some], return_counts=True)
            owner, term = (entry // size, entry % size) if size else (entry, entry)
            bounds = np.searchsorted(owner, np.arange(words.texts + 1)).astype(np.int32)
            has = pa.array(np.flatnonzero(words.counts()))
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in (term.astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(has), pa.array(words.counts()).take(has), *(v.take(has) for v in lists)], names=["doc", "n", "terms", "tf"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, tf array<long>")


def _holders(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    found = rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def _vectors(rows: DataFrame, documents: int, words: int) -> DataFrame:
    """``(doc, length, terms, impacts)`` of the documents that hold a term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tf = batch.column(1).to_numpy(), batch.column(3).flatten().to_numpy()
            if not len(n):
                continue
            if int(n.max()) * documents * 90 < 2**63:
                m = 10 + 90 * n * documents // words
            else:
                m = np.array([10 + 90 * int(v) * documents // words for v in n], np.int64)
            size = np.diff(batch.column(3).offsets.to_numpy())
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))
            length = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2, np.cumsum(size) - size))
            bounds = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(length), batch.column(2), pa.ListArray.from_arrays(bounds, pa.array(impact))],
                names=["doc", "length", "terms", "impacts"])

    return rows.filter(F.size("terms") > 0).mapInArrow(run, "doc long, length double, terms array<int>, impacts array<long>")


@dataclass(frozen=True)
class Query:
    terms: np.ndarray
    weights: np.ndarray
    #: How many of the heaviest terms are the focus, the length of all, and the length of the rest.
    focus: int
    length: float
    rest: float

    @staticmethod
    def of(terms: np.ndarray, weights: np.ndarray) -> Query:
        order = np.argsort(-weights, kind="stable")
        terms, weights = terms[order], weights[order]
        squares = np.cumsum(weights.astype(np.float64) ** 2)
        total = float(squares[-1]) if len(squares) else 0.0
        focus = min(len(terms), int(np.searchsorted(squares, FOCUS * total)) + 1)
        rest = math.sqrt(float((weights[focus:].astype(np.float64) ** 2).sum()))
        return Query(terms, weights, focus, math.sqrt(total), rest)


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several ranges, and which range each belongs to."""
    size = end - begin
    owner = np.repeat(np.arange(len(begin)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner], owner


class Best:
    """The best documents of each item so far, and the score that a further one must reach."""

    def __init__(self, least: np.ndarray, ranks: int):
        self.least = least.copy()
        self.ranks = ranks
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        if item in self.held:
            score, doc, known = (np.concatenate(x) for x in zip(self.held[item], (score, doc, known), strict=True))
        order = np.lexsort((doc, ~known, -score))[:self.ranks]
        self.held[item] = score[order], doc[order], known[order]
        if len(order) == self.ranks:
            self.least[item] = max(self.least[item], score[order[-1]])


def _search_bucket(bucket: pa.Table, queries: list[Query], size: int, best: Best, weight: np.ndarray) -> None:
    length = bucket["length"].to_numpy()
    longest = float(length.max())
    open_ = [i for i, q in enumerate(queries) if q.length * longest * MARGIN >= best.least[i]]
    if not open_:
        return
    docs = bucket["doc"].combine_chunks()
    known = docs.is_valid().to_numpy(zero_copy_only=False)
    doc = docs.fill_null(0).to_numpy()
    terms, impacts = (bucket[c].combine_chunks() for c in ("terms", "impacts"))
    at = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
    term, impact = terms.flatten().to_numpy(), impacts.flatten().to_numpy()
    owner = np.repeat(np.arange(len(length)), np.diff(at))
    order = np.argsort(term, kind="stable")
    holder, value = owner[order], impact[order].astype(np.float64)
    posting = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
    square = length**2
    for i in open_:
        q = queries[i]
        heavy = q.terms[:q.focus]
        place, which = _ranges(posting[heavy], posting[heavy + 1])
        part = np.bincount(holder[place], q.weights[which] * value[place], len(length))
        used = np.bincount(holder[place], value[place] ** 2, len(length))
        # Rounding of the two sums of squares counts against pruning.
        bound = part + q.rest * np.sqrt(np.maximum(square * MARGIN - used, 0))
        some = np.flatnonzero(bound * MARGIN >= best.least[i])
        if not len(some):
            continue
        weight[q.terms] = q.weights
        place, which = _ranges(at[some], at[some + 1])
        cumulated = np.concatenate([[0], np.cumsum(weight[term[place]] * impact[place])])
        ends = np.cumsum(at[some + 1] - at[some])
        score = cumulated[ends] - cumulated[np.concatenate([[0], ends[:-1]])]
        weight[q.terms] = 0
        good = score >= best.least[i]
        if good.any():
            best.add(i, score[good], doc[some[good]], known[some[good]])


def _searched(vectors: DataFrame, queries: list[Query], size: int, least: np.ndarray, ranks: int, bucket: int) -> DataFrame:
    """``(item, score, doc)``: of every task the best documents of each item, among those with the least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, weight = Best(least, ranks), np.zeros(size, np.int64)
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            while rows >= bucket:
                whole = pa.Table.from_batches(held)
                _search_bucket(whole.slice(0, bucket), queries, size, best, weight)
                held, rows = whole.slice(bucket).to_batches(), rows - bucket
        if rows:
            _search_bucket(pa.Table.from_batches(held), queries, size, best, weight)
        for item, (score, doc, known) in best.held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), item, np.int32)), pa.array(score), pa.array(doc, mask=~known)], names=["item", "score", "doc"])

    return vectors.select("doc", "length", "terms", "impacts").mapInArrow(run, "item int, score long, doc long")


def _longest(vectors: DataFrame, first: int) -> DataFrame:
    """About ``first`` of the longest vectors, longest first, in one part; of the shortest of them, where many are alike, some."""
    step = F.floor(F.log2("length") * 32)
    held, share, low = 0, 1.0, -math.inf
    for r in sorted(vectors.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):  # 32 per power of two
        low, share = r["step"], min(1.0, (first - held) / r["n"])
        held += r["n"]
        if held >= first:
            break
    chance = F.shiftrightunsigned(F.xxhash64("doc", F.monotonically_increasing_id()), 11) / F.lit(float(1 << 53))
    some = vectors.filter((step > low) | ((step == low) & (chance < share)))
    return some.coalesce(1).sortWithinPartitions(F.desc("length"))


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", ranks: int = RANKS,
         block: int = BLOCK, bucket: int = BUCKET, first: int = FIRST) -> DataFrame:
    """``(item, rank, key, score)``: the ``ranks`` best documents of each item."""
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    schema = f"{item} {kind.simpleString()}, rank int, {key} long, score long"
    terms = stage(item_terms(items, item, text), "item-terms")
    total = terms.count()
    blocks = -(-2 * total // block)
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))))
    found, counts = None, None
    for b in range(blocks):
        own = dealt.filter(F.col("block") == b).select("item", "term").toArrow()
        if not own.num_rows:
            continue
        names = own["item"].combine_chunks().dictionary_encode(null_encoding="encode")
        owner, ids = names.indices.to_numpy(), names.dictionary
        spelled = own["term"].combine_chunks().dictionary_encode()
        vocabulary, number = Vocabulary.of(spelled.dictionary.to_pylist())
        term, size = number[spelled.indices.to_numpy()], len(number)
        rows = stage(index(docs, vocabulary, key, text), "impact-index")
        if counts is None:
            counts = rows.agg(F.count("*"), F.sum("n")).first()
        if not counts[0]:
            break
        df = _holders(rows, size)
        weight = np.array([math.floor(1000 * math.log((2 * counts[0] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        weight[df == 0] = 0  # no document holds it
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(ids) + 1))
        queries = [Query.of(term[order[a:z]], weight[term[order[a:z]]]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        vectors = stage(_vectors(rows, counts[0], counts[1]), "impact-vectors")
        least = np.ones(len(queries), np.int64)
        seen: dict[int, list[int]] = {}
        for r in _searched(_longest(vectors, first), queries, size, least, ranks, bucket).select("item", "score").collect():  # items x ranks rows
            seen.setdefault(r["item"], []).append(r["score"])
        for i, scores in seen.items():
            if len(scores) >= ranks:
                least[i] = max(1, sorted(scores)[-ranks])
        # Equal lengths are told apart by content and id, so that a group of copies spreads.
        salt = F.xxhash64("doc", F.monotonically_increasing_id())
        ordered = vectors.withColumn("salt", salt).repartitionByRange(F.desc("length"), "salt").sortWithinPartitions(F.desc("length"))
        best = _searched(ordered, queries, size, least, ranks, bucket)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= ranks)
        named = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(ids), dtype=np.int32)), "name": ids}))
        done = stage(ranked.join(named, "item").select(
            F.col("name").cast(kind).alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score"), "ranked")
        found = done if found is None else found.unionAll(done)
    return spark.createDataFrame([], schema) if found is None else found

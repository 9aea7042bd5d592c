"""Katz back-off word model: Good-Turing discounted unigrams and bigrams with exactly normalised back-off weights.

``P(w | h)`` is the discounted bigram estimate where ``h w`` was seen (``LEAST`` times: once is enough), else ``alpha(h) P(w)``;
``P(w)`` is the discounted unigram estimate, and all unseen words together are one further type that gets the mass
the discounts leave. ``alpha(h) = (1 - sum P*(w | h)) / (1 - sum P(w))`` over the kept successors of ``h``, so the
model sums to one after every history. The start of a text is a history of its own; its end is a token.

Words are 63-bit hashes; the ``FREQUENT`` commonest are known to all tasks, with their values, and written by rank. Bigrams are
a table of one row per part, in packed form: histories, how many successors each has, successors and counts. A history
and its successors are in one part, but a frequent history has as many parts as its count demands, so a part never
holds more than about ``PART`` tokens. Counting ships each task's distinct bigrams to their part once and makes that table;
sums per history and the probabilities of rare successors are made from it in passes without another copy of it.

Scoring ships each task's distinct bigrams with the texts they stand in to the same parts, where the recursion is evaluated for
every token: the bigram's estimate, or back-off weight times the word's own probability. What does not depend on the bigram,
``log alpha(h) + log P(w)``, is added where it is known (frequent words in the task, rare ones in their part), and where the
bigram is kept the part adds the rest of its estimate. Sums come back per batch of texts, packed.

Defined results: NULL counts as empty, which is the end token alone. Without training texts every token is unseen
and has probability 1. Repeated rows are scored each, also those with one id or none. Very long texts are read whole and
alone. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import key_chunks
from postmill.llm.words import mix, slices, texts_of
from postmill.sources.staging import stage, unstage

LEAST = 1
DISCOUNTED = 5
FREQUENT = 1 << 18
#: Tokens that a task gathers before it ships them, and tokens of one part.
GATHER = 1_000_000
PART = 2_000_000
TOP = np.uint64(1 << 63)
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_SECOND = np.uint64(0x9E3779B97F4A7C15)
#: Codes below are ranks of frequent words; the packed form writes them with three bytes.
_RANKS = 0xFFFFFF
_CODEC = "zstd"


# -- packed columns ------------------------------------------------------------

def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, _CODEC, asbytes=True) if raw else b"")


def _stretch(raw: bytes) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], size, _CODEC, asbytes=True) if size else b""


def pack_numbers(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Byte planes, least significant first, compressed: what is small takes no room."""
    x = np.ascontiguousarray(x.astype(kind))
    return _squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack_numbers(raw: bytes, kind: str = "<u8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_stretch(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_codes(x: np.ndarray) -> bytes:
    """Ranks with three bytes, hashes with eight more."""
    rank = x < _RANKS
    short = np.where(rank, x, _RANKS).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    raw = len(x).to_bytes(8, "little") + np.ascontiguousarray(short.T).tobytes() + x[~rank].astype("<u8").tobytes()
    return _squeeze(raw)


def unpack_codes(raw: bytes) -> np.ndarray:
    raw = _stretch(raw)
    n = int.from_bytes(raw[:8], "little")
    short = np.zeros((n, 4), np.uint8)
    short[:, :3] = np.frombuffer(raw, np.uint8, 3 * n, 8).reshape(3, n).T
    out = short.view("<u4").ravel().astype(np.uint64)
    out[out == _RANKS] = np.frombuffer(raw, "<u8", -1, 8 + 3 * n)
    return out


# -- tokens --------------------------------------------------------------------

def pair_order(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Numbers by which bigrams are sorted everywhere: those of one history stand together. Different ones may be equal."""
    return (mix(h) & np.uint64(0xFFFFFFFF00000000)) | (mix(w) >> np.uint64(32))


def sorted_pairs(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of bigrams with equal ones side by side, where each different one begins in it, and the sorted numbers."""
    number = pair_order(h, w)
    order = np.argsort(number)
    number, h, w = number[order], h[order], w[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    mixed = np.flatnonzero(new[1:] & (number[1:] == number[:-1]))
    if len(mixed):  # different bigrams with one number: sorted by what they are
        some = np.flatnonzero(np.isin(number, number[mixed]))
        order[some] = order[some][np.lexsort((w[some], h[some], number[some]))]
        h[some], w[some] = h[some][turn := np.lexsort((w[some], h[some], number[some]))], w[some][turn]
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return order, np.flatnonzero(new), number


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by part, and where each part begins in it (and the end)."""
    part = part.astype(np.uint16) if parts <= 1 << 16 else part
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the first of each text, and text numbers; each text ends with its end token."""
    words = texts_of(batch)
    n = words.counts() + 1
    last = np.cumsum(n) - 1
    token = np.empty(int(n.sum()), np.uint64)
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner], token[last] = words.hashes() | TOP, END
    return token, last - n + 1, np.repeat(np.arange(words.texts, dtype=np.uint32), n)


@dataclass(frozen=True)
class Ranks:
    """Frequent words by rank, and how many parts each has as a history; the start of a text has the last rank."""

    #: Open table: a word's slot follows from its top bits, or is one of the next.
    slots: np.ndarray
    ranks: np.ndarray
    spread: np.ndarray
    parts: int

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, texts: int, parts: int, part: int) -> Ranks:
        bits = max(4, int(2 * len(hashes) + 1).bit_length())
        slots, ranks = np.zeros((1 << bits) + 64, np.uint64), np.zeros((1 << bits) + 64, np.uint64)
        at, left = Ranks._slot(hashes, bits), np.arange(len(hashes))
        while len(left):
            _, first = np.unique(at, return_index=True)
            free = first[slots[at[first]] == 0]
            slots[at[free]], ranks[at[free]] = hashes[left[free]], left[free].astype(np.uint64)
            keep = np.ones(len(left), bool)
            keep[free] = False
            left, at = left[keep], at[keep] + 1
            if len(at) and at.max() >= len(slots):
                slots, ranks = np.append(slots, np.zeros(64, np.uint64)), np.append(ranks, np.zeros(64, np.uint64))
        return Ranks(slots, ranks, 1 + 2 * np.append(counts, texts) // part, parts)

    @staticmethod
    def _slot(x: np.ndarray, bits: int) -> np.ndarray:
        return ((x << np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Ranks of frequent words, other words as they are."""
        out, bits = x.copy(), (len(self.slots) - 64).bit_length() - 1
        left, at = np.arange(len(x)), Ranks._slot(x, bits)
        while len(left):
            held = self.slots[at]
            hit = held == x[left]
            out[left[hit]] = self.ranks[at[hit]]
            more = ~hit & (held != 0)
            left, at = left[more], at[more] + 1
        return out

    def bigrams(self, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of histories and tokens."""
        w = self.codes(token)
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[first] = len(self.spread) - 1
        return h, w

    def part(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Part of bigrams; a word of its own (as a rare history) is where its successors are."""
        often = h < _RANKS
        within = np.zeros(len(h), np.uint64)
        within[often] = mix(w[often]) % self.spread[h[often].astype(np.int64)].astype(np.uint64)
        return (mix((h + within * TOP.dtype.type(0xD1B54A32D192ED03)) ^ _SECOND) >> np.uint64(32)).astype(np.int64) % self.parts


def _distinct(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, first, _ = sorted_pairs(h, w)
    at = order[first]
    return h[at], w[at], np.add.reduceat(c[order], first) if len(first) else c[:0]


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each run of equal histories, and lengths."""
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(h)))


def _by_part(rows: pa.Table) -> Iterator[pa.Table]:
    part = rows["part"].to_numpy()
    heads = np.flatnonzero(np.append(True, np.diff(part) != 0))
    for begin, end in zip(heads, np.append(heads[1:], len(part)), strict=True):
        yield rows.slice(begin, end - begin)


# -- counts --------------------------------------------------------------------

def word_counts(texts: DataFrame, parts: int) -> DataFrame:
    """``(w, c)`` of all tokens of a column ``text``."""

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)

    def ship(key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (mix(key ^ _SECOND) >> np.uint64(32)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            some = order[bounds[p]:bounds[p + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p)], pa.int32()), *(pa.array([pack_numbers(x[some])], pa.binary()) for x in (key, count))], names=["part", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in slices(batches):
            key, n = np.unique(_tokens(batch)[0], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > GATHER:
                key, n = merged(keys, counts)
                keys, counts, held = [key], [n], len(key)
                if held > GATHER // 2:
                    yield from ship(key, n)
                    keys, counts, held = [], [], 0
        if keys:
            yield from ship(*merged(keys, counts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_chunks(batches, ["part"], 1):
            for one in _by_part(rows):
                key, n = merged(*([unpack_numbers(k) for k in one[c].to_pylist()] for c in ("keys", "counts")))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["w", "c"])

    shipped = texts.mapInArrow(count, "part int, keys binary, counts binary")
    return shipped.repartition("part").sortWithinPartitions("part").mapInArrow(add, "w long, c long")


def bigram_counts(texts: DataFrame, ranks: Ranks, least: int = LEAST) -> DataFrame:
    """One row per part: kept bigrams ``n`` packed as ``heads, runs, w, c``, and how many were ``seen`` 1, 2, ... times."""

    def flush(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, w = (np.concatenate(x) for x in zip(*pairs, strict=True))
        pairs.clear()
        order, first, _ = sorted_pairs(h, w)
        h, w, c = h[order[first]], w[order[first]], np.diff(np.append(first, len(order)))
        order, bounds = by_part(ranks.part(h, w), ranks.parts)
        h, w, c = h[order], w[order], c[order]
        for p in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[p], bounds[p + 1]
            head, runs = _runs(h[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p)], pa.int32()), *[pa.array([x], pa.binary()) for x in (
                    pack_codes(h[a:b][head]), pack_numbers(runs), pack_codes(w[a:b]), pack_numbers(c[a:b]))]],
                names=["part", "heads", "runs", "w", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held = [], 0
        for batch in slices(batches):
            token, first, _ = _tokens(batch)
            pairs.append(ranks.bigrams(token, first))
            held += len(token)
            if held > GATHER:
                yield from flush(pairs)
                held = 0
        if pairs:
            yield from flush(pairs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_chunks(batches, ["part"], 1):
            for one in _by_part(rows):
                heads, w = (np.concatenate([unpack_codes(x) for x in one[k].to_pylist()]) for k in ("heads", "w"))
                runs, c = (np.concatenate([unpack_numbers(x) for x in one[k].to_pylist()]) for k in ("runs", "c"))
                h, w, c = _distinct(np.repeat(heads, runs.astype(np.int64)), w, c.astype(np.int64))
                seen = np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:DISCOUNTED + 2]
                kept = c >= least
                h, w, c = h[kept], w[kept], c[kept]
                head, runs = _runs(h)
                yield pa.RecordBatch.from_arrays(
                    [one["part"][:1].combine_chunks(), pa.array([len(h)]), pa.array([seen.tolist()], pa.list_(pa.int64())),
                     *[pa.array([x], pa.binary()) for x in (pack_codes(h[head]), pack_numbers(runs), pack_codes(w), pack_numbers(c))]],
                    names=["part", "n", "seen", "heads", "runs", "w", "c"])

    shipped = texts.mapInArrow(count, "part int, heads binary, runs binary, w binary, c binary")
    return shipped.repartition("part").sortWithinPartitions("part").mapInArrow(
        add, "part int, n long, seen array<long>, heads binary, runs binary, w binary, c binary")


def discounts(seen: dict[int, int], least: int) -> list[float]:
    """Good-Turing discount of each count from 0 to ``DISCOUNTED``; counts below ``least`` keep nothing, larger ones all.

    Where counts of counts are too few for the formula, half a count is taken off.
    """
    n = lambda r: seen.get(r, 0)
    common = (DISCOUNTED + 1) * n(DISCOUNTED + 1) / n(1) if n(1) else 1.0
    out = [0.0]
    for r in range(1, DISCOUNTED + 1):
        d = (r - 0.5) / r
        if n(r) and n(r + 1) and common < 1:
            turing = ((r + 1) * n(r + 1) / n(r) / r - common) / (1 - common)
            d = turing if 0 < turing < 1 else d
        out.append(d if r >= least else 0.0)
    return out


@dataclass(frozen=True)
class KatzModel:
    """``words (w, c, log_p, log_a, log_total)`` of the rare words, ``bigrams`` packed by part and ``successors (part, w, log_p)``, the
    rare words that follow others there, are tables in the shared folder; arrays hold the same for ranked words."""

    words: DataFrame
    bigrams: DataFrame
    successors: DataFrame
    ranks: Ranks
    counts: np.ndarray
    log_p: np.ndarray
    log_a: np.ndarray
    log_total: np.ndarray
    tokens: int
    distinct: int
    log_unseen: float
    #: Logarithm of the discounted count, by count up to ``DISCOUNTED``.
    log_mass: np.ndarray


def _discounted(c: Column, d: list[float]) -> Column:
    out = c.cast("double")
    for r in range(1, len(d)):
        out = F.when(c == r, d[r] * r).otherwise(out)
    return out


def _mass(c: np.ndarray, d: list[float]) -> np.ndarray:
    low = np.array([r * f for r, f in enumerate(d)])
    return np.where(c < len(low), low[np.minimum(c, len(low) - 1)], c)


def _ranked(frame: DataFrame, ranks: int, column: str, empty: float) -> np.ndarray:
    out = np.full(ranks, empty)
    got = frame.select("h", column).toArrow()  # ranked words only
    out[got["h"].to_numpy()] = got[column].to_numpy()
    return out


def fit(texts: DataFrame, text: str = "text", least: int = LEAST, part: int = PART, frequent: int = FREQUENT) -> KatzModel:
    spark = texts.sparkSession
    texts = texts.select(F.col(text).alias("text"))
    size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    words = stage(word_counts(texts, 1 + (size[1] or 0) // (16 * part)), "words")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = int(totals[0]), int(totals[1])
    seen = {r["c"]: r["n"] for r in words.filter(F.col("c") <= DISCOUNTED + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    d1 = discounts(seen, 1)
    left = sum(n * r * (1 - d1[r]) for r, n in seen.items() if r <= DISCOUNTED)
    total = tokens if left > 0 else tokens + 1
    unseen = (left if left > 0 else 1.0) / total
    p1 = lambda c: _discounted(c, d1) / F.lit(float(total))

    # The commonest words: as many classes of alike counts, from the top, as stay within the bound.
    step = F.floor(F.log2("c") * 16)
    held, cut = 0, -1
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):  # 16 per power of two
        held += r["n"]
        if held > min(frequent, _RANKS - 2):
            cut = r["step"]
            break
    rare = words.filter(step <= cut)
    top = words.filter(step > cut).toArrow()
    order = np.lexsort((top["w"].to_numpy(), -top["c"].to_numpy()))
    hashes, counts = top["w"].to_numpy().view(np.uint64)[order], top["c"].to_numpy()[order]
    ranks = Ranks.of(hashes, counts, int(size[0]), 1 + tokens // part, part)
    n_ranks, begin = len(hashes) + 1, len(hashes)
    top_p = np.append(_mass(counts, d1) / total, 0.0)

    bigrams = stage(bigram_counts(texts, ranks, least), "bigrams")
    seen = {r["r"]: r["n"] for r in bigrams.select(F.posexplode("seen").alias("r", "n")).groupBy((F.col("r") + 1).alias("r")).agg(F.sum("n").alias("n")).collect()}
    d2 = discounts(seen, least)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                heads, runs, w, c = (f(batch.column(k)[i].as_py()) for k, f in enumerate((unpack_codes, unpack_numbers, unpack_codes, unpack_numbers)))
                first = np.cumsum(runs.astype(np.int64)) - runs.astype(np.int64)
                known = w < _RANKS
                low = np.where(known, top_p[np.where(known, w, 0).astype(np.int64)], 0.0)
                both = [np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (_mass(c.astype(np.int64), d2), low)]
                yield pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), *map(pa.array, both)], names=["h", "mass", "low"])

    def followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                heads, runs, w = (f(batch.column(k)[i].as_py()) for k, f in enumerate((unpack_codes, unpack_numbers, unpack_codes)))
                some = w >= _RANKS
                h = np.repeat(heads, runs.astype(np.int64))[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), batch.column(3)[i].as_py(), np.int32)), pa.array(h.view(np.int64)), pa.array(w[some].view(np.int64))],
                    names=["part", "h", "w"])

    follow = stage(bigrams.select("heads", "runs", "w", "part").mapInArrow(followers, "part int, h long, w long").join(
        rare.select("w", p1(F.col("c")).alias("p1")), "w"), "rare-successors")
    partial = bigrams.select("heads", "runs", "w", "c").mapInArrow(sums, "h long, mass double, low double")
    per_history = stage(partial.unionAll(follow.select("h", F.lit(0.0).alias("mass"), F.col("p1").alias("low"))).groupBy("h").agg(
        F.sum("mass").alias("mass"), F.sum("low").alias("low")), "histories")

    def weights(n: Column) -> list[Column]:
        # A history that leaves no mass gets one more count, so that what was not seen after it has some.
        full = F.when(F.col("mass") < n - 1e-6, n).otherwise(n + 1).cast("double")
        return [F.log10((1 - F.col("mass") / full) / (1 - F.col("low"))).alias("log_a"), F.log10(full).alias("log_total")]

    ranked = per_history.filter((F.col("h") >= 0) & (F.col("h") < n_ranks))
    often = spark.createDataFrame(pa.table({"h": pa.array(np.arange(n_ranks)), "n": pa.array(np.append(counts, int(size[0])))}))
    weighed = stage(ranked.join(often, "h").select("h", *weights(F.col("n"))), "ranked-histories")
    log_a, log_total = (_ranked(weighed, n_ranks, c, 0.0) for c in ("log_a", "log_total"))
    valued = stage(rare.join(per_history.withColumnRenamed("h", "w"), "w", "left").select(
        "w", "c", F.log10(p1(F.col("c"))).alias("log_p"), *[F.coalesce(x, F.lit(0.0)).alias(n) for x, n in zip(weights(F.col("c")), ("log_a", "log_total"), strict=True)]), "rare-words")
    successors = stage(follow.select("part", "w", F.log10("p1").alias("log_p")).distinct(), "successors")
    for frame in (words, follow, per_history, weighed):
        unstage(frame)
    with np.errstate(divide="ignore"):
        log_p, log_mass = np.log10(top_p), np.log10(_mass(np.arange(DISCOUNTED + 1), d2))
    log_p[begin] = 0.0
    return KatzModel(valued, bigrams, successors, ranks, np.append(counts, 0), log_p, log_a, log_total, tokens, distinct, math.log10(unseen), log_mass)


# -- scores --------------------------------------------------------------------

_MESSAGE = ["part", "kind", "batch", "a", "b", "c", "d", "e"]
#: Kinds of messages: of the model first, then of the texts.
_BIGRAMS, _WORDS, _FOLLOWERS, _PAIRS, _RARE, _TEXTS = range(6)


def _message(part: int, kind: int, batch: int, *columns: bytes) -> list[pa.Array]:
    held = [*columns, *[b""] * (5 - len(columns))]
    return [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([batch], pa.int64()), *[pa.array([x], pa.binary()) for x in held]]


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values are, and which are there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    place = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return place, sorted_[place] == x


class _Part:
    """The model of one part: its bigrams with what each adds, and its rare words with their values."""

    def __init__(self, model: dict, bigrams: list, words: list, followers: list):
        columns = [np.concatenate(x) for x in zip(*words, strict=True)] if words else [np.zeros(0, np.uint64), *[np.zeros(0)] * 4]
        order = np.argsort(columns[0])
        self.words, self.base, log_p, log_a, log_total = (c[order] for c in columns)
        self.value = log_p + log_a
        known = [np.concatenate(x) for x in zip(*followers, strict=True)] if followers else [np.zeros(0, np.uint64), np.zeros(0)]
        order = np.argsort(known[0])
        rare, rare_p = known[0][order], known[1][order]
        found = [[np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0)]]
        for heads, runs, w, c in bigrams:
            often = heads < _RANKS
            place, _ = _find(self.words, heads)
            at = np.where(often, heads, 0).astype(np.int64)
            own = lambda ranked, other: np.where(often, ranked[at], other[place] if len(other) else 0.0)  # noqa: B023, E731
            history = own(model["log_total"], log_total) + own(model["log_a"], log_a)
            ranked = w < _RANKS
            place_w, _ = _find(rare, w)
            word = np.where(ranked, model["log_p"][np.where(ranked, w, 0).astype(np.int64)], rare_p[place_w] if len(rare) else 0.0)
            c = c.astype(np.int64)
            low = model["log_mass"]
            mass = np.where(c < len(low), low[np.minimum(c, len(low) - 1)], np.log10(np.maximum(c, 1)))
            runs = runs.astype(np.int64)
            found.append([np.repeat(heads, runs), w, mass - word - np.repeat(history, runs)])
        h, w, gains = found[-1] if len(found) == 2 else (np.concatenate(x) for x in zip(*found, strict=True))
        order, _, self.number = sorted_pairs(h, w)
        self.h, self.w, self.gains = h[order], w[order], gains[order]

    def gain(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What each bigram adds; nothing where it is not kept."""
        number = pair_order(h, w)
        place, out, left = np.searchsorted(self.number, number), np.zeros(len(h)), np.arange(len(h))
        while True:
            inside = place < len(self.number)
            left, place = left[inside], place[inside]
            same = self.number[place] == number[left]
            left, place = left[same], place[same]
            if not len(left):
                return out
            hit = (self.h[place] == h[left]) & (self.w[place] == w[left])
            out[left[hit]] = self.gains[place[hit]]
            left, place = left[~hit], place[~hit] + 1


def score(docs: DataFrame, model: KatzModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, n_known, base_score, score)`` for every document."""
    types = float(model.tokens + model.distinct + 1)
    ranks, parts = model.ranks, model.ranks.parts
    shared = {"log_p": model.log_p, "log_a": model.log_a, "log_total": model.log_total, "log_mass": model.log_mass}
    top_base, top_value = np.log10((model.counts + 1) / types), model.log_p + model.log_a
    log_begin, log_unseen, base_unseen = float(model.log_a[-1]), model.log_unseen, -math.log10(types)
    id_type = docs.select(key).schema[0].dataType
    message = "part int, kind int, batch long, a binary, b binary, c binary, d binary, e binary, ids array<" + id_type.simpleString() + ">"

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        arrow = None

        def blank() -> pa.Array:
            return pa.nulls(1, pa.list_(arrow))

        def pairs(h: np.ndarray, w: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
            order, first, _ = sorted_pairs(h, w)
            times = np.diff(np.append(first, len(order)))
            h, w, doc = h[order[first]], w[order[first]], doc[order]
            part = ranks.part(h, w)
            doc = doc[by_part(np.repeat(part, times), parts)[0]]
            order, bounds = by_part(part, parts)
            h, w, times = h[order], w[order], times[order]
            begin = np.concatenate([[0], np.cumsum(times)])
            for p in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[p], bounds[p + 1]
                head, runs = _runs(h[a:b])
                yield pa.RecordBatch.from_arrays([*_message(
                    int(p), _PAIRS, number, pack_codes(h[a:b][head]), pack_numbers(runs), pack_codes(w[a:b]),
                    pack_numbers(times[a:b]), pack_numbers(doc[begin[a]:begin[b]], "<u4")), blank()], names=[*_MESSAGE, "ids"])

        def rare(w: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
            part = ranks.part(w, w)
            order = np.lexsort((doc, w, part))
            w, doc, part = w[order], doc[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[p], bounds[p + 1]
                head, runs = _runs(w[a:b])
                yield pa.RecordBatch.from_arrays([*_message(
                    int(p), _RARE, number, pack_numbers(w[a:b][head]), pack_numbers(runs), pack_numbers(doc[a:b], "<u4")), blank()], names=[*_MESSAGE, "ids"])

        def flush() -> Iterator[pa.RecordBatch]:
            h, w, doc = (np.concatenate([x[i] for x in held]) for i in range(3))
            ids = pa.concat_arrays([x[3] for x in held])
            held.clear()
            texts = len(ids)
            ranked = w < _RANKS
            at, owner = w[ranked].astype(np.int64), doc[ranked]
            by = lambda x: np.bincount(owner, x, texts)
            yield pa.RecordBatch.from_arrays([*_message(
                number % parts, _TEXTS, number, np.bincount(doc, minlength=texts).astype("<i8").tobytes(), by(None).astype("<i8").tobytes(),
                by(top_base[at]).tobytes(), (by(top_value[at]) + log_begin).tobytes()),
                pa.ListArray.from_arrays(pa.array([0, texts], pa.int32()), ids)], names=[*_MESSAGE, "ids"])
            yield from rare(w[~ranked], doc[~ranked])
            yield from pairs(h, w, doc)

        texts = 0
        for batch in slices(batches):
            arrow = batch.column(0).type
            token, first, doc = _tokens(batch)
            held.append((*ranks.bigrams(token, first), doc + np.uint32(texts), batch.column(0)))
            texts += batch.num_rows
            size += len(token)
            if size > GATHER:
                yield from flush()
                number, held, size, texts = number + 1, [], 0, 0
        if held:
            yield from flush()

    def packed(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if kind == _WORDS:
                    w = batch.column(0).to_numpy().view(np.uint64)
                    part = ranks.part(w, w)
                    rest = [np.log10((batch.column(1).to_numpy() + 1) / types), *(batch.column(i).to_numpy() for i in (2, 3, 4))]
                else:
                    part, w = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                    rest = [batch.column(2).to_numpy()]
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(bounds)):
                    some = order[bounds[p]:bounds[p + 1]]
                    yield pa.RecordBatch.from_arrays([*_message(
                        int(p), kind, 0, w[some].tobytes(), *(x[some].tobytes() for x in rest)), pa.nulls(1, pa.list_(pa.null()))], names=[*_MESSAGE, "ids"])
        return run

    none = F.lit(None).cast(f"array<{id_type.simpleString()}>").alias("ids")
    plain = message[:message.index(", ids")]

    def packed_rows(frame: DataFrame, kind: int) -> DataFrame:
        run = packed(kind)
        return frame.mapInArrow(lambda batches: (b.select(_MESSAGE) for b in run(batches)), plain).select("*", none)

    sent = docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(prepare, message).unionAll(
        model.bigrams.select("part", F.lit(_BIGRAMS).alias("kind"), F.lit(0).cast("long").alias("batch"), "heads", "runs", "w", "c", F.lit(b"").alias("e"), none)).unionAll(
        packed_rows(model.words.select("w", "c", "log_p", "log_a", "log_total"), _WORDS)).unionAll(
        packed_rows(model.successors.select("part", "w", "log_p"), _FOLLOWERS))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table, gathered = None, None, {}
        for batch in batches:
            ids = batch.column(8)
            for i in range(batch.num_rows):
                part, kind, number = (batch.column(c)[i].as_py() for c in range(3))
                raw = [batch.column(c)[i].as_py() for c in range(3, 8)]
                if part != at:
                    at, table, gathered = part, None, {_BIGRAMS: [], _WORDS: [], _FOLLOWERS: []}
                if kind == _TEXTS:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), *(pa.array([x], pa.binary()) for x in raw[:4]), ids.slice(i, 1)], names=["batch", "tokens", "known", "base", "score", "ids"])
                    continue
                if kind == _BIGRAMS:
                    gathered[kind].append([f(x) for f, x in zip((unpack_codes, unpack_numbers, unpack_codes, unpack_numbers), raw[:4], strict=True)])
                    continue
                if kind in gathered:
                    gathered[kind].append([np.frombuffer(raw[0], np.uint64), *(np.frombuffer(x) for x in raw[1:5 if kind == _WORDS else 2])])
                    continue
                if table is None:
                    table = _Part(shared, gathered[_BIGRAMS], gathered[_WORDS], gathered[_FOLLOWERS])
                    gathered = {}
                if kind == _PAIRS:
                    heads, w = unpack_codes(raw[0]), unpack_codes(raw[2])
                    times, doc = unpack_numbers(raw[3]).astype(np.int64), unpack_numbers(raw[4], "<u4").astype(np.int64)
                    gain = table.gain(np.repeat(heads, unpack_numbers(raw[1]).astype(np.int64)), w)
                    out = [b"", b"", b"", np.bincount(doc, np.repeat(gain, times)).tobytes()]
                else:
                    w, times, doc = unpack_numbers(raw[0]), unpack_numbers(raw[1]).astype(np.int64), unpack_numbers(raw[2], "<u4").astype(np.int64)
                    place, hit = _find(table.words, w)
                    pick = lambda x, other: np.where(hit, x[place], other) if len(x) else np.full(len(hit), other)  # noqa: B023, E731
                    add = lambda x: np.bincount(doc, np.repeat(x, times))  # noqa: B023, E731
                    out = [b"", add(hit.astype(float)).astype("<i8").tobytes(), add(pick(table.base, base_unseen)).tobytes(), add(pick(table.value, log_unseen)).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), *(pa.array([x], pa.binary()) for x in out), pa.nulls(1, ids.type)], names=["batch", "tokens", "known", "base", "score", "ids"])

    found = sent.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(
        look_up, f"batch long, tokens binary, known binary, base binary, score binary, ids array<{id_type.simpleString()}>")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_chunks(batches, ["batch"], 1):
            number = rows["batch"].to_numpy()
            heads = np.flatnonzero(np.append(True, np.diff(number) != 0))
            for begin, end in zip(heads, np.append(heads[1:], len(number)), strict=True):
                one = rows.slice(begin, end - begin)
                whole = one.filter(one["ids"].is_valid())
                ids = whole["ids"].combine_chunks().flatten()
                sums = []
                for name, kind in (("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")):
                    total = np.zeros(len(ids), kind)
                    for raw in one[name].to_pylist():
                        part = np.frombuffer(raw, kind)
                        total[:len(part)] += part
                    sums.append(pa.array(total))
                yield pa.RecordBatch.from_arrays([ids, *sums], names=[key, "n_tokens", "n_known", "base_score", "score"])

    return found.repartition("batch").sortWithinPartitions("batch").mapInArrow(
        add_up, f"{key} {id_type.simpleString()}, n_tokens long, n_known long, base_score double, score double")

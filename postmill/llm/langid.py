"""Languages of documents as mixtures.

Byte-trigram counts per language are taken over all documents that have a label. A text is a mixture of
languages over its words: expectation-maximisation estimates the proportions, and the set of languages is
the one whose likelihood, less a penalty for each further language, is highest.

Defined results: a NULL text, or one without a letter, is ``und`` with score 0. Ties between languages go to
the first in sorted order (beyond ``BLOCK`` languages: to the one with more text). Any number of languages may be learned; each takes
128 KB in every worker. A mixture is made of languages of one block; of the blocks' mixtures the likeliest counts, less its
penalty. If no language can be learned, every text is ``und``. Very long texts are read whole, alone; repeated rows, also
those with one id and different texts, are judged each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.words import LOWER, SPACED, find_words, slices, text_bytes

BINS = 1 << 15
ROUNDS = 6
#: Languages that one text's mixture may be made of; more are tried in blocks, the best supported ones first.
BLOCK = 256
#: Bytes of text looked at together: each has a row of the model.
TEXTS = 1 << 19
UNKNOWN = "und"
_SPACE = np.uint8(32)


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bin at each letter byte, with the words these belong to: ``(bins, starts of words, owners, words)``.

    Digits and signs count as spaces, so that lists, tables and codes say nothing.
    """
    low = LOWER[data]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    words = find_words(np.where(letter, low, _SPACE), at, SPACED)
    clean = words.data
    prev = np.empty_like(clean)
    prev[1:], prev[:1] = clean[:-1], _SPACE
    following = np.empty_like(clean)
    following[:-1], following[-1:] = clean[1:], _SPACE
    prev[words.start] = _SPACE
    following[words.end - 1] = _SPACE
    inside = np.flatnonzero(clean != _SPACE)
    code = (prev[inside].astype(np.uint32) << np.uint32(16)) | (clean[inside].astype(np.uint32) << np.uint32(8)) | following[inside]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    heads = np.searchsorted(inside, words.start)
    return bins, heads, words.owner(), words.first


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    #: log probability of each trigram bin, ``bins x languages``.
    log_p: np.ndarray
    penalty: float = 1.0


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count trigrams per language over every labelled text. Counts go to the driver summed: bins x languages."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, size=TEXTS):
            bins, heads, _, first = _grams(*text_bytes(batch.column(0)))
            ends = np.append(heads, len(bins))
            bounds = ends[first]
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            for name in set(names.tolist()):
                total = sums.setdefault(name, np.zeros(BINS, np.int64))
                picked = np.zeros(len(bounds) - 1, bool)
                picked[names == name] = True
                total += np.bincount(bins[np.repeat(picked, np.diff(bounds))], minlength=BINS)
        for name, total in sums.items():
            bins = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(bins)), pa.array(bins), pa.array(total[bins])], names=["lang", "bin", "n"])

    counted = rows.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    found = packed.orderBy("lang").collect()  # a row per language
    if len(found) > BLOCK:
        found.sort(key=lambda r: (-sum(b["n"] for b in r["bins"]), r["lang"]))
    if not found:
        return LanguageModel((), np.zeros((BINS, 0), np.float32))
    counts = np.zeros((BINS, len(found)))
    for i, row in enumerate(found):
        counts[[b["bin"] for b in row["bins"]], i] = [b["n"] for b in row["bins"]]
    log_p = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BINS))
    return LanguageModel(tuple(r["lang"] for r in found), log_p.astype(np.float32))


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; an empty group has sum 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def _mixture(like: np.ndarray, owner: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood (less the words' own best) of each text over its allowed languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    n = np.maximum(np.diff(first), 1)[:, None]
    fit_ = np.zeros(len(share))
    for step in range(ROUNDS + 1):
        part = like * share[owner]
        total = part.sum(1)
        if step == ROUNDS:
            fit_ = _sum_by(np.log(np.maximum(total, 1e-30)), first)
            break
        part /= np.maximum(total, 1e-30)[:, None]
        share = _sum_by(part, first) / n
    return share, fit_


def proportions(data: np.ndarray, at: np.ndarray, model: LanguageModel, block: int = BLOCK) -> np.ndarray:
    """Share of each language in each text; all 0 where a text has no word of letters."""
    bins, heads, owner, first = _grams(data, at)
    texts, kinds = len(at) - 1, len(model.names)
    out = np.zeros((texts, kinds))
    if not len(heads) or not kinds:
        return out
    likeliest = np.full(texts, -np.inf)
    for begin in range(0, kinds, block):
        score = np.add.reduceat(model.log_p[bins, begin:begin + block], heads, axis=0).astype(np.float64)
        share, value = _best_mixture(score, owner, first, model.penalty)
        value = value + _sum_by(score.max(1), first)
        better = value > likeliest
        out[better] = 0
        out[better, begin:begin + block] = share[better]
        likeliest[better] = value[better]
    return out


def _best_mixture(score: np.ndarray, owner: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares and penalised log likelihood (less the words' own best) of each text's best set of languages."""
    texts, kinds = len(first) - 1, score.shape[1]
    like = np.exp(score - score.max(1, keepdims=True))
    full, _ = _mixture(like, owner, first, np.ones((texts, kinds)))
    n_words = np.diff(first)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.zeros((texts, kinds))
    best_fit = np.full(texts, -np.inf)
    open_ = n_words > 0
    allowed = np.zeros((texts, kinds))
    for size in range(1, kinds + 1):
        allowed[np.arange(texts), order[:, size - 1]] = 1
        # Texts whose set did not improve at the last size keep what they have.
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        keep = np.repeat(open_, n_words)
        lengths = np.concatenate([[0], np.cumsum(n_words[rows])])
        share, fit_ = _mixture(like[keep], np.repeat(np.arange(len(rows)), n_words[rows]), lengths, allowed[rows])
        value = fit_ - penalty * (size - 1) * np.log(n_words[rows] + 1.0)
        better = value > best_fit[rows]
        best[rows[better]], best_fit[rows[better]] = share[better], value[better]
        open_[rows[~better]] = False
    return best, best_fit


def mark(docs: DataFrame, model: LanguageModel, prefix: str = "", text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``langs`` (shares of all languages in the set), their names prefixed."""
    kind = pa.map_(pa.string(), pa.float64())
    names = [prefix + n for n in ("lang_pred", "score", "langs")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()),
                           T.StructField(names[2], T.MapType(T.StringType(), T.DoubleType()))])
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TEXTS):
            column = batch.column(at_text)
            data, at = text_bytes(column)
            share = proportions(data, at, model)
            ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
            has = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[at]) > 0
            wide = np.diff(np.concatenate([[0], np.cumsum(data >= 128)])[at]) > 0
            for i in np.flatnonzero(~has & wide).tolist():
                has[i] = any(c.isalpha() for c in column[i].as_py())
            known = has & (share.sum(1) > 0) if len(model.names) else np.zeros(len(has), bool)
            top = share.argmax(1) if len(model.names) else np.zeros(len(has), int)
            main = [model.names[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)]
            score = [float(min(1.0, share[i, t])) if k else 0.0 for i, (t, k) in enumerate(zip(top, known, strict=True))]
            langs = [[(n, float(v)) for n, v in zip(model.names, share[i], strict=True) if v > 0] if known[i] else [] for i in range(len(has))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(main, pa.string()), pa.array(score), pa.array(langs, kind)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, langs)``: main language, its share, and the shares of all languages in the set."""
    return mark(docs.select(F.col(key), F.col(text)), model, text=text).select(key, "lang_pred", "score", "langs")

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed over every whole text. Trees are grown on the driver from at most ``TRAIN_ROWS``
labelled rows (those with the smallest hash of their key); that bound is the only one. The fitted trees are
flat arrays: feature, threshold, left child and value of each node, and a batch of documents walks down all
of them with array lookups.

Defined results: NULL and empty texts have all statistics 0 and are scored like any other; repeated rows get
equal scores; without labels of both kinds every score is the mean label (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import find_words, mix, slices, text_bytes

TRAIN_ROWS = 30_000
SIGNS = b"!|*&%#$?.,:;-_@+=()[]{}<>\"'/\\~^"
FEATURES = [
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "lower", "digit", "wide", "space", "sign", "lines",
    "distinct_words", "top_word", "repeats", "short_words", "long_words", "upper_words", "lead_repeats", "sentence_ends",
    *[f"sign_{i}" for i in range(len(SIGNS))],
]


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at]).astype(np.float64)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    words = find_words(data, at)
    texts = words.texts
    n_bytes, n_words = np.diff(at).astype(np.float64), words.counts().astype(np.float64)
    per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)
    histogram = np.bincount(np.repeat(np.arange(texts), np.diff(at)) * 256 + data, minlength=texts * 256).reshape(texts, 256).astype(np.float64)
    length = (words.end - words.start).astype(np.float64)
    owner, h = words.owner(), words.hashes()
    by = lambda x: np.bincount(owner, weights=x, minlength=texts)
    mean = by(length) * per_word
    order = np.lexsort((h, owner))
    so, sh = owner[order], h[order]
    new = np.ones(len(so), bool)
    new[1:] = (so[1:] != so[:-1]) | (sh[1:] != sh[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(so)))
    distinct = np.bincount(so[heads], minlength=texts).astype(np.float64)
    top = np.zeros(texts)
    np.maximum.at(top, so[heads], runs)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    far = np.zeros(len(h), bool)
    if len(h) > 30:
        far[30:] = (h[30:] == h[:-30]) & (owner[30:] == owner[:-30])
    head = data[words.start] if len(h) else np.zeros(0, np.uint8)
    tail = data[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    second = data[np.minimum(words.start + 1, len(data) - 1)] if len(h) else head
    is_up = lambda x: (x >= 65) & (x <= 90)
    signs = [histogram[:, s] for s in SIGNS]
    columns = [
        np.log1p(n_bytes), np.log1p(n_words), mean, np.sqrt(np.maximum(by(length ** 2) * per_word - mean ** 2, 0)),
        histogram[:, 65:91].sum(1) * per_byte, histogram[:, 97:123].sum(1) * per_byte, histogram[:, 48:58].sum(1) * per_byte,
        histogram[:, 128:].sum(1) * per_byte, histogram[:, [9, 10, 11, 12, 13, 32]].sum(1) * per_byte, sum(signs) * per_byte,
        histogram[:, 10] * per_word, distinct * per_word, top * per_word, by(same) * per_word, by(length <= 2) * per_word,
        by(length >= 15) * per_word, by(is_up(head) & is_up(second)) * per_word, by(far) * per_word, by(tail == 46) * per_word,
        *[s * per_word for s in signs],
    ]
    return np.stack(columns, axis=1)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, features)`` with the statistics of every whole text."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = statistics(*text_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "features"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in one set of arrays; ``left`` 0 marks a leaf, the right child follows the left one."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                down = self.left[node]
                node = np.where(down > 0, down + (x[rows, self.feature[node]] > self.threshold[node]), node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
         least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Boost trees for the logistic loss; splits are found on histograms of ``bins`` quantile bins."""
    mean = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or mean in (0.0, 1.0):
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        one = np.zeros(1)
        return Forest(np.zeros(0, int), one.astype(int), one, one.astype(int), one, float(np.log(mean / (1 - mean))), 0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    n_features = x.shape[1]
    flat = code + np.arange(n_features) * bins
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), start)
    feature, threshold, left, value, roots = [], [], [], [], []

    def add() -> int:
        for column in (feature, threshold, left, value):
            column.append(0)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-9)
        root = add()
        roots.append(root)
        work = [(root, np.arange(len(y)), 0)]
        while work:
            node, rows, level = work.pop()
            g, h = slope[rows].sum(), curve[rows].sum()
            value[node] = rate * g / (h + ridge)
            if level < depth and len(rows) >= 2 * least:
                index = flat[rows].ravel()
                weight = lambda v: np.bincount(index, np.repeat(v, n_features), n_features * bins).reshape(n_features, bins).cumsum(1)  # noqa: B023, E731
                gl, hl, nl = weight(slope[rows]), weight(curve[rows]), weight(np.ones(len(rows)))
                gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    child = add()
                    add()
                    feature[node], threshold[node], left[node] = int(j), float(cuts[j][b]), child
                    right = code[rows, j] > b
                    work += [(child, rows[~right], level + 1), (child + 1, rows[right], level + 1)]
                    continue
            margin[rows] += value[node]
    return Forest(np.array(roots), np.array(feature), np.array(threshold, float), np.array(left), np.array(value, float), start, depth)


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Train on labelled documents; at most ``rows`` of them, chosen by a hash of the key."""
    joined = stats.join(labels.select(key, F.col(label).cast("double").alias("label")).filter("label IS NOT NULL"), key)
    sample = joined.orderBy(F.xxhash64(key), key).limit(rows).select("features", "label").toArrow()
    y = sample["label"].to_numpy()
    x = sample["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    return grow(x, y)


def score(stats: DataFrame, forest: Forest, key: str = "doc_id", cut: float = 0.7) -> DataFrame:
    """``(key, score, predicted)``."""
    schema = f"{key} {stats.schema[key].dataType.simpleString()}, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            s = forest.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[key, "score", "predicted"])

    return stats.select(key, "features").mapInArrow(run, schema)

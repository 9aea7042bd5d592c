"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree cuts the vectors along one random direction per level, at the median of a bounded sample of the node;
what lies within the spill of the cut goes to both sides. The spill narrows by ``NARROWING`` per level, so that a vector has
a bounded number of copies at any depth, and the number of trees follows from what each is calculated to miss. Thresholds come from at most ``SAMPLE`` vectors
(those with the smallest hash of their id); every vector is indexed, at any depth: below the depth that the sample
supports, a node uses the cuts of its last ancestor that has a sample. Nodes that lie mostly within the spill
of a cut, i.e. dense groups, are leaves. All pairs of a leaf are compared in double precision; a leaf of more
than ``LEAF_ROWS`` vectors is compared as pairs of blocks, each a task key of its own.

Vectors of each length have a forest and leaves of their own, so all lengths are searched; those with few enough
vectors for a single leaf are compared pair by pair.

A pair found in several leaves counts in the first one only: for the rows that have a hit, the task works out the earlier
leaves anew. Projections are sums of integers below 2**53, so every task gets the same leaves, whatever else it computes
with them. So direct links are counted without writing pairs, and each leaf gives one row per vector.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite components link with nothing, nor do
vectors of different lengths with each other; equal vectors are one node and link with each other; a NULL id has no component
but its row is kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erfc, exp, floor, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from postmill.llm.common import components, key_chunks, local_roots
from postmill.sources.staging import stage

COSINE = 0.9
#: Trees at least; more where that many would miss more than ``MISSED`` of the pairs that just link.
TREES = 6
MISSED = 0.01
#: Spill of a level against that of the level above; the copies of a vector in a tree stay below about six at any depth.
NARROWING = 0.9
LEAF = 512
LEAF_ROWS = 2_000
SAMPLE = 16_384
NODE_SAMPLE = 64


#: Components of vectors and directions as integers: their products add up without rounding, in any order.
_UNIT = 1 << 24


@dataclass(frozen=True)
class Tree:
    """Cuts of one tree; level ``d`` has cuts for each node of level ``min(d, supported)``."""

    directions: np.ndarray
    cuts: list[np.ndarray]
    whole: list[np.ndarray]
    supported: int
    spills: np.ndarray


def trees_for(depth: int, least: int = TREES, missed: float = MISSED, cosine: float = COSINE) -> int:
    """Trees of ``depth`` levels after which about ``missed`` of the pairs that just link are in no common leaf.

    Projections of unit vectors are taken as normal. A level parts a pair if the cut lies between, beyond the spill of both.
    """
    apart = sqrt(2 - 2 * cosine)
    together = 1.0
    for level in range(depth):
        a = NARROWING**level  # both spills, in standard deviations of the pair's difference
        beyond = 2 * (exp(-a * a / 2) / sqrt(2 * pi) - a * erfc(a / sqrt(2)) / 2)
        together *= 1 - apart * beyond / sqrt(2 * pi)
    return least if together > 1 - missed ** (1 / least) else ceil(log(missed) / log(1 - together))


def _along(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.rint(x * _UNIT) @ directions.T


def grow(sample: np.ndarray, rows: int, seed: int, cosine: float = COSINE, leaf: int = LEAF) -> Tree:
    dim = sample.shape[1]
    depth = max(0, ceil(log2(max(rows, 1) / leaf)))
    supported = max(0, min(depth, floor(log2(max(len(sample), 1) / NODE_SAMPLE))))
    directions = np.random.default_rng([seed, dim]).normal(size=(depth, dim))
    if depth:
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    directions = np.rint(directions * _UNIT)
    # Half the usual distance, along a random direction, of two unit vectors that just link.
    spills = 0.5 * sqrt(2 - 2 * cosine) / sqrt(dim) * NARROWING ** np.arange(depth) * _UNIT**2
    along = _along(sample, directions)
    cuts, whole = [], []
    member, node = np.arange(len(sample)), np.zeros(len(sample), np.int64)
    for level in range(depth):
        nodes = 1 << min(level, supported)
        cut, stop, spill = np.zeros(nodes), np.zeros(nodes, bool), spills[level]
        order = np.argsort(node, kind="stable")
        bounds = np.searchsorted(node[order], np.arange(nodes + 1))
        for i in range(nodes):
            x = along[member[order[bounds[i]:bounds[i + 1]]], level]
            if len(x):
                cut[i] = np.median(x)
                stop[i] = (np.abs(x - cut[i]) <= spill).mean() > 0.5
        cuts.append(cut)
        whole.append(stop)
        if level < supported:
            x = along[member, level] - cut[node]
            go = ~stop[node]
            left, right = go & (x <= spill), go & (x > -spill)
            member = np.concatenate([member[left], member[right]])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
    return Tree(directions, cuts, whole, supported, spills)


def leaves(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Rows and heap numbers of all leaves they belong to."""
    depth = len(tree.directions)
    along = _along(x, tree.directions)
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    done = []
    for level in range(depth):
        known = node >> max(0, level - tree.supported)
        stop = tree.whole[level][known]
        if stop.any():
            done.append((row[stop], (1 << level) + node[stop]))
            row, node, known = row[~stop], node[~stop], known[~stop]
        off = along[row, level] - tree.cuts[level][known]
        left, right = off <= tree.spills[level], off > -tree.spills[level]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    done.append((row, (1 << depth) + node))
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.ascontiguousarray(x, np.float64)
    most = np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x / most, axis=1, keepdims=True) / most


def _rows(column: pa.Array, rows: int, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(rows, -1)


def _codes(x: np.ndarray, forest: list[Tree], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes of the leaves of all trees, by row and code."""
    found = [leaves(x, t) for t in forest]
    row = np.concatenate([f[0] for f in found])
    code = np.concatenate([(i << shift) + f[1] for i, f in enumerate(found)])
    order = np.lexsort((code, row))
    return row[order], code[order]


def _assigned(nodes: DataFrame, forests: dict[int, list[Tree]], shift: int, kind: type) -> DataFrame:
    """``(dim, leaf, node, mult, vector)``: one row per vector and leaf; ``vector`` holds the components as they are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            alike = [(d, np.flatnonzero(lengths == d)) for d in np.unique(lengths).tolist()]
            for dim, some in ((d, at[i:i + 2000]) for d, at in alike for i in range(0, len(at), 2000)):
                part = batch.take(pa.array(some))
                raw = _rows(part.column(2), part.num_rows, kind)
                row, code = _codes(_unit(raw), forests[dim], shift)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dim, np.int32)), pa.array(code), part.column(0).take(at), part.column(1).take(at),
                     pa.array([v.tobytes() for v in raw], pa.binary()).take(at)],
                    names=["dim", "leaf", "node", "mult", "vector"])

    return nodes.select("node", "mult", "embedding", "dim").mapInArrow(
        run, "dim int, leaf long, node long, mult long, vector binary")


def _met_before(x: np.ndarray, i: np.ndarray, j: np.ndarray, leaf: int, forest: list[Tree], shift: int) -> np.ndarray:
    """Whether the pairs of rows share a leaf with a smaller code than ``leaf``."""
    hit, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[:len(i)], at[len(i):]
    row, code = _codes(x[hit], forest[:(leaf >> shift) + 1], shift)
    row, code = row[code < leaf], code[code < leaf]
    kinds, code = np.unique(code, return_inverse=True)
    have = np.sort(row * len(kinds) + code)
    begin = np.searchsorted(row, np.arange(len(hit) + 1))
    out = np.zeros(len(i), bool)
    for low in range(0, len(i), 20_000):
        left, right = a[low:low + 20_000], b[low:low + 20_000]
        n = begin[left + 1] - begin[left]
        pair = np.repeat(np.arange(len(left)), n)
        skipped = np.cumsum(n) - n
        asked = right[pair] * len(kinds) + code[np.arange(len(pair)) - skipped[pair] + begin[left][pair]]
        place = np.searchsorted(have, asked)
        place[place == len(have)] = 0
        if len(have):
            out[low + pair[have[place] == asked]] = True
    return out


def _compare(group: pa.Table, cosine: float, dim: int, leaf: int, forest: list[Tree], shift: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, links that count here, and smallest node tied to, for one leaf or pair of blocks."""
    node, mult, side = group["node"].to_numpy(), group["mult"].to_numpy(), group["side"].to_numpy()
    order = np.argsort(node, kind="stable")
    node, mult, side = node[order], mult[order], side[order]
    raw = group["vector"].to_pylist()
    x = _unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim))[order]
    first = np.arange(len(x))
    if side.any():
        left, right = first[side == 0], first[side == 1]
    else:
        left = right = first
    links, heads, tails = np.zeros(len(x), np.int64), [], []
    for begin in range(0, len(left), 256):
        rows = left[begin:begin + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        if len(i):
            heads.append(i)
            tails.append(j)
    if not heads:
        return node, links, node
    i, j = np.concatenate(heads), np.concatenate(tails)
    root = local_roots(len(x), i, j)
    new = ~_met_before(x, i, j, leaf, forest, shift)
    i, j = i[new], j[new]
    links = np.bincount(i, mult[j], len(x)).astype(np.int64) + np.bincount(j, mult[i], len(x)).astype(np.int64)
    return node, links, node[root]


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, trees: int = TREES,
                 leaf: int = LEAF, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    nodes = stage(source.filter(sound).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult")).withColumn(
        "dim", F.size("embedding")), "vectors")
    forests = {}
    for dim, rows in sorted((r["dim"], r["count"]) for r in nodes.groupBy("dim").count().collect()):
        if rows <= leaf:  # no cut, one leaf
            forests[dim] = [grow(np.zeros((0, dim)), rows, 0, cosine, leaf)]
            continue
        picked = nodes.filter(F.col("dim") == dim).select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(sample).toArrow()
        fitted = _unit(_rows(picked["embedding"].combine_chunks(), picked.num_rows))
        forests[dim] = [grow(fitted, rows, t, cosine, leaf) for t in range(trees_for(ceil(log2(rows / leaf)), trees, MISSED, cosine))]
    if not forests:
        return source.select(F.col("vec_id").alias(key), F.lit(0).cast("long").alias("n_links"),
                             F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shift = max(len(t.directions) for forest in forests.values() for t in forest) + 2
    single = isinstance(vectors.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    assigned = _assigned(nodes, forests, shift, kind)
    # Large leaves are dealt to pairs of blocks.
    large = assigned.groupBy("dim", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > leaf_rows).select(
        "dim", "leaf", F.ceil(F.col("n") / leaf_rows * 2).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = assigned.join(large, ["dim", "leaf"], "left").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).select(
        "dim", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "mult", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in key_chunks(batches, ["dim", "leaf", "i", "j"], 256):
            keys = np.stack([chunk[c].to_numpy().astype(np.int64) for c in ("dim", "leaf", "i", "j")], axis=1)
            heads = np.flatnonzero(np.append(True, (np.diff(keys, axis=0) != 0).any(1)))
            for begin, end in zip(heads, np.append(heads[1:], len(keys)), strict=True):
                if end - begin > 1:
                    dim, code = int(keys[begin, 0]), int(keys[begin, 1])
                    node, links, root = _compare(chunk.slice(begin, end - begin), cosine, dim, code, forests[dim], shift, kind)
                    some = (links > 0) | (root != node)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(some.sum()), dim, np.int32)), pa.array(node[some]), pa.array(links[some]), pa.array(root[some])], names=["dim", "node", "links", "root"])

    found = stage(dealt.repartition("dim", "leaf", "i", "j").sortWithinPartitions("dim", "leaf", "i", "j").mapInArrow(
        run, "dim int, node long, links long, root long"), "vector-links")
    totals = found.groupBy("dim", "node").agg(F.sum("links").alias("links"))
    # One id may come with vectors of several lengths, which are different nodes.
    node = lambda c: F.struct("dim", F.col(c).alias("node"))
    tied = components(found.filter("node <> root").select(node("node").alias("a"), node("root").alias("b"))).select(
        F.col("id.dim").alias("dim"), F.col("id.node").alias("node"), F.col("component.node").alias("component"))
    named = nodes.join(totals, ["dim", "node"], "left").join(tied, ["dim", "node"], "left").select(
        F.col("embedding").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("links"),
        F.coalesce("component", "node").alias("component"))
    sound_rows = source.filter(sound).join(named, F.col("embedding") == F.col("same")).select("vec_id", "links", "component")
    others = source.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return sound_rows.unionAll(others).select(
        F.col("vec_id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))

"""SimHash fingerprints, and their self-join as a traversal of binary tries.

Two fingerprints that differ in at most ``budget`` bits agree on one of ``budget + 1`` blocks. For each block the
bits are rotated so that it comes first, and the trie over the rotated bits is joined with itself, starting
from the nodes at the end of that block: node pairs go down together, differing bits add up, and a pair is
dropped once they exceed the budget. All node pairs of a task go down one bit at a time as arrays.

Nodes are spread over tasks by their prefix. A node with more than ``NODE_ROWS`` entries, such as a hot block,
is first split: its entries go to the pairs of its children that are still within the budget, each pair a task
key of its own. This repeats until no node is too large. Nodes that are still too large when no bit is left, i.e. many
entries with equal codes, are dealt to pairs of blocks, so no task meets an unbounded group.

Entries with equal codes are linked through representatives, not as all pairs: what is near one is tied to it and
asks no more; others are compared only with those of its members that the triangle inequality leaves (``connecting``).

Links found within a task are reduced to a forest (one row per entry), so a group of near copies costs rows in
proportion to its size, and no link between different fingerprints is lost.

Defined results: texts without words have fingerprint 0 and link like any other; NULL counts as such a text;
fewer words than a shingle make one shingle; equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import components, drop_staged, key_chunks, local_roots
from postmill.llm.words import mix, run_hash, slices, text_bytes, texts_of, windows, LOWER
from postmill.sources.staging import stage

BITS = 64
BUDGET = 3
NODE_ROWS = 20_000
#: Node pairs that go down together, and rows that a task holds at least.
FRONTIER = 1 << 15
CHUNK_ROWS = 20_000
STEP = 8


def _majority(hashes: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes of each non-empty group."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fp)``: majority bits of the XXH64 of all ``k``-word shingles of the lower-cased text."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64 = xxhash.xxh64_intdigest
        for batch in slices(batches, size=1 << 20):
            data, at = text_bytes(batch.column(1))
            raw = LOWER[data].tobytes()
            hashes: list[int] = []
            counts = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                words = raw[at[i]:at[i + 1]].split()
                if not words:
                    continue
                line = b" ".join(words)
                if len(words) <= k:
                    hashes.append(h64(line, seed))
                    counts[i] = 1
                    continue
                size = np.fromiter(map(len, words), np.int64, len(words))
                end = np.cumsum(size + 1) - 1
                start = end - size
                hashes += [h64(line[a:b], seed) for a, b in zip(start[: 1 - k].tolist(), end[k - 1:].tolist(), strict=True)]
                counts[i] = len(words) - k + 1
            fp = np.zeros(batch.num_rows, np.uint64)
            full = np.flatnonzero(counts)
            if len(full):
                heads = (np.cumsum(counts) - counts)[full]
                fp[full] = _majority(np.array(hashes, np.uint64), heads, counts[full])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other).sum(-1, dtype=np.int64)


def connecting(sketch: np.ndarray | None, far: float | None, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect what all pairs of sketches at most ``far`` apart connect, each such a pair itself.

    Without ``far`` all rows link. The first row left is a representative, and the rows near it are its members. A row
    farther from it than ``far`` is near a member only if their distances from it differ by ``far`` at most. Such rows are
    compared with the members, outermost first, until one is near; all rows but the members stay for later.
    """
    if far is None:
        yield np.zeros(rows - 1, np.int64), np.arange(1, rows)
        return
    left = np.arange(rows)
    while len(left) > 1:
        head, left = left[0], left[1:]
        apart = _apart(sketch[left], sketch[head])
        near = apart <= far
        member, inner = left[near], apart[near]
        left, outer = left[~near], apart[~near]
        if not len(member):
            continue
        yield np.full(len(member), head), member
        order = np.argsort(-inner, kind="stable")
        member, inner = member[order], inner[order]
        some = outer <= far + inner[0]
        ask, outer = left[some], outer[some]
        for begin in range(0, len(member), 64):
            m, reach = member[begin:begin + 64], far + inner[begin]
            some = outer <= reach  # the members that follow reach no farther
            ask, outer = ask[some], outer[some]
            if not len(ask):
                break
            found = np.zeros(len(ask), bool)
            for at in range(0, len(ask), 2048):
                close = _apart(sketch[ask[at:at + 2048], None], sketch[None, m]) <= far
                hit = np.flatnonzero(close.any(1))
                if len(hit):
                    yield m[close[hit].argmax(1)], ask[at + hit]
                    found[at + hit] = True
            ask, outer = ask[~found], outer[~found]


def descend(left: np.ndarray, right: np.ndarray, ranges: tuple[np.ndarray, ...], depth: int, bits: int,
            budget: int, dense=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget below node pairs ``(lo, hi, lo, hi, differing bits)`` of sorted values.

    Values are left-aligned. A pair of a node with itself yields each of its pairs once. Where no bit is left and
    many entries are, ``dense(lo, hi, lo, hi)`` takes them instead, if there is such a function.
    """
    same = left is right
    stack = [(*ranges, depth)]
    while stack:
        lo, hi, lo2, hi2, used, depth = stack.pop()
        if len(lo) > FRONTIER:
            half = len(lo) // 2
            stack.append((lo[half:], hi[half:], lo2[half:], hi2[half:], used[half:], depth))
            stack.append((lo[:half], hi[:half], lo2[:half], hi2[:half], used[:half], depth))
            continue
        n2 = hi2 - lo2
        area = (hi - lo) * n2
        leaf = (area <= 64) | (depth >= bits)
        if dense is not None and depth >= bits and (area > 64).any():
            for n in np.flatnonzero(area > 64).tolist():
                dense(lo[n], hi[n], lo2[n], hi2[n])
            some = area <= 64
            lo, hi, lo2, hi2, used, n2, area = (x[some] for x in (lo, hi, lo2, hi2, used, n2, area))
            leaf = np.ones(len(lo), bool)
        if leaf.any():
            total = area[leaf]
            which = np.repeat(np.flatnonzero(leaf), total)
            for piece in range(0, len(which), 1 << 20):
                w = which[piece:piece + (1 << 20)]
                inner = np.arange(piece, piece + len(w)) - np.repeat(np.cumsum(total) - total, total)[piece:piece + (1 << 20)]
                i, j = lo[w] + inner // n2[w], lo2[w] + inner % n2[w]
                near = np.bitwise_count(left[i] ^ right[j]) <= budget
                if same:
                    near &= (lo[w] != lo2[w]) | (i < j)
                if near.any():
                    yield i[near], j[near]
        go = np.flatnonzero(~leaf)
        if not len(go):
            continue
        lo, hi, lo2, hi2, used = lo[go], hi[go], lo2[go], hi2[go], used[go]
        keep = np.uint64((1 << 64) - (1 << (64 - depth))) if depth else np.uint64(0)
        one = np.uint64(1 << (63 - depth))
        mid = np.clip(np.searchsorted(left, (left[lo] & keep) | one), lo, hi)
        mid2 = np.clip(np.searchsorted(right, (right[lo2] & keep) | one), lo2, hi2)
        itself = (lo == lo2) if same else np.zeros(len(lo), bool)
        parts = [(lo, mid, lo2, mid2, used, np.ones(len(lo), bool)), (mid, hi, mid2, hi2, used, np.ones(len(lo), bool)),
                 (lo, mid, mid2, hi2, used + 1, used < budget), (mid, hi, lo2, mid2, used + 1, (used < budget) & ~itself)]
        parts = [tuple(x[p[5] & (p[1] > p[0]) & (p[3] > p[2])] for x in p[:5]) for p in parts]
        stack.append((*(np.concatenate(x) for x in zip(*parts, strict=True)), depth + 1))


def _near_in(rows: pa.Table, bits: int, budget: int, depth_of, far: float | None) -> pa.RecordBatch:
    """Forest over the links among the nodes of whole keys."""
    t, a, b, side, pair = (rows[c].to_numpy() for c in ("t", "a", "b", "side", "pair"))
    value = rows["value"].to_numpy().view(np.uint64)
    ids, where = np.unique(rows["node"].to_numpy(), return_inverse=True)
    sketch = None
    if far is not None:
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(value), -1)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def take(found: Iterator[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> None:
        nonlocal pairs
        held = 0
        for i, j in found:
            i, j = left[i], right[j]
            if sketch is not None:
                close = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= far
                i, j = i[close], j[close]
            pairs.append((where[i], where[j]))
            held += len(i)
            if held > 1 << 20:  # a dense group: keep its forest only
                shrink()
                held = 0

    def shrink() -> None:
        nonlocal pairs
        if pairs:
            root = local_roots(len(ids), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
            tied = np.flatnonzero(root != np.arange(len(ids)))
            pairs = [(tied, root[tied])]

    tied_links = 0

    def equal(some: np.ndarray) -> None:
        nonlocal tied_links
        for i, j in connecting(None if sketch is None else sketch[some], far, len(some)):
            pairs.append((where[some[i]], where[some[j]]))
            tied_links += len(i)
            if tied_links > 1 << 20:
                shrink()
                tied_links = 0

    def dense(left: np.ndarray, right: np.ndarray):
        """Links the entries of two nodes without further bits; those within one of the nodes link as well."""
        return lambda lo, hi, lo2, hi2: equal(
            left[lo:hi] if left is right and lo == lo2 else np.concatenate([left[lo:hi], right[lo2:hi2]]))

    blocks = np.flatnonzero(pair >= 0)
    if len(blocks):
        change = np.flatnonzero(np.append(True, np.any([np.diff(x[blocks]) != 0 for x in (t, a, b, pair)], axis=0)))
        for begin, end in zip(change, np.append(change[1:], len(blocks)), strict=True):
            equal(blocks[begin:end])
    own = (a == b) & (pair < 0)
    for kind in np.unique(t[own]):
        at = np.flatnonzero(own & (t == kind))
        at = at[np.argsort(value[at], kind="stable")]
        for depth in np.unique(depth_of[at]):
            # Nodes of one depth: ranges of equal prefixes in the sorted values.
            some = at[depth_of[at] == depth]
            v = value[some]
            heads = np.flatnonzero(np.append(True, (v[1:] ^ v[:-1]) >> np.uint64(64 - depth) > 0))
            ends = np.append(heads[1:], len(v))
            more = ends - heads > 1
            if more.any():
                lo, hi = heads[more], ends[more]
                take(descend(v, v, (lo, hi, lo, hi, np.zeros(len(lo), np.int64)), int(depth), bits, budget, dense(some, some)), some, some)
    rest = np.flatnonzero((a != b) & (pair < 0))
    if len(rest):
        change = np.flatnonzero(np.append(True, (np.diff(t[rest]) != 0) | (np.diff(a[rest]) != 0) | (np.diff(b[rest]) != 0)))
        for begin, end in zip(change, np.append(change[1:], len(rest)), strict=True):
            group = rest[begin:end]
            left, right = group[side[group] == 0], group[side[group] == 1]
            if len(left) and len(right):
                left, right = left[np.argsort(value[left])], right[np.argsort(value[right])]
                one = lambda n: np.array([n])
                spent = int(np.bitwise_count(np.uint64(a[group[0]] ^ b[group[0]])))
                take(descend(value[left], value[right], (one(0), one(len(left)), one(0), one(len(right)), one(spent)),
                             int(depth_of[group[0]]), bits, budget, dense(left, right)), left, right)
    shrink()
    root = local_roots(len(ids), *pairs[0]) if pairs else np.arange(len(ids))
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[root[tied]]), pa.array(ids[tied])], names=["a", "b"])


def _rotated(codes: DataFrame, bits: int, budget: int) -> DataFrame:
    """One row per entry and block: ``t`` table and rotation, ``a = b`` the prefix, ``value`` left-aligned."""
    block = bits // (budget + 1)
    extra = ", sketch binary" if "sketch" in codes.columns else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            tab, node = batch.column(0).to_numpy(), batch.column(1)
            code = batch.column(2).to_numpy().view(np.uint64)
            for r in range(budget + 1):
                turn = r * block
                value = ((code << np.uint64(turn)) | (code >> np.uint64(bits - turn))) if turn else code
                value = value << np.uint64(64 - bits) if bits < 64 else value
                prefix = (value >> np.uint64(64 - block)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((tab * (budget + 1) + r).astype(np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(prefix),
                     pa.array(prefix), pa.array(np.zeros(n, np.int32)), pa.array(value.view(np.int64)), node,
                     pa.array(np.full(n, -1)), *([batch.column(3)] if extra else [])],
                    names=["t", "depth", "a", "b", "side", "value", "node", "pair", *(["sketch"] if extra else [])])

    return codes.mapInArrow(run, f"t int, depth int, a long, b long, side int, value long, node long, pair long{extra}")


def _children(rows: DataFrame, budget: int) -> DataFrame:
    """Entries of large nodes, dealt to the pairs of children that are within the budget."""
    masks = [m for m in range(1 << STEP) if m.bit_count() <= budget]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, side, depth = (batch.column(i).to_numpy() for i in (2, 3, 4, 1))
            value = batch.column(5).to_numpy().view(np.uint64)
            child = ((value << depth.astype(np.uint64)) >> np.uint64(64 - STEP)).view(np.int64)
            spent = np.bitwise_count((a ^ b).view(np.uint64))
            for mask in masks:
                other = child ^ mask
                own = a == b
                first = np.where(own, child < other, side == 0) | (mask == 0) & own
                left = (a << STEP) | np.where(first, child, other)
                right = (b << STEP) | np.where(first, other, child)
                fits = spent + mask.bit_count() <= budget
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array((depth + STEP).astype(np.int32)), pa.array(left), pa.array(right),
                     pa.array(np.where(first, 0, 1).astype(np.int32)), *batch.columns[5:]], names=batch.schema.names)
                yield out.filter(pa.array(fits))

    return rows.mapInArrow(run, rows.schema)


def _blocks(rows: DataFrame, budget: int, node_rows: int) -> DataFrame:
    """Entries of nodes that are large though no bit is left, dealt to pairs of blocks.

    Nodes of equal codes are the same in every rotation and stay in the first one; two nodes of which one is empty go.
    """
    half = max(1, node_rows // 2)
    large = stage(rows.groupBy("t", "a", "b").agg(F.count("*").alias("n"), F.countDistinct("side").alias("sides")).filter(
        F.col("n") > node_rows).withColumn("blocks", F.ceil(F.col("n") / half).cast("long")).drop("n"), "large-nodes")
    keys = ["t", "a", "b"]
    small = rows.join(large, keys, "left_anti").select(*rows.columns)
    wanted = large.filter((F.col("a") == F.col("b")) & (F.col("t") % (budget + 1) == 0) | (F.col("a") != F.col("b")) & (F.col("sides") > 1))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = rows.drop("pair").join(wanted, keys).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn(
        "pair", F.least(own, "other") * F.col("blocks") + F.greatest(own, "other"))
    return small.unionAll(dealt.select(*rows.columns))


def links(codes: DataFrame, bits: int = BITS, budget: int = BUDGET, node_rows: int = NODE_ROWS, far: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes linked in some table.

    ``codes``: ``(tab int, node long, code long[, sketch binary])``, codes of ``bits`` bits, each once per table. Nodes link if
    codes of one table differ in at most ``budget`` bits and, with ``far``, sketches in at most ``far``.
    """
    rows, done = _rotated(codes, bits, budget), None
    depth = bits // (budget + 1)
    while depth + STEP <= bits:
        sizes = rows.groupBy("t", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > node_rows).drop("n")
        large = stage(sizes, "large-nodes")
        if large.isEmpty():
            drop_staged(codes.sparkSession, large)
            break
        small = rows.join(large, ["t", "a", "b"], "left_anti").select(*rows.columns)
        done = small if done is None else done.unionAll(small)
        rows = _children(rows.join(large, ["t", "a", "b"], "left_semi").select(*rows.columns), budget)
        depth += STEP
    else:
        if depth == bits:
            rows = _blocks(rows, budget, node_rows)
    rows = rows if done is None else done.unionAll(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in key_chunks(batches, ["t", "a", "b", "pair"], CHUNK_ROWS):
            yield _near_in(chunk, bits, budget, chunk["depth"].to_numpy(), far)

    return rows.repartition("t", "a", "b", "pair").sortWithinPartitions("t", "a", "b", "pair").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, budget: int = BUDGET) -> DataFrame:
    """``(key, fp, component_id)``: fingerprint, and smallest key reachable over links of at most ``budget`` bits."""
    prints = stage(fingerprints(docs, key, text, k), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(key).alias("node"))
    found = components(links(nodes.select(F.lit(0).alias("tab"), "node", F.col("fp").alias("code")), BITS, budget))
    named = nodes.join(found, nodes.node == found.id, "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select(key, "fp", "component_id")


# -- near duplicates by shingle similarity -------------------------------------------------------

SHINGLE = 5
SIMILAR = 0.8
TABLES = 10
CODE_BITS = 32
#: Of 320 bits, about 49 differ at similarity 0.8, with a standard deviation of about 6.
FAR = 72
#: Documents of a group that become or follow leaders in one round, and other documents per task.
LEADERS = 512
SALT_ROWS = 2_000


def _sets(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes with their owners, sorted by owner and hash; short texts are one shingle."""
    word = words.hashes()
    first, owner = windows(words, k)
    h = run_hash(word, first, first + k)
    n = words.counts()
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h = np.concatenate([h, run_hash(word, words.first[short], words.first[short] + n[short])])
        owner = np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def sketches(docs: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """``(key, n, same, sketch)``: number of distinct shingles, a hash of the set, and ``TABLES`` SimHash codes."""
    schema = f"{key} long, n long, same long, sketch binary"
    parts = TABLES * CODE_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            h, owner = _sets(texts_of(batch), k)
            full, heads, n = np.unique(owner, return_index=True, return_counts=True)
            if not len(full):
                continue
            same = np.add.reduceat(mix(h), heads)
            codes = np.stack([_majority(mix(h + np.uint64(0x9E3779B97F4A7C15 * (p + 1) % (1 << 64))), heads, n) for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(full)), pa.array(n), pa.array(same.view(np.int64)),
                 pa.array([row.tobytes() for row in codes], pa.binary())], names=[key, "n", "same", "sketch"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, owner = _sets(texts_of(batch), k)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                names=[key, "shingles"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, f"{key} long, shingles binary")


class _Leaders:
    """Leaders of one group with their shingles, sorted, so that what a set shares with each of them is counted at once."""

    def __init__(self, similar: float):
        self.similar = similar
        self.docs: list[int] = []
        self.sizes = np.zeros(0, np.int64)
        self.shingles, self.owners = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.new: list[tuple[int, np.ndarray]] = []

    def add(self, doc: int, shingles: np.ndarray) -> None:
        self.new.append((len(self.docs), shingles))
        self.docs.append(doc)
        self.sizes = np.append(self.sizes, len(shingles))

    def _settle(self) -> None:
        """The new leaders' shingles are sorted in among the others."""
        every = np.concatenate([self.shingles, *(x for _, x in self.new)])
        order = np.argsort(every, kind="stable")
        self.owners = np.concatenate([self.owners, *(np.full(len(x), i, np.int32) for i, x in self.new)])[order]
        self.shingles, self.new = every[order], []

    def first(self, shingles: np.ndarray) -> int | None:
        """The first leader whose set is similar to this one: every leader is compared, exactly."""
        n = len(shingles)
        fits = (self.similar * n - 1e-9 <= self.sizes) & (self.sizes <= n / self.similar + 1e-9)
        if not fits.any():
            return None
        if len(self.new) > 16:
            self._settle()
        both = np.zeros(len(self.docs), np.int64)
        for begin in range(0, n, 2048) if len(self.shingles) else ():
            some = shingles[begin:begin + 2048]  # each at most once in a leader
            lo, hi = np.searchsorted(self.shingles, some), np.searchsorted(self.shingles, some, side="right")
            some = hi - lo
            at = np.arange(some.sum()) + np.repeat(lo - (np.cumsum(some) - some), some)
            both += np.bincount(self.owners[at], minlength=len(both))
        for i, x in self.new:
            if fits[i]:
                both[i] = len(np.intersect1d(shingles, x, assume_unique=True))
        hit = np.flatnonzero(fits & (both >= self.similar * (n + self.sizes - both) - 1e-9))
        return self.docs[hit[0]] if len(hit) else None


def _judge(rows: DataFrame, similar: float) -> DataFrame:
    """``(doc, leader)`` of each row of ``component, salt, role, doc, shingles``; NULL while no leader is similar.

    Rows come sorted: the candidates for leaders of a group (role 0), then its other documents. A candidate that is
    similar to an earlier leader follows it, else it leads. One task holds the leaders of one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, _Leaders(similar)
        for batch in slices(batches, "shingles", 1 << 20):  # a batch may hold very long sets
            docs, led = [], []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for component, salt, role, doc, shingles in zip(*columns, strict=True):
                if (component, salt) != group:
                    group, leaders = (component, salt), _Leaders(similar)
                own = np.frombuffer(shingles, np.uint64)
                leader = leaders.first(own)
                if role == 0 and leader is None:
                    leader = doc
                    leaders.add(doc, own)
                if role == 1 or salt == 0:
                    docs.append(doc)
                    led.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(led, pa.int64())], names=["doc", "leader"])

    return rows.select("component", "salt", "role", "doc", "shingles").mapInArrow(run, "doc long, leader long")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, similar: float = SIMILAR,
               alike: DataFrame | None = None) -> DataFrame:
    """``(key, kept)``: each document to leave out, and the kept one whose shingle set is at least ``similar`` to its own.

    Groups of candidates are what ``alike`` (``classes`` of the documents) puts into one class, whole, and what SimHash codes
    joined over tries, in ``TABLES`` tables, link beyond that. The bound ``FAR`` on the sketches holds for the codes alone, so that
    unlike texts, of which many have one short code, do not chain to groups. In each group documents are
    taken by id: one similar (Jaccard of the shingle sets) to a leader is left out, else it leads. ``LEADERS`` documents of
    a group are settled among themselves per round, and all others, spread over tasks, are compared with these; who
    finds none goes on to the next round. Every comparison is exact, none is skipped: everything left out has a kept document
    that it was compared with, and no two that stay of a group are similar. Texts without words are never duplicates.
    """
    spark = docs.sparkSession
    found = stage(sketches(docs, key, text, k), "sketches")
    nodes = found.groupBy("same", "n").agg(F.min(F.struct(key, "sketch")).alias("least")).select(
        "same", "n", F.col(f"least.{key}").alias("node"), F.col("least.sketch").alias("sketch"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, TABLES)
            for tab in range(TABLES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, tab, np.int32)), batch.column(0), pa.array(codes[:, tab].astype(np.int64)), batch.column(1)],
                    names=["tab", "node", "code", "sketch"])

    codes = nodes.select("node", "sketch").mapInArrow(split, "tab int, node long, code long, sketch binary")
    near = links(codes, CODE_BITS, BUDGET, far=FAR)
    if alike is not None:
        # Texts of one shingle set may be of several classes, as fingerprints count repeats.
        owned = found.join(nodes.select("same", "n", "node"), ["same", "n"]).select(key, "node")
        marked = stage(alike.join(owned, key).select("component_id", "node").distinct(), "class-nodes")
        least = marked.groupBy("component_id").agg(F.min("node").alias("a"))
        near = near.unionAll(marked.join(least, "component_id").filter("node <> a").select("a", F.col("node").alias("b")))
    groups = components(near)
    members = docs.join(groups.withColumnRenamed("id", key), key, "left_semi")
    sets = shingle_sets(members, key, text, k)
    open_ = stage(sets.join(groups, F.col(key) == F.col("id")).select("component", F.col(key).alias("doc"), "shingles").distinct(), "group-sets")
    placed = None
    while not open_.isEmpty():
        sizes = open_.groupBy("component").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
        first = open_.select("component", "doc").withColumn(
            "rank", F.row_number().over(Window.partitionBy("component").orderBy("doc"))).filter(F.col("rank") <= LEADERS).select(
            F.col("doc").alias("lead"))
        roles = open_.join(first, F.col("doc") == F.col("lead"), "left").join(sizes, "component").withColumn(
            "role", F.when(F.col("lead").isNull(), 1).otherwise(0))
        own = F.array(F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
        dealt = roles.withColumn("salt", F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(own)))
        judged = stage(_judge(dealt.repartition("component", "salt").sortWithinPartitions("component", "salt", "role", "doc"), similar), "judged")
        near = judged.filter("leader IS NOT NULL")
        placed = near if placed is None else placed.unionAll(near)
        following = stage(open_.join(judged.filter("leader IS NULL"), "doc", "left_semi").select("component", "doc", "shingles"), "group-sets")
        drop_staged(spark, open_)
        open_ = following
    copies = found.join(nodes.select("same", "n", "node"), ["same", "n"]).select(F.col(key).alias("doc"), "node")
    if placed is None:
        return copies.filter("doc <> node").select(F.col("doc").alias(key), F.col("node").alias("kept"))
    return copies.join(placed.select(F.col("doc").alias("node"), "leader"), "node", "left").select(
        F.col("doc").alias(key), F.coalesce("leader", "node").alias("kept")).filter(F.col(key) != F.col("kept"))

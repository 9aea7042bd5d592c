"""Packing along a space-filling curve.

Each text is encoded once; its hashed token counts are projected to ``DIMENSIONS`` fixed random directions, and the
place on the Hilbert curve through that space is its key. Documents are range-sorted by the key and laid end to
end; every ``length`` tokens a sequence ends, so neighbours on the curve share sequences and only the last
sequence has padding.

Encoded texts are written once to the shared folder. The order is made from narrow rows alone (key, number of
tokens): running sums inside range partitions, plus one total per partition. Ids then meet their place by row
number, in one shuffle.

Defined results: NULL counts as the empty text, which is one end token; equal texts share a key and are ordered
by row number; repeated rows are packed each, also those with one id or none. Very long texts are encoded whole, alone, and
cut into as many sequences as they fill. Special tokens in a text are what the vocabulary's file makes of them. An empty
table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import run_hash, slices, text_bytes
from postmill.sources.staging import stage

LENGTH = 2048
END = 1
BINS, DIMENSIONS, ORDER = 256, 4, 12
#: Encoded parts that a worker remembers, and parts given to the tokenizer at once.
REMEMBERED, TOGETHER = 800_000, 500
#: Bytes of text that are cut and put together at once.
BYTES = 1 << 19
# Signs after a space before which no text is cut: ASCII white space, and all that may begin other white space.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


#: The lowest 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class _Memory:
    """Ids of parts met before, found by hash and compared as bytes. Entry 0 is the end id."""

    def __init__(self, end: int, kind: np.dtype, remembered: int = REMEMBERED):
        self.bits = max(10, (2 * remembered).bit_length())
        self.slots, self.entries = np.zeros((1 << self.bits) + 4096, np.uint64), np.zeros((1 << self.bits) + 4096, np.int32)
        self.ids, self.used = np.full(1 << 16, end, kind), 1
        self.start, self.size, self.count = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64), 1
        self.bytes, self.written = np.zeros(1 << 16, np.uint8), 0
        self.text, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put entries behind the others; their numbers."""
        first, n = self.count, self.count + len(sizes)
        self.ids = self._room(self.ids, self.used + len(ids))
        self.start, self.size, self.text, self.length = (self._room(x, n) for x in (self.start, self.size, self.text, self.length))
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[first:n] = self.used + np.cumsum(sizes) - sizes
        self.size[first:n] = sizes
        self.used, self.count = self.used + len(ids), n
        return np.arange(first, n)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def remember(self, hashes: np.ndarray, entry: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        if not len(entry):
            return
        raw = data[_ranges(start, size)]
        self.bytes = self._room(self.bytes, self.written + len(raw))
        self.bytes[self.written:self.written + len(raw)] = raw
        self.text[entry], self.length[entry] = self.written + np.cumsum(size) - size, size
        self.written += len(raw)
        at, left = self._slot(hashes), np.arange(len(entry))
        while len(left):
            _, first = np.unique(at, return_index=True)
            free = first[self.slots[at[first]] == 0]
            self.slots[at[free]], self.entries[at[free]] = hashes[left[free]], entry[left[free]]
            keep = np.ones(len(left), bool)
            keep[free] = False
            keep &= (at + 1 < len(self.slots) - 1) & (self.slots[at] != hashes[left])  # a clash, or a full table: not remembered
            left, at = left[keep], at[keep] + 1

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry of each part, -1 where it is not known."""
        out, left, at = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            held = self.slots[at]
            hit = held == hashes[left]
            out[left[hit]] = self.entries[at[hit]]
            more = ~hit & (held != 0)
            left, at = left[more], at[more] + 1
        some = np.flatnonzero(out >= 0)
        entry = out[some]
        out[some[self.length[entry] != size[some]]] = -1
        some = np.flatnonzero(out >= 0)
        if len(some):
            n = size[some]
            same = data[_ranges(start[some], n)] == self.bytes[_ranges(self.text[out[some]], n)]
            out[some[~np.logical_and.reduceat(same, np.cumsum(n) - n)]] = -1
        return out


class Encoder:
    """Ids of whole texts, from the ids of their space-separated parts.

    The vocabulary's word pattern never joins what stands before a space with a sign after it, so a text may be
    cut before every space that a non-space follows, and equal parts have equal ids. A text that holds one of the
    vocabulary's special tokens is one part: the tokenizer cuts at those first. Equal parts of a batch are found by hash,
    compared as bytes, and looked up once; ids are gathered from one array.
    """

    def __init__(self, path: str, end: int = END):
        # Tasks share the cores already; further threads would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # Each sign of a byte-level token stands for one byte.
        self.widths = np.zeros(size, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.widths[number] = len(token)
        self.old: _Memory | None = None
        self.memory = _Memory(end, self.kind, 0)
        self.remembered = -1

    def _fresh(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, special: bool) -> np.ndarray:
        """Entries of parts not met before. Parts with a leading space are encoded as one text, whose ids are then cut
        where the tokens' bytes add up to the parts'; what the tokenizer returns is far larger than ids, so few at once."""
        out = np.zeros(len(start), np.int64)
        alone = data[start] != 0x20
        if special:
            alone |= np.array([any(t in data[s:s + n].tobytes() for t in self.special) for s, n in zip(start.tolist(), size.tolist(), strict=True)], bool)
        spaced = np.flatnonzero(~alone)
        for begin in range(0, len(spaced), TOGETHER):
            some = spaced[begin:begin + TOGETHER]
            text = data[_ranges(start[some], size[some])].tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(size[some])) + 1
            out[some] = self.memory.add(ids.astype(self.kind), np.diff(cuts, prepend=0))
        for i in np.flatnonzero(alone).tolist():
            ids = np.array(self.tokenizer.encode(data[start[i]:start[i] + size[i]].tobytes().decode(), add_special_tokens=False).ids, self.kind)
            out[i] = self.memory.add(ids, np.array([len(ids)]))[0]
        return out

    def numbers(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, remembered: int = REMEMBERED, special: bool = False) -> np.ndarray:
        """Entry of each of the parts, which differ from each other."""
        if self.memory.count > remembered or self.memory.used > 8 * remembered or self.remembered != remembered:
            # What is met again moves on to the next generation.
            self.old, self.memory = self.memory, _Memory(self.end, self.kind, remembered)
            self.remembered = remembered
        hashes = hashes | np.uint64(1)
        out = self.memory.find(hashes, data, start, size)
        fresh = np.flatnonzero(out < 0)
        if len(fresh) and self.old is not None:
            before = self.old.find(hashes[fresh], data, start[fresh], size[fresh])
            again, before = fresh[before >= 0], before[before >= 0]
            ids = self.old.ids[_ranges(self.old.start[before], self.old.size[before])]
            out[again] = self.memory.add(ids, self.old.size[before])
            self.memory.remember(hashes[again], out[again], data, start[again], size[again])
            fresh = np.flatnonzero(out < 0)
        out[fresh] = self._fresh(data, start[fresh], size[fresh], special)
        self.memory.remember(hashes[fresh], out[fresh], data, start[fresh], size[fresh])
        return out

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where parts begin."""
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & ~_NO_CUT[data[1:]]
        raw = data.tobytes()
        for token in self.special:
            found = raw.find(token)
            while found >= 0:
                text = int(np.searchsorted(at, found, "right")) - 1
                cut[at[text]:at[text + 1]] = False
                found = raw.find(token, max(found + 1, int(at[text + 1]) - len(token) + 1))
        cut[at[:-1][np.diff(at) > 0]] = True
        return np.flatnonzero(cut[:len(data)])

    def encode(self, data: np.ndarray, at: np.ndarray, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, one after the other, and how many each has."""
        start = self.cuts(data, at)
        size = np.diff(np.append(start, len(data)))
        hashes = run_hash(data, start, start + size)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(start) and not _same(data, start, start[first][which], size, size[first][which]):  # different parts with one hash
            first, which = _by_bytes(data, start, start + size)
        special = any(t in data.tobytes() for t in self.special)
        number = self.numbers(hashes[first], data, start[first], size[first], remembered, special)[which]
        # The end id is one more part of each text.
        parts = np.searchsorted(start, at)
        number = np.insert(number, parts[1:], 0)
        sizes = self.memory.size[number]
        ids = self.memory.ids[_ranges(self.memory.start[number], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(bounds[parts + np.arange(len(at))])


def _same(data: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray, other_size: np.ndarray) -> bool:
    """Whether all pairs of parts are equal: sizes, then the first eight bytes as one number, then the rest of longer ones."""
    if (size != other_size).any():
        return False
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded, 0, (1,))
    if ((eight[start] ^ eight[other]) & _FIRST[np.minimum(size, 8)]).any():
        return False
    some = size > 8
    start, other, size = start[some] + 8, other[some] + 8, size[some] - 8
    return bool((data[_ranges(start, size)] == data[_ranges(other, size)]).all())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of several ranges."""
    head = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - head, size)


def _by_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, known = data.tobytes(), {}
    which = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    return np.unique(which, return_index=True)[1], which


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int = END) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def hilbert_key(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below ``2 ** order``.

    Works on Gray codes of the transposed index (J. Skilling, Programming the Hilbert curve, 2004).
    """
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for level in range(order - 1, 0, -1):
        q = 1 << level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            first = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
            x[0] = first
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(order - 1, 0, -1):
        q = 1 << level
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(order - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents from their concatenated token ids."""
    texts = len(counts)
    bins = ((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
    owner = np.repeat(np.arange(texts), counts)
    vector = np.sqrt(np.bincount(owner * BINS + bins, minlength=texts * BINS).reshape(texts, BINS))
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
    directions = np.random.default_rng(7).normal(size=(BINS, DIMENSIONS))
    place = 1 / (1 + np.exp(-2 * (vector @ directions)))
    return hilbert_key(np.minimum((place * (1 << ORDER)).astype(np.int64), (1 << ORDER) - 1))


def _portions(ids: np.ndarray, counts: np.ndarray, texts: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, len(counts), texts):
        z = min(a + texts, len(counts))
        yield ids[bounds[a]:bounds[z]], counts[a:z]


def encoded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END,
            remembered: int = REMEMBERED) -> DataFrame:
    """``(row, key, curve, n, ids)``: the ids of each whole text with the end id, and its curve key."""
    schema = f"row long, {key} {docs.schema[key].dataType.simpleString()}, curve long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, end)
        for batch in slices(batches, size=BYTES):
            ids, counts = enc.encode(*text_bytes(batch.column(2)), remembered)
            curve = np.concatenate([curve_keys(i, c) for i, c in _portions(ids, counts)])
            bounds = np.concatenate([[0], np.cumsum(counts)]) * enc.kind.itemsize
            raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype("<i8")), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(curve), pa.array(counts), raw.cast(pa.binary())], names=["row", key, "curve", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def _places(rows: DataFrame) -> DataFrame:
    """``(row, begin)``: tokens before each row in curve order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            begin = np.cumsum(n) - n + before
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(begin), batch.column(2), pa.array(np.full(len(n), part, np.int64))], names=["row", "begin", "n", "part"])

    ordered = rows.select("row", "curve", "n").repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    inside = stage(ordered.mapInArrow(run, "row long, begin long, n long, part long"), "curve-order")
    totals = sorted((r["part"], r["n"]) for r in inside.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row per range partition
    before, total = [], 0
    for part, n in totals:
        before.append((part, total))
        total += n
    bases = rows.sparkSession.createDataFrame(before, "part long, base long")
    return inside.join(F.broadcast(bases), "part").select("row", (F.col("begin") + F.col("base")).alias("begin"))


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END,
         with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces ``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    ``remembered`` bounds the encoded words that a worker keeps: more save time, fewer leave memory to other stages.
    """
    rows = stage(encoded(docs, vocabulary, key, text, end, remembered), "encoded")
    placed = rows.select("row", key, "n", "ids").join(_places(rows), "row").select(key, "n", "ids", "begin")
    schema = (f"{key} {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long" + (", ids binary" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, begin = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            pieces = (begin + n - 1) // length - begin // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (begin // length)[doc]
            lo = np.maximum(sequence * length, begin[doc])
            hi = np.minimum((sequence + 1) * length, (begin + n)[doc])
            start, size = lo - begin[doc], hi - lo
            sums, kept, which, ids = [], [], -1, np.zeros(0, "<u4")
            raw = batch.column(2)
            for d, s, m in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
                if d != which:
                    which, ids = d, np.frombuffer(raw[d].as_py(), f"<u{len(raw[d].as_py()) // int(n[d])}").astype("<u4")
                piece = ids[s:s + m].tobytes()
                sums.append(zlib.crc32(piece))
                if with_ids:
                    kept.append(piece)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(sums, pa.int64()), pa.array(n[doc]),
                 pa.array(sequence), pa.array(lo - sequence * length), *([pa.array(kept, pa.binary())] if with_ids else [])],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])

    return placed.mapInArrow(run, schema)

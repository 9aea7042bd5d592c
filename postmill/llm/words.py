"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch.

A word is a run of bytes of one class; since every byte of a multi-byte character counts as a word
byte, byte runs and character runs are the same. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
#: Bytes whose words are hashed at a time; a longer word is hashed whole, alone.
PART = 1 << 17
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

#: Bytes that separate words: space and the five ASCII line and tab signs.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Only ASCII letters, digits and all that is not ASCII.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[0x30:0x3A] = PLAIN[0x41:0x5B] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = -(-n // PART) * PART
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of ``values[start:end]`` for many ranges; equal runs have equal hashes wherever they stand."""
    power, inverse = _power(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


@dataclass
class Words:
    """``data``: bytes of all texts; ``at``: where each text starts (and the end); ``start`` and ``end`` of each
    word; ``first``: the first word of each text (and the number of words)."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.at) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(self.texts), self.counts())

    def hashes(self) -> np.ndarray:
        """Hash of each word, part by part: running sums take many times the bytes they stand for."""
        out = np.empty(len(self.start), np.uint64)
        cuts = np.unique(np.searchsorted(self.start, np.arange(0, len(self.data) + PART, PART)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            low = self.start[a]
            out[a:b] = run_hash(self.data[low:self.end[b - 1]], self.start[a:b] - low, self.end[a:b] - low)
        return out

    def bytes_of(self, text: int) -> list[bytes]:
        raw = self.data.tobytes() if self.texts == 1 else self.data[self.at[text]:self.at[text + 1]].tobytes()
        off = int(self.at[text])
        a, b = self.first[text], self.first[text + 1]
        return [raw[s - off:e - off] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def find_words(data: np.ndarray, at: np.ndarray, kind: np.ndarray = SPACED) -> Words:
    inside = kind[data]
    n = len(data)
    heads = at[:-1][at[:-1] < n]
    edge = np.zeros(n + 1, dtype=bool)
    edge[heads] = True
    edge[n] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, at, start, end, np.searchsorted(start, at).astype(np.int64))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Row groups of about ``size`` bytes of text; a longer text stands alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + size, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def texts_of(batch: pa.RecordBatch, kind: np.ndarray = SPACED, lower: bool = True, text: str = "text") -> Words:
    data, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    return find_words(LOWER[data] if lower else data, at, kind)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``k`` words within one text, and the index of that text."""
    counts = np.maximum(words.counts() - k + 1, 0)
    owner = np.repeat(np.arange(words.texts), counts)
    skipped = np.cumsum(counts) - counts
    return np.arange(len(owner)) - skipped[owner] + words.first[owner], owner

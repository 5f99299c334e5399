"""Vectorised word scanning and hashing over Arrow string columns.

Texts stay in Arrow's byte buffer; words are byte ranges found with one table look-up per byte, so cost does not depend
on how many words there are in Python objects. Used inside ``mapInArrow`` tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Odd multiplier of the polynomial hash and the two multipliers of its finaliser (MurmurHash3's public fmix64).
BASE, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Bytes hashed at once; keeps the 8-byte temporaries within a few MB.
CHUNK_BYTES = 1 << 20


def byte_table(kind: str) -> np.ndarray:
    """Which UTF-8 bytes belong to a word. ``space``: all but 09-0D and 20. ``alnum``: 0-9, a-z and all above 7F."""
    t = np.ones(256, bool)
    if kind == "space":
        t[9:14] = False
        t[32] = False
    elif kind == "alnum":
        t[:128] = False
        t[48:58] = True
        t[97:123] = True
    else:
        raise ValueError(f"unknown kind of word: {kind}")
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """``data``: lower-cased bytes of all texts; word i is ``data[start[i]:end[i]]`` of text ``doc[i]``."""

    data: np.ndarray
    bounds: np.ndarray  # of the texts in data, one more than texts
    start: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        at = np.searchsorted(self.start, self.bounds)
        return np.diff(at)

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words last."""
        return np.searchsorted(self.start, self.bounds)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def texts_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text boundaries of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of no chunk
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def scan(column: pa.Array | pa.ChunkedArray, kind: str, lower: bool = True) -> Words:
    raw, bounds = texts_buffer(column)
    data = LOWER[raw] if lower else raw
    inside = byte_table(kind)[data]
    n = len(data)
    if not n:
        return Words(data, bounds, np.zeros(0, np.int64), np.zeros(0, np.int64))
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Words(data, bounds, start, end)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX_A)
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX_B)
    h ^= h >> np.uint64(33)
    return h


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are sorted by start and may overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(int(np.searchsorted(start, lo + CHUNK_BYTES)), i + 1)
        hi = int(end[i:j].max())
        size = hi - lo
        power, inverse = _powers(max(CHUNK_BYTES * 2, 1 << (size + 1).bit_length()))
        prefix = np.zeros(size + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:size], out=prefix[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def hash_words(w: Words) -> np.ndarray:
    return hash_ranges(w.data, w.start, w.end)


def shingle_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, from the words' hashes."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h * np.uint64(BASE)) ^ mix(word_hash[k : k + m] + np.uint64(k + 1))
    return mix(h)


def in_slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.Table]:
    """Consecutive rows joined until their texts reach ``most_bytes``; a single longer text is a slice of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        raw, bounds = texts_buffer(column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + most_bytes - size, side="right")) - 1
            if to <= at:
                if held:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                    continue
                to = at + 1
            held.append(batch.slice(at, to - at))
            size += int(bounds[to] - bounds[at])
            at = to
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def by_place(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by place, and the names that ``columns`` have there: input names that differ in case only, like
    ``text`` and ``Text``, can't be mistaken for each other. A name is met exactly, or else whatever its case."""
    low = [c.lower() for c in df.columns]
    at = [df.columns.index(c) if c in df.columns else low.index(c.lower()) for c in columns]
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), [f"c{k}" for k in at]

"""Words of whole Arrow columns at once: positions and 64-bit hashes by array operations.

A word is a maximal run of bytes outside tab to carriage return and space. A word's hash
is a polynomial over per-byte random values, taken from running sums, so no Python object
is made per word; shingle hashes mix word hashes. Equal words have equal hashes; two
different 64-bit hashes agree by chance about once in 10**19 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_CHUNK = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
PRIME = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(PRIME), -1, 2**64))


def powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(PRIME, _CHUNK)
_INV = powers(INVERSE, _CHUNK)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each text in data, one more at the end
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    first: np.ndarray  # index of the first word of each text, one more at the end
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        used = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, used + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def bounds(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(bytes, text offsets, word starts, word ends, first word of each text)."""
    data, offsets = texts(column)
    space = _SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    after = np.concatenate((space[1:], [True])) if len(data) else space
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return data, offsets, starts, ends, np.searchsorted(starts, offsets)


def words(column: pa.Array, lower: bool = True) -> Words:
    data, offsets, starts, ends, first = bounds(column)
    return Words(data, offsets, starts, ends, first, hash_spans(data, starts, ends, lower))


def hash_spans(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool
) -> np.ndarray:
    """Hashes of non-empty spans in ascending order; ``lower`` folds A-Z."""
    table, out, a = (_BYTE_LOWER if lower else _BYTE), np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        n = ends[b - 1] - base
        power, inverse = (_POW, _INV)
        if n > _CHUNK:  # one word longer than a chunk
            power, inverse = powers(PRIME, n), _INV
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[base : base + n]] * power[:n], out=run[1:])
        s = starts[a:b] - base
        out[a:b] = (run[ends[a:b] - base] - run[s]) * inverse[s]
        a = b
    return mix(out)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive values (across texts as well)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for k in range(1, size):
        h = h * U64(0x9FB21C651E98DF25) + hashes[k : k + n]
        h ^= h >> U64(31)
    return mix(h + U64(size))


def shingle_positions(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of the windows of ``size`` words that lie within one text."""
    h, doc = windows(w.hashes, size), w.doc
    inside = np.flatnonzero(doc[: len(h)] == doc[size - 1 :]) if len(h) else np.zeros(0, np.int64)
    return h[inside], inside


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    h, at = shingle_positions(w, size)
    cut = np.searchsorted(at, w.first)
    out = []
    for d, n in enumerate(w.counts):
        if n >= size:
            out.append(np.unique(h[cut[d] : cut[d + 1]]))
        elif n:
            out.append(windows(w.hashes[w.first[d] : w.first[d + 1]], int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def longest(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """(start, end) of the longest stretch with run[end] >= run[start]; (0, 0) if none."""
    if not len(starts) or not len(ends):
        return 0, 0
    floor = np.minimum.accumulate(run[starts])
    at = np.searchsorted(-floor, -run[ends] - 1e-9)
    start = starts[np.minimum(at, len(starts) - 1)]
    size = np.where(at < len(starts), ends - start, 0)
    i = int(np.argmax(size))
    return (int(start[i]), int(ends[i])) if size[i] > 0 else (0, 0)

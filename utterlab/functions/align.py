"""Word alignment for whole batches of utterances at once.

Canonical texts arrive in Arrow columns, are cut at blanks and numbered by distinct word,
all in Arrow, so no string becomes a Python object. Where the kinds of edits are asked for, the
edit table is swept along anti-diagonals for many pairs together, inside a band that widens
until it provably holds every optimal path. Where their number is enough, a column of the
table is held as the bits of its differences: one word for each of many pairs together, or a
long integer for a pair whose shorter side has more than 64 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_COST = 34  # bit position of the cost; below it two bits of tie order, then the count
_ONE = np.int64(1) << _COST
_TIE = np.int64(1) << 32
_KEEP = ~(np.int64(3) << 32)
_FAR = np.int64(1) << 60
_WORDS = ["ref_words", "hyp_words"]
_COUNTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ["s", "d", "i", *_WORDS]])
_EDITS = T.StructType([T.StructField(c, T.IntegerType()) for c in ["edits", *_WORDS]])


def _sweep(ref, hyp, n, m, band):
    """Packed (cost, substitutions) of each pair; exact where cost <= band."""
    pairs, width_r = ref.shape
    width_h = hyp.shape[1]
    rev = np.ascontiguousarray(hyp[:, ::-1])
    out = np.full(pairs, _FAR, np.int64)
    older = np.full((pairs, width_r + 3), _FAR, np.int64)  # column i + 1 holds row i
    old = older.copy()
    new = older.copy()
    ends = n + m
    old[:, 1] = 0
    done = ends == 0
    out[done] = 0
    for s in range(1, int(ends.max(initial=0)) + 1):
        lo = max(0, s - width_h, (s - band + 1) // 2)
        hi = min(width_r, s, (s + band) // 2)
        if lo > hi:
            older, old, new = old, new, older
            new.fill(_FAR)
            continue
        cell = new[:, lo + 1 : hi + 2]
        up = old[:, lo : hi + 1]
        left = old[:, lo + 1 : hi + 2]
        np.minimum(up + (_ONE + _TIE), left + (_ONE + 2 * _TIE), out=cell)
        a, b = max(lo, 1), min(hi, s - 1)
        if a <= b:
            diag = older[:, a : b + 1]
            inner = new[:, a + 1 : b + 2]
            np.minimum(inner, diag + (_ONE + 1), out=inner)
            same = ref[:, a - 1 : b] == rev[:, width_h - s + a : width_h - s + b + 1]
            np.copyto(inner, diag, where=same)
        cell &= _KEEP
        new[:, lo] = _FAR
        new[:, hi + 2] = _FAR
        hit = np.flatnonzero(ends == s)
        if hit.size:
            out[hit] = new[hit, n[hit] + 1]
        older, old, new = old, new, older
    return out


def _padded(values, starts, lengths, fill):
    width = max(int(lengths.max(initial=0)), 1)
    grid = np.full((len(lengths), width), fill, np.int64)
    mask = np.arange(width) < lengths[:, None]
    grid[mask] = values[(starts[:, None] + np.arange(width))[mask]]
    return grid


def edit_counts(ref: list[np.ndarray] | tuple, hyp: list[np.ndarray] | tuple) -> np.ndarray:
    """(substitutions, deletions, insertions) per pair of (values, offsets)."""
    (rv, ro), (hv, ho) = ref, hyp
    n, m = np.diff(ro), np.diff(ho)
    total = len(n)
    cost = np.zeros(total, np.int64)
    subs = np.zeros(total, np.int64)
    todo = np.arange(total)
    size = n + m
    band = 8 * (1 + (np.abs(n - m) + 7) // 8)  # few distinct widths, so chunks stay full
    while todo.size:
        todo = todo[np.lexsort((size[todo], band[todo]))]
        again = []
        at = 0
        while at < todo.size:
            # a chunk: equal-ish sizes, bounded working set
            first = todo[at]
            room = max(1, 262_144 // int(band[first] + 4))
            chunk = todo[at : at + min(room, 4096)]
            fits = (band[chunk] == band[first]) & (size[chunk] <= 1.25 * size[first] + 8)
            stop = int(np.argmin(fits)) if not fits.all() else len(chunk)
            chunk = chunk[: max(stop, 1)]
            at += len(chunk)
            k = int(band[first])
            packed = _sweep(
                _padded(rv, ro[:-1][chunk], n[chunk], -1),
                _padded(hv, ho[:-1][chunk], m[chunk], -2),
                n[chunk],
                m[chunk],
                k,
            )
            c = packed >> _COST
            good = c <= k
            cost[chunk[good]] = c[good]
            subs[chunk[good]] = packed[good] & 0xFFFFFFFF
            bad = chunk[~good]
            if bad.size:
                band[bad] = 4 * k
                again.append(bad)
        todo = np.concatenate(again) if again else np.empty(0, np.int64)
    # cost = S + D + I and n - m = D - I fix the other two counts
    deletions = (cost - subs + n - m) // 2
    return np.stack([subs, deletions, cost - subs - deletions], axis=1)


_CELLS = 1 << 20
_MANY = 1 << 14


def _short_distances(rows: np.ndarray, columns: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distances of pairs sorted by ``m``, with 1 to 64 words in ``rows`` (n) and at least
    as many in ``columns`` (m): rise and fall of a column of each table are the bits of a word."""
    equal = np.zeros((columns.shape[1], len(n)), np.uint64)
    across = np.ascontiguousarray(columns.T)
    for i in range(rows.shape[1]):
        equal |= (across == rows[:, i]).astype(np.uint64) << np.uint64(i)
    one, rise, fall = np.uint64(1), np.full(len(n), ~np.uint64(0)), np.zeros(len(n), np.uint64)
    top = (n - 1).astype(np.uint64)
    cost = n.copy()
    begin = np.searchsorted(m, np.arange(columns.shape[1]), "right")  # pairs that go on
    for j, at in enumerate(begin.tolist()):
        up, down, last = rise[at:], fall[at:], top[at:]
        same = equal[j, at:] | down
        flat = (((same & up) + up) ^ up) | same
        right, back = down | ~(up | flat), up & flat
        cost[at:] += ((right >> last) & one).astype(np.int64) - ((back >> last) & one).astype(np.int64)
        right = (right << one) | one
        rise[at:] = (back << one) | ~(flat | right)
        fall[at:] = right & flat
    return cost


def _long_distance(row: list[int], column: list[int]) -> int:
    """The same for one pair, with as many bits as ``row`` has words."""
    places: dict[int, int] = {}
    for i, word in enumerate(row):
        places[word] = places.get(word, 0) | 1 << i
    ones, top, cost = (1 << len(row)) - 1, len(row) - 1, len(row)
    rise, fall = ones, 0
    for word in column:
        same = places.get(word, 0) | fall
        flat = (((same & rise) + rise) ^ rise) | same
        right, back = fall | (ones & ~(rise | flat)), rise & flat
        cost += (right >> top & 1) - (back >> top & 1)
        right = right << 1 | 1
        rise = ones & (back << 1 | ~(flat | right))
        fall = ones & right & flat
    return cost


def edit_distances(ref: tuple[np.ndarray, np.ndarray], hyp: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of edits per pair of (values, offsets)."""
    (rv, ro), (hv, ho) = ref, hyp
    r, h = np.diff(ro), np.diff(ho)
    swap = r > h  # the distance is the same either way
    n, m = np.minimum(r, h), np.maximum(r, h)
    values = np.concatenate([rv, hv])
    first, second = ro[:-1], ho[:-1] + len(rv)
    row, column = np.where(swap, second, first), np.where(swap, first, second)
    cost = m.copy()  # of a pair with an empty side
    short = np.flatnonzero((n > 0) & (n <= 64))
    short = short[np.argsort(m[short], kind="stable")]
    at = 0
    while at < len(short):
        # pairs of much the same size, so the padding stays small
        least = int(m[short[at]])
        stop = int(np.searchsorted(m[short], least + least // 4 + 1, "right"))
        chunk = short[at : min(stop, at + max(1, min(_MANY, _CELLS // least)))]
        at += len(chunk)
        rows = _padded(values, row[chunk], n[chunk], -1)
        columns = _padded(values, column[chunk], m[chunk], -2)
        cost[chunk] = _short_distances(rows, columns, n[chunk], m[chunk])
    for i in np.flatnonzero(n > 64).tolist():
        sides = (values[row[i] : row[i] + n[i]], values[column[i] : column[i] + m[i]])
        cost[i] = _long_distance(*(side.tolist() for side in sides))
    return cost


def _numbered(texts: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words of each column of texts as (numbers, offsets); equal words have equal numbers."""
    whole = [t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t for t in texts]
    cut = [pc.split_pattern(pc.fill_null(t, ""), " ") for t in whole]
    found = pa.concat_arrays([c.flatten() for c in cut]).dictionary_encode()
    numbers = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(found.dictionary, "").as_py()  # -1 if none is
    out, at = [], 0
    for c in cut:
        offsets = c.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        mine = numbers[at : at + offsets[-1]]
        at += len(mine)
        word = mine != empty
        out.append((mine[word], np.concatenate([[0], np.cumsum(word)])[offsets]))
    return out


def _sizes(texts: list[pa.Array], sides: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """Words of each text; null for a null text."""
    return [
        pa.array(np.diff(offsets).astype(np.int32), mask=t.is_null().to_numpy(zero_copy_only=False))
        for t, (_, offsets) in zip(texts, sides, strict=True)
    ]


@arrow_udf(_COUNTS)
def _align(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    sides = _numbered([ref, hyp])
    counts = edit_counts(*sides).astype(np.int32)
    kinds = [pa.array(counts[:, k]) for k in range(3)]
    return pa.StructArray.from_arrays([*kinds, *_sizes([ref, hyp], sides)], names=_COUNTS.names)


@arrow_udf(_EDITS)
def _distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    sides = _numbered([ref, hyp])
    edits = pa.array(edit_distances(*sides).astype(np.int32))
    return pa.StructArray.from_arrays([edits, *_sizes([ref, hyp], sides)], names=_EDITS.names)


def word_align(reference: Column, hypothesis: Column) -> Column:
    """struct<s, d, i, ref_words, hyp_words> of two canonical texts: substitutions, deletions
    and insertions of the cheapest alignment; ties prefer match, substitution, deletion,
    insertion from the end."""
    return _align(reference, hypothesis)


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """struct<edits, ref_words, hyp_words> of two canonical texts: the number of edits alone."""
    return _distance(reference, hypothesis)


def utterance_wer(edits: Column, ref_words: Column, hyp_words: Column) -> Column:
    """Error rate of one utterance; an empty reference scores 0 or 1."""
    return (
        F.when(ref_words > 0, edits / F.nullif(ref_words, F.lit(0)))
        .when(hyp_words == 0, F.lit(0.0))
        .otherwise(F.lit(1.0))
    )

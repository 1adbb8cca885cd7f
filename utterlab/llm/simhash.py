"""SimHash near-dedup by a self-join of a binary trie over fingerprints.

A document's fingerprint holds, per bit, the majority of the XXH64 values of its word
shingles. Two fingerprints link when they differ in at most ``budget`` bits.

The self-join walks pairs of trie nodes together: a pair starts as (root, root), each step
reads one more bit, a step into unlike children costs one bit of the budget, and a pair that
has spent more than the budget is dropped. A node is a range of the sorted fingerprints, so a
whole frontier of pairs moves one level by a few array operations.

To spread the walk over tasks, the 64 bits are cut into ``budget + 2`` blocks. Two linked
fingerprints agree on at least two blocks, so every fingerprint joins one trie per pair of
blocks, and tries are split by the bits of these two blocks: below such a key the walk starts
with the key's levels already agreed. A key with more than ``cap`` fingerprints is cut into
parts that meet pairwise. Within a trie the budget grows from 1 to ``budget``, and node pairs
that earlier steps already joined as a whole are skipped, so dense families of near copies are
not compared pair by pair. A task returns stars (fingerprint, its smallest relative).

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; a
text with fewer words than a shingle is one shingle; rows of equal id are one node, whose texts
are all linked; a row of null id keeps its fingerprint, links nothing and has a null component;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.llm.components import components
from utterlab.llm.registry import query
from utterlab.llm.shared import written
from utterlab.llm.words import bounds, pieces

SHINGLE, SEED, BUDGET = 4, 42, 4
CAP = 1 << 15
_ROWS = 1 << 17
_FRONTIER = 1 << 19
_LINKS = 1 << 20
_SHINGLES = 1 << 16
_SALTS = 8

# --- fingerprints ------------------------------------------------------------------------


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, first word of each text): words lower-cased in A-Z,
    with one space between two words of a text."""
    data, _, starts, ends, first = bounds(column)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    word = np.cumsum(inside[:-1]) > 0
    keep = word | np.concatenate(([False], word[:-1]))
    at = np.cumsum(keep)
    text = np.where(word, data, np.uint8(32))[keep]
    return text.tobytes().lower(), at[starts] - 1, at[ends - 1], first


def fingerprint_column(column: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprints of a string column."""
    text, starts, ends, first = _joined(column)
    words = np.diff(first)
    n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    counts = np.zeros((len(words), 64), np.int64)
    doc = np.repeat(np.arange(len(words)), n)
    ahead = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[:-1][doc] + ahead
    end = begin + np.minimum(words[doc], size) - 1
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(doc), _SHINGLES):
        b = min(a + _SHINGLES, len(doc))
        spans = zip(starts[begin[a:b]].tolist(), ends[end[a:b]].tolist(), strict=True)
        hashes = np.array([digest(text[s:e], seed) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        # eight one-byte counters to a word, which hold for 255 rows
        change = np.flatnonzero(np.diff(doc[a:b])) + 1
        cuts = np.unique(np.concatenate((np.arange(0, b - a, 255), change)))
        sums = np.add.reduceat(bits.view(np.uint64), cuts, axis=0).view(np.uint8)
        np.add.at(counts, doc[a:b][cuts], sums)
    return np.packbits(2 * counts > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = fingerprint_column(part.column(1), size, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


# --- trie self-join ----------------------------------------------------------------------


class _Trie:
    """Tries over groups of sorted, distinct fingerprints, walked together."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.values = values
        self.label = np.arange(len(values))
        ends = np.append(starts[1:], len(values))
        wide = ends - starts > 1
        self.roots = (starts[wide], ends[wide])
        self.ones: dict[int, np.ndarray] = {}
        self._note()

    def _note(self) -> None:
        """Running number of label changes: a range without a change is one component."""
        self.changes = np.cumsum(np.concatenate(([0], self.label[1:] != self.label[:-1])))

    def _mid(self, level: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place of each range whose bit is set."""
        if level not in self.ones:
            bit = (self.values >> np.uint64(63 - level)) & np.uint64(1)
            self.ones[level] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32)
        ones = self.ones[level]
        return hi - (ones[hi] - ones[lo])

    def _merge(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, label[label]):
                label = label[label]
        self.label = label
        self._note()

    def walk(self, budget: int) -> None:
        """Joins what differs in at most ``budget`` bits."""
        lo, hi = self.roots
        stack = [(0, (lo, hi, lo, hi, np.zeros(len(lo), np.int64)))]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        while stack:
            level, pairs = stack.pop()
            if len(pairs[0]) > _FRONTIER:
                half = len(pairs[0]) // 2
                stack.append((level, tuple(x[half:] for x in pairs)))
                pairs = tuple(x[:half] for x in pairs)
            links, pairs = self._step(level, pairs, budget)
            if len(links[0]):
                found.append(links)
                held += len(links[0])
            if len(pairs[0]):
                stack.append((level + 1, pairs))
            if held > _LINKS or (not stack and held):
                self._merge(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found, held = [], 0

    def _step(self, level: int, pairs: tuple, budget: int) -> tuple[tuple, tuple]:
        """Links between single leaves, and the node pairs one level down."""
        alo, ahi, blo, bhi, spent = pairs
        one = (self.changes[ahi - 1] == self.changes[alo]) & (self.changes[bhi - 1] == self.changes[blo])
        go = ~(one & (self.label[alo] == self.label[blo]))
        alo, ahi, blo, bhi, spent = (x[go] for x in (alo, ahi, blo, bhi, spent))
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        i, j = alo[leaves], blo[leaves]
        near = np.bitwise_count(self.values[i] ^ self.values[j]) <= budget
        alo, ahi, blo, bhi, spent = (x[~leaves] for x in (alo, ahi, blo, bhi, spent))
        if not len(alo):
            return (i[near], j[near]), (alo, ahi, blo, bhi, spent)
        amid, bmid = self._mid(level, alo, ahi), self._mid(level, blo, bhi)
        same = alo == blo
        paid = spent < budget
        unlike = paid & ~same
        down = [
            (alo, amid, blo, bmid, spent, slice(None)),
            (amid, ahi, bmid, bhi, spent, slice(None)),
            (alo, amid, bmid, bhi, spent + 1, paid),
            (amid, ahi, blo, bmid, spent + 1, unlike),
        ]
        parts = [tuple(x[keep] for x in five) for *five, keep in down]
        whole = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        full = (whole[0] < whole[1]) & (whole[2] < whole[3])
        return (i[near], j[near]), tuple(x[full] for x in whole)


def near_labels(values: np.ndarray, starts: np.ndarray, budget: int) -> np.ndarray:
    """Place of the smallest relative of every value; ``starts`` begin the groups."""
    trie = _Trie(values, starts)
    for spend in range(1, budget + 1):
        trie.walk(spend)
    return trie.label


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` blocks that share out 64 bits."""
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    return [(64 - sum(widths[: k + 1]), w) for k, w in enumerate(widths)]


def _keys(budget: int) -> Column:
    """(trie, key) of every pair of blocks."""
    out = []
    for t, ((s1, w1), (s2, w2)) in enumerate(combinations(_blocks(budget + 2), 2)):
        high = F.shiftrightunsigned("fp", s1).bitwiseAND(F.lit((1 << w1) - 1))
        low = F.shiftrightunsigned("fp", s2).bitwiseAND(F.lit((1 << w2) - 1))
        out.append(F.struct(F.lit(t).alias("trie"), F.shiftleft(high, w2).bitwiseOR(low).alias("key")))
    return F.explode(F.array(*out)).alias("k")


def near_pairs(distinct: DataFrame, budget: int = BUDGET, cap: int = CAP) -> DataFrame:
    """Edges (a, b) that connect what links among the distinct values of ``fp``."""
    keyed = distinct.select("fp", _keys(budget)).select("fp", "k.trie", "k.key")
    parts = F.ceil(F.col("n") / cap).cast("int")
    large = keyed.groupBy("trie", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    large = written(large.select("trie", "key", parts.alias("parts")), "simhash-large")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = (
        keyed.join(large, ["trie", "key"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .select("fp", "trie", "key", mine.alias("mine"), other.alias("other"))
        .select(
            "trie", "key", F.least("mine", "other").alias("low"),
            F.greatest("mine", "other").alias("high"), "fp",
        )
    )
    group = ["trie", "key", "low", "high"]
    flipped = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # signed order of the unsigned value
    sorted_ = spread.repartition(*group).sortWithinPartitions(*group, flipped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            columns = [batch.column(k).to_numpy().astype(np.int64) for k in range(5)]
            held.append(np.stack(columns))
            size += batch.num_rows
            if size >= _ROWS:
                rows = np.concatenate(held, axis=1)
                last = _starts(rows)[-1]
                if last:
                    yield from _stars(rows[:, :last], budget)
                held, size = [rows[:, last:]], rows.shape[1] - last
        if size:
            yield from _stars(np.concatenate(held, axis=1), budget)

    return sorted_.mapInArrow(run, "a long, b long")


def _starts(rows: np.ndarray) -> np.ndarray:
    change = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
    return np.flatnonzero(np.concatenate(([True], change)))


def _stars(rows: np.ndarray, budget: int) -> Iterator[pa.RecordBatch]:
    label = near_labels(rows[4].view(np.uint64), _starts(rows), budget)
    moved = np.flatnonzero(label != np.arange(len(label)))
    arrays = [pa.array(rows[4][moved]), pa.array(rows[4][label[moved]])]
    yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    seed: int = SEED,
    budget: int = BUDGET,
    cap: int = CAP,
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: smallest id reachable) per row."""
    rows = written(fingerprints(docs, id_col, text, size, seed), "simhash-rows")
    known = rows.where("id IS NOT NULL")
    first = known.groupBy("fp").agg(F.min("id").alias("first"))
    nodes = written(first, "simhash-nodes")
    several = (
        known.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    )
    shared = known.join(several.select("id", "a"), "id").select("a", F.col("fp").alias("b"))
    joined = components(near_pairs(nodes.select("fp"), budget, cap).unionAll(shared))
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("group"), "first"
    )
    lowest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    by_fp = named.join(lowest, "group").select("fp", "component_id")
    # copies of one text may be many: their side is salted, the other repeated per salt
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
    spread = by_fp.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(spread, ["fp", "salt"], "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )


@query("op13_simhash_dedup")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have fingerprints that differ in few bits?"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs)

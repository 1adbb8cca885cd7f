"""Benchmark decontamination by spaced seeds.

A spaced seed hashes the words at the set places of a fixed mask and ignores the others,
so a substitution under a free place does not hide a match. Seeds of test and training
texts are joined by hash; around every hit both texts are compared word by word on the
same diagonal, and any stretch counts that holds at least ``min_words`` words (or the whole
item, if shorter), of which at least ``min_share`` are equal. Of the longest stretch and the
best-scoring one the one with more equal words is reported.

The test set is the stated query set. It is cut into blocks of about ``block_bytes`` of
text, and each block's index goes to every task, so memory has a bound at any size of the
test set and training texts are never shuffled: a further block is a further scan. What a
block gave is written before the next is collected.

Defined cases: words are lower-cased (A-Z); null or blank texts match nothing; an item
shorter than a mask is one seed of all its words; repeated items or documents are reported
each; a null id is kept; with an empty test set nothing is found.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.llm.registry import query
from utterlab.llm.shared import written
from utterlab.llm.words import U64, Words, longest, mix, pieces, words

MASKS = (
    (0, 1, 2, 4, 5, 7),
    (0, 1, 3, 4, 7, 8),
    (0, 2, 3, 6, 8, 9),
    (0, 1, 4, 6, 9, 10),
)
MIN_WORDS, MIN_SHARE = 13, 0.8
_FLAG_BITS = 22


def _seeds(w: Words, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of the mask at every place where it lies within one text."""
    n = len(w.hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, U64(len(mask) * 64 + mask[-1]))
    for k in mask:
        h = h * U64(0x9FB21C651E98DF25) + w.hashes[k : k + n]
        h ^= h >> U64(31)
    doc = w.doc
    inside = np.flatnonzero(doc[:n] == doc[mask[-1] :])
    return mix(h[inside]), inside


def _stretches(same: np.ndarray, lose: float, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words with surplus: the longest that starts and ends
    with an equal word, the best-scoring one, or else the longest at all."""
    if len(same) < least:
        return []
    run = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -lose))))
    match, every = np.flatnonzero(same), np.arange(len(run))
    lowest = np.minimum.accumulate(run)
    end = int(np.argmax(run - lowest))
    start = int(np.flatnonzero(run[: end + 1] == lowest[end])[-1])
    tests = [t for t in (longest(run, match, match + 1), (start, end)) if t[1] - t[0] >= least]
    return tests or [t for t in [longest(run, every, every)] if t[1] - t[0] >= least]


class SeedIndex:
    """Sorted seeds of one block of test texts."""

    def __init__(self, texts: pa.Array, masks: tuple[tuple[int, ...], ...] = MASKS):
        self.words = words(texts)
        sizes = self.words.counts
        short = sorted({int(n) for n in sizes if 0 < n <= min(m[-1] for m in masks)})
        self.masks = [(m, None) for m in masks] + [(tuple(range(n)), n) for n in short]
        self.seeds = []
        for mask, only in self.masks:
            h, at = _seeds(self.words, mask)
            if only is not None:
                whole = sizes[self.words.doc[at]] == only
                h, at = h[whole], at[whole]
            order = np.argsort(h, kind="stable")
            flag = np.zeros(1 << _FLAG_BITS, bool)
            flag[h >> U64(64 - _FLAG_BITS)] = True
            self.seeds.append((h[order], at[order], flag))

    def diagonals(self, w: Words) -> np.ndarray:
        """Distinct (text, item, diagonal) rows hit by any seed."""
        found = []
        item_of, doc_of = self.words.doc, w.doc
        for (mask, _), (keys, places, flag) in zip(self.masks, self.seeds, strict=True):
            if not len(keys):
                continue
            h, at = _seeds(w, mask)
            near = flag[h >> U64(64 - _FLAG_BITS)]
            h, at = h[near], at[near]
            low, high = (np.searchsorted(keys, h, side) for side in ("left", "right"))
            n = high - low
            there = np.repeat(at, n)
            begin = np.repeat(low - (np.cumsum(n) - n), n)
            item_at = places[np.arange(len(there)) + begin]
            rows = np.stack([doc_of[there], item_of[item_at], there - item_at], 1)
            found.append(np.unique(rows, axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def overlaps(self, w: Words, min_words: int, min_share: float) -> Iterator[tuple]:
        """(text, item, first word, words, equal words) of the best stretch per pair."""
        best: dict[tuple[int, int], tuple] = {}
        lose = min_share / (1 - min_share)
        for doc, item, shift in self.diagonals(w):
            a, b = self.words.first[item], self.words.first[item + 1]
            low = max(a, w.first[doc] - shift)
            high = min(b, w.first[doc + 1] - shift)
            same = self.words.hashes[low:high] == w.hashes[low + shift : high + shift]
            for start, end in _stretches(same, lose, min(min_words, b - a)):
                equal, n = int(same[start:end].sum()), end - start
                if equal >= min_share * n - 1e-9:
                    first = int(low + start + shift - w.first[doc])
                    key, value = (int(doc), int(item)), (equal, -first, n)
                    best[key] = max(best.get(key, value), value)
        for (doc, item), (equal, first, n) in sorted(best.items()):
            yield doc, item, -first, n, equal


def blocks(tests: DataFrame, id_col: str, text: str, block_bytes: int) -> Iterator[tuple[pa.Table, bool]]:
    """The test set in blocks of about ``block_bytes`` of text each, collected one by one,
    and whether a further block follows."""
    wanted = tests.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = -(-size // block_bytes)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(count, 1)))
    for i in range(count):
        yield wanted.where(block == i).toArrow(), i + 1 < count


def _packed(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


_INDEX: dict[bytes, tuple[pa.Table, SeedIndex]] = {}


def _index(raw: bytes) -> tuple[pa.Table, SeedIndex]:
    """The block's index, built once per process."""
    if raw not in _INDEX:
        _INDEX.clear()
        table = pa.ipc.open_stream(raw).read_all()
        _INDEX[raw] = (table, SeedIndex(table.column("text")))
    return _INDEX[raw]


def find_overlaps(
    docs: DataFrame,
    tests: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_share: float = MIN_SHARE,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """(document, item, start_word, n_words, equal_words): one row per contaminated pair."""
    kinds = docs.schema[doc_id].dataType.simpleString(), tests.schema[item_id].dataType.simpleString()
    schema = (
        f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]},"
        " start_word long, n_words long, equal_words long"
    )

    def scan(raw: bytes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, index = _index(raw)
            for batch in batches:
                for part in pieces(batch, "__text"):
                    rows = list(index.overlaps(words(part.column("__text")), min_words, min_share))
                    took = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
                    columns = [part.column("__id").take(took[0])]
                    columns.append(table.column("id").combine_chunks().take(took[1]))
                    yield pa.RecordBatch.from_arrays(
                        [*columns, *took[2:]],
                        [doc_id, item_id, "start_word", "n_words", "equal_words"],
                    )

        return run

    wanted = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    out = None
    for table, more in blocks(tests, item_id, text, block_bytes):
        found = wanted.mapInArrow(scan(_packed(table)), schema)
        found = written(found, "overlaps") if more else found
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(
    docs: DataFrame,
    tests: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_share: float = MIN_SHARE,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, in one pass per block."""

    def keep(raw: bytes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, index = _index(raw)
            for batch in batches:
                for part in pieces(batch, text):
                    found = index.overlaps(words(part.column(text)), min_words, min_share)
                    clean = np.ones(len(part), bool)
                    clean[[r[0] for r in found]] = False
                    yield part.filter(pa.array(clean))

        return run

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for table, more in blocks(tests, item_id, text, block_bytes):
        docs = docs.mapInArrow(keep(_packed(table)), kinds)
        docs = written(docs, "clean") if more else docs
    return docs


@query("op4_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold passages of the benchmark?"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_overlaps(docs, tests)

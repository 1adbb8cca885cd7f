"""Packing tokenised documents into fixed windows by minimum bin slack.

Documents are cut into full windows and one remainder. Only the histogram of remainder
lengths decides the packing: at most ``capacity`` numbers whatever the corpus. Starting
from the longest length left, a bitset dynamic program over the lengths still in stock
finds the multiset that fills the window closest to capacity, backtracking yields the
counts, and that pattern is used as often as the stock allows. Every remainder then gets
the place its rank among equal lengths has in the plan, so documents never meet in a task.

Ranks come from two levels (``utterlab.operators.scan``): a length that holds a third of
all rows is still spread over buckets.

Defined cases: a null text is empty and packs as its end token; rows of equal id are told
apart by their content and, if equal in that too, take places in any order (their pieces
are alike); an empty table gives no pieces; further columns can be carried by the caller.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from utterlab.llm.registry import query
from utterlab.llm.shared import arrow_rows, written
from utterlab.llm.words import bounds, hash_spans
from utterlab.llm.words import pieces as slices
from utterlab.operators.scan import ranked

CAPACITY = 2048
END_ID = 1
_CACHE_WORDS = 400_000
_SLICE = 1 << 19


# --- tokens ------------------------------------------------------------------------------


class WordTokens:
    """Ids of a tokenizer that drops white space, looked up per distinct word.

    White space separates tokens in such a tokenizer, so the ids of a text are those of its
    words in turn, and after a word of ASCII letters trailing punctuation starts a token of
    its own. Words are told apart by 64-bit hashes (``utterlab.llm.words``), encoded once
    per process, and kept in flat arrays.
    """

    def __init__(self, path: str):
        # threads of its own would keep memory of their own in every Python worker
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        """Forgets all words."""
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used, self.count = 0, 0

    def _add(self, keys: np.ndarray, found: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[self.count + 1 : self.count + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        at = np.searchsorted(self.keys, keys)
        self.where = np.insert(self.where, at, self.count + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.used, self.count = self.used + len(flat), self.count + len(sizes)

    def _encode(self, units: list[str]) -> list[list[int]]:
        tokenize, out = self.tokenizer.model.tokenize, []
        plain = [u.isascii() and u.isalpha() for u in units]
        rest = [u for u, p in zip(units, plain, strict=True) if not p]
        hard = iter(self.tokenizer.encode_batch(rest, add_special_tokens=False) if rest else [])
        for unit, p in zip(units, plain, strict=True):
            # ASCII letters pass the normaliser and the splitter as one lower-case piece
            out.append([t.id for t in tokenize(unit.lower())] if p else next(hard).ids)
        return out

    def lookup(self, keys: np.ndarray, units: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Place of each distinct (sorted) key in ``starts``; ``units`` gives their texts."""
        if self.count > _CACHE_WORDS:
            self.clear()
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            missing = np.flatnonzero(self.keys[near] != keys)
        else:
            missing = np.arange(len(keys))
        if len(missing):
            self._add(keys[missing], self._encode(units(missing)))
        return self.where[np.searchsorted(self.keys, keys)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        data, offsets, starts, ends, first = bounds(texts)
        starts, ends, first, folded = _units(data, starts, ends, first)
        h = np.where(
            folded, hash_spans(data, starts, ends, True), ~hash_spans(data, starts, ends, False)
        )
        keys, example, inverse = np.unique(h, return_index=True, return_inverse=True)

        raw, begin, end = data.tobytes(), starts[example], ends[example]

        def units(which: np.ndarray) -> list[str]:
            spans = zip(begin[which].tolist(), end[which].tolist(), strict=True)
            return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in spans]

        at = self.lookup(keys, units)[inverse]
        sizes = self.starts[at + 1] - self.starts[at]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids[_spans(self.starts[at], sizes)], upto[first]


_TAIL = np.zeros(256, bool)
_TAIL[list(b".,!?;:%&$*#")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple:
    """Splits trailing punctuation off words of ASCII letters, whose case does not count.

    Returns starts, ends, the bounds of each text, and whether case is to be folded.
    """
    if not len(starts):
        return starts, ends, first, np.zeros(0, bool)
    last = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))
    heads = np.maximum(last[ends - 1] + 1, starts)
    other = np.concatenate(([0], np.cumsum(~_LETTER[data])))
    plain = (heads > starts) & (other[heads] == other[starts])
    split = plain & (heads < ends)
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(split)[:-1]))
    n = len(starts) + int(split.sum())
    out_start, out_end, folded = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    out_start[place], out_end[place] = starts, np.where(split, heads, ends)
    folded[place] = plain
    tail = place[split] + 1
    out_start[tail], out_end[tail] = heads[split], ends[split]
    moved = np.concatenate((place, [n]))
    return out_start, out_end, moved[first], folded


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1, one span after another."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_TOKENS: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def tokenised_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, start, length, ids, doc_tokens): full windows and the remainder of every text.

    ``ids`` are little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, turn = _tokens(tokenizer), itertools.count(1)
        for batch in batches:
            for part in slices(batch, "__text", _SLICE):
                ids, at = coder.encode(part.column("__text"))
                counts = np.diff(at) + 1
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                base = np.concatenate(([0], np.cumsum(counts)))
                cuts = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), cuts)
                k = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = k * capacity
                length = np.minimum(counts[row] - start, capacity)
                raw = pa.py_buffer(ids.tobytes())
                begin = base[row] + start
                ends = np.concatenate((begin, [base[-1]])) * 4  # pieces are contiguous
                blobs = pa.Array.from_buffers(
                    pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), raw]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id").take(pa.array(row)),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        blobs,
                        pa.array(counts[row], pa.int64()),
                    ],
                    [id_col, "start", "length", "ids", "doc_tokens"],
                )
            if next(turn) % 16 == 0:
                _give_back()
        # workers outlive their task: an idle one keeps the tokenizer alone
        coder.clear()
        _give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long"
    )


# --- plan --------------------------------------------------------------------------------


def _closest(stock: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths, within stock, whose sum comes closest to ``room`` from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(stock, reverse=True):
        if length > room:
            continue
        left, take = min(stock[length], room // length), 1
        while left > 0:  # copies in powers of two
            copies = min(take, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left, take = left - copies, take * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + copies
            total -= length * copies
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) pairs that use up the histogram; a pattern counts lengths."""
    stock = {k: v for k, v in histogram.items() if v}
    plan = []
    while stock:
        longest = max(stock)
        stock[longest] -= 1
        fill = _closest({k: v for k, v in stock.items() if v}, capacity - longest)
        stock[longest] += 1
        pattern = dict(fill)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(stock[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            stock[k] -= n * times
            if not stock[k]:
                del stock[k]
        plan.append((pattern, times))
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Runs of ranks: (key, first rank, copies per window, first window, offset)."""
    used: dict[int, int] = {}
    runs, window = [], 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            runs.append((length, used.get(length, 0), copies, window, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        window += times
    runs.sort()
    return tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else ()


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) plus ``sequence_id`` and ``offset``."""
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # <= capacity rows
    plan = minimum_bin_slack({r["length"]: r["n"] for r in counted}, capacity)
    places = _places(plan)
    spread = F.pmod(F.xxhash64(*order), F.lit(_buckets(pieces, sum(r["n"] for r in counted))))
    by_rank = ranked(pieces, ["length"], spread, list(order), "__rank")
    schema = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])

    @F.pandas_udf(schema)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, first, copies, window, offset = places
        scale = np.int64(1) << np.int64(48)
        at = np.searchsorted(size * scale + first, length.to_numpy() * scale + rank.to_numpy() - 1, "right") - 1
        past = rank.to_numpy() - 1 - first[at]
        return pd.DataFrame(
            {
                "sequence_id": window[at] + past // copies[at],
                "offset": offset[at] + past % copies[at] * length.to_numpy(),
            }
        )

    return by_rank.withColumn("__p", place("length", "__rank")).select(
        *pieces.columns, "__p.sequence_id", "__p.offset"
    )


def _buckets(pieces: DataFrame, rows: int, per_bucket: int = 50_000) -> int:
    """So many buckets per length that even one length with all rows stays spread."""
    return max(16, rows // per_bucket)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where does every piece of every document lie?"""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digest of the pieces (CRC of their ids) and their places."""
    pieces = tokenised_pieces(docs, tokenizer or default_tokenizer())
    with arrow_rows(docs.sparkSession, 500):
        digests = written(
            pieces.select(
                "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"
            ),
            "pieces",
        )
    return pack(digests, ["doc_id", "start", "ids_crc32"])

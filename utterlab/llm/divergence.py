"""Source divergence audit: which sources of a language use words unlike the others.

Terms are runs of letters (ASCII letters or anything beyond ASCII), lower-cased in A-Z. A
language keeps the terms that occur in at least ``min_docs`` of its rows. In a group (language,
source), and in a language as a whole, a kept term has the scaled, smoothed rate
``p = 1 + floor(10**9 * (count + 1) / (N + V))``; ``f = floor((p - q)**2 / q)`` compares two.

Both reports work on count cells instead of terms, since p depends on a count only:

* ``term``: the terms of a group are grouped by (group count, language count). f is taken once
  per cell, equal values are merged, and values are ranked by cumulative multiplicity; only the
  cells that reach the first ``top`` ranks are expanded into terms, in UTF-8 order.
* ``pair``: kept terms are dealt into blocks by hash, sources into blocks of ``side``. A task
  holds the counts of two source blocks over the terms of one block, a matrix of bounded size at
  a time, takes for each pair of sources the distinct cells (count, other count) with their
  multiplicity, and sums f over cells. Terms that neither block of sources has are added as one
  cell of two zeros. Work and output grow with the square of a language's sources, as asked.

Counting explodes no text: a task counts a slice of texts by 64-bit hashes, emits one row per
(group, term), and these are summed before and after one shuffle. All arithmetic is on integers.

Defined cases: null text, lang and source are ''; every row is a document, also rows of equal or
null id; a group without terms has pairs (value from its zero counts) and no terms; a language
without kept terms has pairs of value 0; a single source has none; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlab.llm.registry import query
from utterlab.llm.shared import written
from utterlab.llm.words import hash_spans, pieces, texts
from utterlab.operators.scan import first_k

MIN_DOCS, TOP, SIDE = 3, 200, 64
_CELLS = 1 << 20
_BLOCK_ROWS = 1 << 18
_PIECE = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


# --- counting ----------------------------------------------------------------------------


def _slice_counts(part: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a slice of texts."""
    groups = [(a, b) for a, b in zip(*(part.column(k).to_pylist() for k in range(2)), strict=True)]
    names = sorted(set(groups))
    place = {g: i for i, g in enumerate(names)}
    group = np.array([place[g] for g in groups], np.int64)
    data, offsets = texts(part.column(2))
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], ~letter[:-1])) if len(data) else letter
    after = np.concatenate((~letter[1:], [True])) if len(data) else letter
    starts = np.flatnonzero(letter & (before | edge[:-1]))
    ends = np.flatnonzero(letter & (after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    # rows without text share offsets; the last of equal offsets owns the bytes
    hashes = hash_spans(data, starts, ends, True)
    # rows, then groups, told apart within the hash order
    order = np.lexsort((row, group[row], hashes))
    h, g, r = hashes[order], group[row][order], row[order]
    new_term = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, bool)
    new_doc = np.concatenate(([True], r[1:] != r[:-1])) | new_term if len(h) else new_term
    at = np.flatnonzero(new_term)
    n = np.diff(np.append(at, len(h)))
    docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else n
    raw = data.tobytes().lower()
    spans = zip(starts[order[at]].tolist(), ends[order[at]].tolist(), strict=True)
    terms = [raw[a:b].decode("utf-8") for a, b in spans]
    lang, source = ([names[k][i] for k in g[at].tolist()] for i in range(2))
    arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(terms, pa.string())]
    arrays += [pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all texts of (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                yield _slice_counts(part)

    return (
        docs.select("lang", "source", "text")
        .mapInArrow(run, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + kept)), by long division in three steps."""
    over = F.greatest(total + kept, F.lit(1))
    left, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + _whole(left, over)
        left = left % over
    return out + 1


def _whole(a: Column, b: Column) -> Column:
    """Quotient of two longs, rounded down."""
    return F.call_function("div", a, b)


def _divergence(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), q)  # the square is at most 10**18


# --- reports -----------------------------------------------------------------------------


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, side: int = SIDE
) -> DataFrame:
    """(lang, source, part, item, value, rank) over (lang, source, text)."""
    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = written(term_counts(named), "term-counts")
    of_term = Window.partitionBy("lang", "term")
    spread = counts.select(
        "lang", "source", "term", "n",
        F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"),
    )
    kept = spread.where(F.col("lang_docs") >= min_docs).drop("lang_docs")
    kept = written(kept, "kept-terms")
    groups = written(_groups(named, kept), "term-groups")
    return _terms(kept, groups, top).unionByName(_pairs(kept, groups, side))


def _groups(named: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, vocabulary) of every group that occurs."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    words = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"))
    zero = F.lit(0).cast("long")
    return (
        named.groupBy("lang", "source").agg(F.lit(0).alias("none")).drop("none")
        .join(sizes, ["lang", "source"], "left")
        .join(words, "lang", "left")
        .select(
            "lang", "source", F.coalesce("total", zero).alias("total"),
            F.coalesce(F.sum("total").over(Window.partitionBy("lang")), zero).alias("lang_total"),
            F.coalesce("vocabulary", zero).alias("vocabulary"),
        )
    )


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    group = ["lang", "source"]
    cells = kept.groupBy(*group, "n", "lang_n").agg(F.count(F.lit(1)).alias("many"))
    p = _rate(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = _rate(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    valued = (
        cells.join(groups, group)
        .select(*group, "n", "lang_n", "many", p.alias("p"), q.alias("q"))
        .where("p > q")
        .select(*group, "n", "lang_n", "many", _divergence(F.col("p"), F.col("q")).alias("value"))
    )
    valued = written(valued, "term-cells")
    merged = valued.groupBy(*group, "value").agg(F.sum("many").alias("many"))
    # the first ranks lie within the first ``top`` values, each held by a term or more
    highest = first_k(merged, group, [F.desc("value")], top)
    ahead = Window.partitionBy(*group).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        highest.withColumn("ahead", F.coalesce(F.sum("many").over(ahead), F.lit(0)))
        .where(F.col("ahead") < top)
        .select(*group, "value")
    )
    wanted = valued.join(reached, [*group, "value"]).select(*group, "n", "lang_n", "value")
    expanded = kept.join(wanted, [*group, "n", "lang_n"]).select(*group, "term", "value")
    order = [F.desc("value"), F.asc("term")]
    first = first_k(expanded, group, order, top)
    return first.select(
        *group, F.lit("term").alias("part"), F.col("term").alias("item"), "value",
        F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("rank"),
    )


def _pairs(kept: DataFrame, groups: DataFrame, side: int) -> DataFrame:
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    source_blocks = -(-widest // side) if widest else 1
    term_blocks = max(32, kept.count() // _BLOCK_ROWS + 1)
    mine = F.pmod(F.xxhash64("source"), F.lit(source_blocks)).cast("int").alias("mine")
    others = F.explode(F.sequence(F.lit(0), F.lit(source_blocks - 1))).alias("other")
    bounds = (F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    zero = F.lit(0).cast("long")
    block = F.pmod(F.xxhash64("term"), F.lit(term_blocks)).cast("int")
    rows = kept.select("lang", "source", "term", "n", zero.alias("total"), zero.alias("vocabulary"), block.alias("block"), mine)
    # every task of a language also gets all sources of its blocks, ahead of the counts
    heads = groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), zero.alias("n"), "total", "vocabulary",
        F.explode(F.sequence(F.lit(0), F.lit(term_blocks - 1))).alias("block"), mine,
    )
    task = ["lang", "block", "low", "high"]
    dealt = (
        heads.unionByName(rows)
        .select("*", others)
        .select("lang", "block", *bounds, "term", "source", "n", "total", "vocabulary", "mine")
        .repartition(*task)
        .sortWithinPartitions(*task, "term")
    )
    sums = dealt.mapInArrow(_pair_sums, "lang string, source string, item string, seen long, value decimal(38,0)")
    summed = sums.groupBy("lang", "source", "item").agg(
        F.sum("seen").alias("seen"), F.sum("value").alias("value")
    )
    here = groups.select("lang", "source", "total", "vocabulary")
    there = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    both = summed.join(here, ["lang", "source"]).join(there, ["lang", "item"])
    p = _rate(F.lit(0).cast("long"), F.col("total"), F.col("vocabulary"))
    q = _rate(F.lit(0).cast("long"), F.col("item_total"), F.col("vocabulary"))
    empty = (F.col("vocabulary") - F.col("seen")).cast("decimal(20,0)")
    unseen = F.when(empty > 0, empty * _divergence(p, q).cast("decimal(18,0)")).otherwise(F.lit(0))
    valued = both.select("lang", "source", "item", (F.col("value") + unseen).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return valued.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def rates(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of every count, exact while ``total + kept`` is below 10**15."""
    left, out, over = count.astype(np.int64) + 1, np.zeros(len(count), np.int64), total + kept
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // over
        left %= over
    return out + 1


class _PairTask:
    """Sums over one block of terms for the pairs of two blocks of sources."""

    def __init__(self, lang: str, one: bool):
        self.lang, self.one = lang, one
        self.place: dict[str, int] = {}
        self.totals: list[int] = []
        self.blocks: list[int] = []
        self.vocabulary = 0
        self.seen = 0
        self.sums: dict[tuple[int, int], int] = {}

    def source(self, name: str, total: int, vocabulary: int, block: int) -> None:
        self.place[name] = len(self.totals)
        self.totals.append(total)
        self.blocks.append(block)
        self.vocabulary = vocabulary

    def pairs(self) -> list[tuple[int, int]]:
        """Each pair once: across the two blocks, or within if they are one."""
        n = len(self.totals)
        return [
            (i, j) for i in range(n) for j in range(i + 1, n) if self.one or self.blocks[i] != self.blocks[j]
        ]

    def add(self, place: np.ndarray, term: np.ndarray, n: np.ndarray) -> None:
        """Counts (source, column of the term) of some whole terms."""
        width = int(term.max()) + 1
        counts = np.zeros((len(self.totals), width), np.int64)
        counts[place, term] = n
        self.seen += width
        codes, rate = [], []
        for row, total in zip(counts, self.totals, strict=True):
            values, code = np.unique(row, return_inverse=True)
            codes.append(code)
            rate.append(rates(values, total, self.vocabulary))
        for i, j in self.pairs():
            wide = len(rate[j])
            cell, many = np.unique(codes[i] * wide + codes[j], return_counts=True)
            p, q = rate[i][cell // wide], rate[j][cell % wide]
            square = (p - q) ** 2
            for a, b, over in ((i, j, q), (j, i, p)):
                f = square // over
                # halves of 31 bits keep the weighted sums within 64
                value = (int((f >> 31) @ many) << 31) + int((f & 0x7FFFFFFF) @ many)
                self.sums[a, b] = self.sums.get((a, b), 0) + value

    def rows(self) -> pa.RecordBatch:
        names = list(self.place)
        pairs = [x for i, j in self.pairs() for x in ((i, j), (j, i))]
        arrays = [
            pa.array([self.lang] * len(pairs), pa.string()),
            pa.array([names[a] for a, _ in pairs], pa.string()),
            pa.array([names[b] for _, b in pairs], pa.string()),
            pa.array([self.seen] * len(pairs), pa.int64()),
            pa.array([Decimal(self.sums.get(x, 0)) for x in pairs], pa.decimal128(38, 0)),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "item", "seen", "value"])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams tasks sorted by (lang, block, low, high, term), sources first."""
    now: tuple | None = None
    task = _PairTask("", True)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last, column, size = None, -1, 0

    def flush() -> None:
        nonlocal held, column, size, last
        if held:
            task.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held, column, size, last = [], -1, 0, None

    for batch in batches:
        cells = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        place, term, n = [], [], []
        for lang, block, low, high, word, source, count, total, vocabulary, mine in zip(*cells, strict=True):
            if (lang, block, low, high) != now:
                if place:
                    held.append(tuple(np.array(x, np.int64) for x in (place, term, n)))
                    place, term, n = [], [], []
                flush()
                if now is not None:
                    yield task.rows()
                now, task = (lang, block, low, high), _PairTask(lang, low == high)
            if word is None:
                task.source(source, total, vocabulary, mine)
                continue
            if word != last:
                if (column + 2) * len(task.totals) > _CELLS:
                    held.append(tuple(np.array(x, np.int64) for x in (place, term, n)))
                    place, term, n = [], [], []
                    flush()
                last, column = word, column + 1
            place.append(task.place[source])
            term.append(column)
            n.append(count)
        if place:
            held.append(tuple(np.array(x, np.int64) for x in (place, term, n)))
    flush()
    if now is not None:
        yield task.rows()


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts
  FROM documents
), t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(ln) AS n FROM k GROUP BY 1),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
g AS (
  SELECT d.lang, d.source, coalesce(any_value(s.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN s ON s.lang = d.lang AND s.source = d.source GROUP BY 1, 2
), r AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.ln,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.ln + 1)) // (v.n + v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT x.lang, x.source, y.source AS item,
    sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM r x JOIN r y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3
), allp AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
), allt AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM r WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM allp UNION ALL SELECT * FROM allt)
) WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources of a language differ most from the others, and by which words?"""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))

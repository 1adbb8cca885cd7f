"""Quality rules whose cutoffs come from labelled holdouts with exact risk control.

Each feature is divided by a fixed reference value; a document's ``risk`` is the largest
of these ratios. Per stratum the cutoff walks down a fixed grid. A step is accepted while
the exact binomial test rejects "more than ``alpha`` of clean documents lie above it" at
level ``delta`` / strata. Bonferroni over strata and fixed-sequence testing along the grid
bound the chance that any stratum rejects more than ``alpha`` of its clean documents by
``delta``. The grid and references are fixed beforehand, so all labelled rows are holdout.

Defined cases: a null text has no words; a null stratum is a stratum of its own; a stratum
without enough labels to accept any step keeps everything; null labels count for nothing;
a document labelled twice, or repeated, counts once per pair; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from utterlab.functions.stats import binomial_cdf
from utterlab.llm.registry import query
from utterlab.llm.shared import written
from utterlab.llm.words import U64, mix, pieces, windows, words

ALPHA, DELTA, TOLERANCE = 0.05, 0.05, 0.01
GRID = (4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0)
#: Share of words (or letters, or lines) at which a feature counts as fully suspicious.
REFERENCE = {
    "symbol_share": 0.10,
    "repeat_share": 0.20,
    "dup_line_share": 0.30,
    "upper_share": 0.30,
    "bang_share": 0.10,
}
_COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_lines long, n_letters long, n_upper long, n_bangs long"
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _UPPER | _table(bytes(range(97, 123)))
_BANG = _table(b"!")
_SPACE = _table(b" \t\n\x0b\x0c\r")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def _repeat_words(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that lie in a 3-word window found twice or more in the same text."""
    covered = np.zeros(len(hashes), bool)
    grams = windows(hashes, 3)
    if len(grams):
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        keys = mix(grams[inside] ^ mix(doc[inside].astype(np.uint64) + U64(1)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at = inside[twice]
        for k in range(3):
            covered[at + k] = True
    return _per_text(covered, first)


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    dup, total = [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        lines = [x for x in data[a:b].tobytes().split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
        total.append(len(lines))
    return dup, total


def count_features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every text beside the ``keep`` columns."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                w = words(part.column("__text"), lower=False)
                plain = ~_SPACE[w.data] & ((w.data & 0xC0) != 0x80)
                dup, lines = _dup_lines(w.data, w.offsets)
                made = [
                    w.counts,
                    _per_text(plain, w.offsets),
                    _per_text(_SYMBOLS[w.data], w.offsets),
                    dup,
                    _repeat_words(w.hashes, w.doc, w.first),
                    lines,
                    *(_per_text(t[w.data], w.offsets) for t in (_LETTER, _UPPER, _BANG)),
                ]
                names = [*keep, *(x.split()[0] for x in _COUNTS.split(","))]
                arrays = [part.column(c) for c in keep]
                arrays += [pa.array(x, pa.int64()) for x in made]
                yield pa.RecordBatch.from_arrays(arrays, names)

    wanted = docs.select(*keep, F.col(text).alias("__text"))
    return wanted.mapInArrow(run, f"{kinds}, {_COUNTS}" if kinds else _COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def risk() -> Column:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    shares = {
        "symbol_share": share("n_symbols", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "n_letters"),
        "bang_share": share("n_bangs", "n_words"),
    }
    return F.greatest(*[shares[k] / F.lit(v) for k, v in REFERENCE.items()])


def choose_cutoffs(
    holdout: DataFrame,
    stratum: str,
    score: str,
    clean: str,
    alpha: float = ALPHA,
    delta: float = DELTA,
    tolerance: float = TOLERANCE,
    grid: tuple[float, ...] = GRID,
) -> DataFrame:
    """(stratum, cutoff, n, false_rejections), one row per stratum.

    All accepted steps hold at once, so any of them may be picked: the mildest that
    rejects, but for ``tolerance``, as many unclean rows as the strictest accepted one.
    The holdout is reduced to one row per stratum by partial aggregation first.
    """
    rejected = lambda i: F.col(score) > grid[i]
    is_clean = F.col(clean).cast("boolean")
    steps = range(len(grid))
    counts = (
        holdout.where(is_clean.isNotNull())
        .groupBy(F.col(stratum).alias(stratum))
        .agg(
            F.count_if(is_clean).alias("n"),
            *[F.count_if(is_clean & rejected(i)).alias(f"k{i}") for i in steps],
            *[F.count_if(~is_clean & rejected(i)).alias(f"j{i}") for i in steps],
        )
    )
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))

    @F.pandas_udf(DoubleType())
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_cdf(int(a), int(b), alpha) for a, b in zip(k, n, strict=True)])

    tested, level = counts.crossJoin(F.broadcast(strata)), F.lit(delta) / F.col("strata")  # one row
    passed, most = F.lit(True), F.lit(0).cast("long")
    for i in steps:
        passed = passed & (F.col("n") > 0) & (tail(f"k{i}", "n") <= level)
        tested = tested.withColumn(f"p{i}", passed)
        passed = F.col(f"p{i}")
        most = F.when(passed, F.col(f"j{i}")).otherwise(most)
    enough = [passed_i & (F.col(f"j{i}") >= (1 - tolerance) * most) for i, passed_i in
              ((i, F.col(f"p{i}")) for i in steps)]
    pick = lambda values: F.coalesce(*[F.when(e, v) for e, v in zip(enough, values, strict=True)])
    return tested.select(
        stratum,
        pick([F.lit(c) for c in grid]).alias("cutoff"),
        "n",
        pick([F.col(f"k{i}") for i in steps]).alias("false_rejections"),
    )


def _grid_sql(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(i=i, c=c) for i, c in enumerate(GRID))


_COUNT_SQL = r"length(regexp_replace(t, '[^{0}]', '', 'g'))"

#: The binomial tail is a sum of logarithmic terms here, a continued fraction in Spark.
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, lang, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS tri
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1) GROUP BY 1
), f AS (
  SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    {_COUNT_SQL.format("#*$%&|<>")}::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    {_COUNT_SQL.format("A-Za-z")} AS n_letters, {_COUNT_SQL.format("A-Z")} AS n_upper,
    {_COUNT_SQL.format("!")} AS n_bangs
  FROM w LEFT JOIN r USING (doc_id)
), k AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    greatest(n_symbols / greatest(n_words, 1) / {REFERENCE["symbol_share"]},
      n_repeat_words / greatest(n_words, 1) / {REFERENCE["repeat_share"]},
      n_dup_lines / greatest(n_lines, 1) / {REFERENCE["dup_line_share"]},
      n_upper / greatest(n_letters, 1) / {REFERENCE["upper_share"]},
      n_bangs / greatest(n_words, 1) / {REFERENCE["bang_share"]}) AS risk FROM f
), c AS (
  SELECT lang, count(*) FILTER (WHERE quality = 1) AS n, count(*) OVER () AS strata,
    {_grid_sql("count(*) FILTER (WHERE quality = 1 AND risk > {c}) AS k{i}")},
    {_grid_sql("count(*) FILTER (WHERE quality = 0 AND risk > {c}) AS j{i}")}
  FROM k JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY lang
), u AS (
  SELECT lang, n, strata, unnest(range({len(GRID)})) AS i,
    unnest([{_grid_sql("k{i}")}]) AS wrong, unnest([{_grid_sql("j{i}")}]) AS junk,
    unnest([{_grid_sql("{c}::DOUBLE")}]) AS cut FROM c
), p AS (
  SELECT *, n > 0 AND list_sum(list_transform(range(wrong + 1), lambda x: exp(
      lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({ALPHA}) + (n - x) * ln(1 - {ALPHA}))))
    <= {DELTA} / strata AS ok FROM u WHERE n > 0
), q AS (
  SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY i) AS passed FROM p
), m AS (
  SELECT *, arg_max(junk, i) OVER (PARTITION BY lang) AS most FROM q WHERE passed
), x AS (
  SELECT lang, arg_min(cut, i) AS cutoff FROM m WHERE junk >= (1 - {TOLERANCE}) * most GROUP BY lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(risk > cutoff, false) AS kept
FROM k LEFT JOIN x ON k.lang IS NOT DISTINCT FROM x.lang
"""


@query("op9_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents pass the base rule and the risk-controlled cutoff of their language?"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    counted = written(
        count_features(docs, "text", ("doc_id", "lang"))
        .withColumn("base_failed", base_failed())
        .withColumn("risk", risk()),
        "quality",
    )
    holdout = counted.where("NOT base_failed").join(
        labels.where("quality IS NOT NULL"), "doc_id"
    )
    cutoffs = choose_cutoffs(holdout, "lang", "risk", "quality").select(
        F.col("lang").alias("__lang"), "cutoff"
    )
    judged = counted.join(cutoffs, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("risk") > F.col("cutoff"), F.lit(False))).alias(
            "kept"
        ),
    )

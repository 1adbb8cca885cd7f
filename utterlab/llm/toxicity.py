"""Toxicity scores from a character n-gram classifier with naive Bayes scaled features.

A feature is the presence of a hashed character n-gram in a lower-cased text. Its naive
Bayes log-count ratio r between the classes scales it, and a ridge logistic regression is
fitted on the scaled features. The fit reads a bounded sample of labelled rows (``sample``,
drawn by hash of the id, so the same rows at every partitioning) and keeps the ``features``
n-grams that separate the classes best in it. Counts are summed and ranked in tasks and the
sample is fitted by one, so only the kept features and their weights reach the driver. Scoring reads every text whole, in one pass without a shuffle.

Defined cases: a null text is empty; an empty text scores the intercept; without labelled
rows of both classes the score is the smoothed rate of the labels seen, 0.5 if none; null
labels are ignored; a document labelled twice counts twice; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.llm.registry import query
from utterlab.llm.shared import written

SIZES = (3, 4, 5, 6)
BITS = 20
_MULT = np.uint32(0x01000193)
_FINAL = np.uint32(0x9E3779B1)
_PIECE = 1 << 20


@dataclass
class Model:
    index: np.ndarray  # buckets of the kept n-grams, sorted
    weight: np.ndarray  # r times the fitted coefficient
    bias: float


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, between two spaces."""
    raw = f" {text.lower()} ".encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32)


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram at every place, one array per n-gram size."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(SIZES) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        h = h[:size] * _MULT + codes[n - 1 :]
        if n in SIZES:
            yield ((h ^ np.uint32(n * 0x27D4EB2F)) * _FINAL) >> np.uint32(32 - BITS)


def features(text: str, wanted: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text among those flagged in ``wanted``, in bounded memory."""
    codes, found, reach = _codes(text), [], max(SIZES) - 1
    for begin in range(0, len(codes), _PIECE):
        for b in _buckets(codes[begin : begin + _PIECE + reach]):
            found.append(np.unique(b[wanted[b]]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def is_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


# --- fitting -----------------------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(label, text) of about ``sample`` labelled rows, the same at any partitioning."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        "label IN (0, 1) AND doc_id IS NOT NULL"
    )
    rows = known.count()
    share = F.lit(int(min(1.0, sample / max(rows, 1)) * 2**32)).cast("long")
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2**32)) < share)
    # bounded by ``sample``: two numbers a row
    return docs.join(F.broadcast(drawn), "doc_id").select("label", "text")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    sample: int = 20_000,
    features_kept: int = 8_192,
    min_docs: int = 3,
    ridge: float = 1.0,
    parts: int = 8,
) -> Model:
    """Fits on (doc_id, text) joined with (doc_id, label)."""
    rows = _sample(docs, labels, label, sample).repartition(parts).persist()
    try:
        seen = np.zeros(2)
        for r in rows.groupBy("label").count().collect():
            seen[r["label"]] = r["count"]
        if not seen.all():
            rate = (seen[1] + 1) / (seen.sum() + 2)
            return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(rate / (1 - rate))))
        # counts are summed and ranked in tasks; the driver sees the features that are kept
        ranked = written(
            rows.mapInArrow(_count, "slice int, counts binary")
            .repartition(parts, "slice")
            .mapInArrow(_select(seen, min_docs), "bucket int, score double, clean long, bad long"),
            "toxicity-features",
        )
        all_slices = ranked.where("bucket < 0").agg(F.sum("clean"), F.sum("bad")).first()
        best = ranked.where("bucket >= 0").orderBy(F.desc("score"), "bucket").limit(features_kept)
        best = best.select("bucket", "clean", "bad").toPandas().sort_values("bucket")
        index = best["bucket"].to_numpy().astype(np.uint32)
        p, q = (best[c].to_numpy() + 1.0 for c in ("bad", "clean"))
        clean_all, bad_all = (float(x) + (1 << BITS) for x in all_slices)
        ratio = np.log((p / bad_all) / (q / clean_all))
        # a sample of bounded size, fitted where it lies: weights alone come back
        fitted = (
            rows.mapInArrow(_hits(index), "label int, hits binary")
            .coalesce(1)
            .mapInArrow(_fit_rows(ratio, ridge), "weight binary, bias double")
            .first()
        )
    finally:
        rows.unpersist()
    return Model(index, np.frombuffer(fitted["weight"], np.float64), fitted["bias"])


_SLICE = 14  # bits of a bucket within a slice of the count table


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class per bucket, in slices of the table."""
    total, every = np.zeros((2, 1 << BITS), np.int32), np.ones(1 << BITS, bool)
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[label][features(text or "", every)] += 1
    for i in range(1 << BITS - _SLICE):
        part = total[:, i << _SLICE : (i + 1) << _SLICE].tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["slice", "counts"]
        )


def _select(seen: np.ndarray, min_docs: int):
    """Buckets whose presence separates the classes, with their score and counts; a row of
    bucket -1 holds the sums of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(raw, np.int32).reshape(2, -1)
                slices[i] = slices.get(i, 0) + counts.astype(np.int64)
        for i, total in slices.items():
            share = (total + 1) / (seen[:, None] + 2)
            both = total.sum(axis=0)
            rate = np.clip(both / seen.sum(), 1e-9, 1 - 1e-9)
            score = (share[1] - share[0]) ** 2 / (rate * (1 - rate))
            at = np.flatnonzero((both >= min_docs) & (score > 0))
            columns = [np.append(-1, (i << _SLICE) + at), np.append(0.0, score[at])]
            columns += [np.append(total[c].sum(), total[c][at]) for c in (0, 1)]
            kinds = [pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
                ["bucket", "score", "clean", "bad"],
            )

    return run


def _hits(index: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[index] = True
        for batch in batches:
            found = [
                np.searchsorted(index, features(t or "", wanted)).astype(np.uint16).tobytes()
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary())], ["label", "hits"]
            )

    return run


def _fit_rows(ratio: np.ndarray, ridge: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, hits, sizes = [], [], []
        for batch in batches:
            labels.append(batch.column(0).to_numpy())
            for x in batch.column(1):
                hits.append(np.frombuffer(x.as_buffer(), np.uint16).copy())
                sizes.append(len(hits[-1]))
        y = np.concatenate(labels).astype(float) if labels else np.zeros(0)
        # rows in an order of their own, so that the fit does not follow the tasks' order
        order = sorted(range(len(y)), key=lambda i: (y[i], hits[i].tobytes()))
        at = np.concatenate([hits[i] for i in order]) if hits else np.zeros(0, np.uint16)
        row = np.repeat(np.arange(len(y), dtype=np.int32), [sizes[i] for i in order])
        del hits
        weight, bias = _regress(at, row, y[order], ratio, ridge)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["weight", "bias"]
        )

    return run


_STEP = 1 << 20


def _regress(
    at: np.ndarray, row: np.ndarray, y: np.ndarray, ratio: np.ndarray, ridge: float
) -> tuple[np.ndarray, float]:
    """Newton steps, each solved by conjugate gradients; returns scaled weights and bias.

    Hits (feature, row) are visited in stretches, so temporary arrays stay small.
    """
    width, parts = len(ratio), range(0, len(at), _STEP)

    def ahead(w: np.ndarray) -> np.ndarray:
        scaled, out = ratio * w[:-1], np.full(len(y), w[-1])
        for a in parts:
            out += np.bincount(row[a : a + _STEP], scaled[at[a : a + _STEP]], len(y))
        return out

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        for a in parts:
            out += np.bincount(at[a : a + _STEP], g[row[a : a + _STEP]], width)
        return np.append(ratio * out, g.sum())

    pull = np.append(np.full(width, ridge), 0.0)
    w = np.zeros(width + 1)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -40, 40)))
        gradient, curve = back(p - y) + pull * w, np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -gradient
        d, size = r.copy(), r @ r
        for _ in range(30):
            if size < 1e-10 * max(1.0, gradient @ gradient):
                break
            hd = back(curve * ahead(d)) + pull * d
            a = size / (d @ hd)
            step, r = step + a * d, r - a * hd
            size, old = r @ r, size
            d = r + size / old * d
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return ratio * w[:-1], float(w[-1])


# --- scoring -----------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1] in ``out``, which replaces a column of that name."""
    docs = docs.drop(out)
    index, weight, bias = model.index, model.weight, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[index] = True
        for batch in batches:
            found = []
            for value in batch.column(batch.schema.names.index(text)):
                hits = features(value.as_py() or "", wanted)
                found.append(bias + weight[np.searchsorted(index, hits)].sum())
            scores = 1 / (1 + np.exp(-np.clip(np.array(found, float), -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, out]
            )

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, `{out}` double")


THRESHOLD = 0.3


def train_from(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Fits on the labelled rows whose crc32(doc_id) mod 4 is not 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs.select("doc_id", "text"), labels.where(is_training(F.col("doc_id"))), "toxic")


@query("op3_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic is every document?"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_from(spark, docs, sf_dir)
    return score(docs, model).select(
        "doc_id",
        (~is_training(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

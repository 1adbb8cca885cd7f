"""Line dedup over content-defined chunks of lines.

Every line is hashed; a rolling hash over the last ``window`` line hashes closes a chunk
wherever it is 0 modulo ``divisor``, so a boundary depends on nearby lines only and an
insertion shifts no boundary further down. A chunk of two lines or more that occurs again
anywhere (an earlier document, or earlier in its own) is removed; the first occurrence, by
document id and place, stays. Hashes only propose: a chunk is removed after its bytes were
found equal to the first occurrence's.

Counting takes two longs per chunk through one shuffle, pre-aggregated. A bitmap of fixed
size over the repeated hashes keeps most other chunk texts out of the second shuffle.

Defined cases: a null text stays null and holds no chunk; empty lines are lines; a null id
sorts after all others; rows of equal id and text share one decision; a document of repeated
chunks only is left with an empty text; further columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.llm.membership import member_filter, slot, unpacked
from utterlab.llm.registry import query
from utterlab.llm.shared import written

WINDOW, DIVISOR = 3, 4
_BASE, _MASK = 1_000_003, (1 << 32) - 1


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunks(text: str, window: int = WINDOW, divisor: int = DIVISOR) -> Iterator[tuple[int, int, str]]:
    """(first line, number of lines, text) of each chunk of a text."""
    lines = text.split("\n")
    recent = [0] * window
    begin = 0
    for i, line in enumerate(lines):
        recent = [*recent[1:], line_hash(line.encode("utf-8", "surrogatepass"))]
        rolled = 0
        for h in recent:
            rolled = (rolled * _BASE + h) & _MASK
        if (rolled >> 8) % divisor == 0 or i == len(lines) - 1:
            yield begin, i + 1 - begin, "\n".join(lines[begin : i + 1])
            begin = i + 1


def _chunk_rows(
    docs: DataFrame, window: int, divisor: int, wanted: np.ndarray | None = None
) -> DataFrame:
    """(id, version, place, hash) of every chunk of two lines or more; with ``wanted``
    (``membership.member_filter``) also the texts, of chunks it lets pass."""
    with_text = wanted is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked(wanted) if with_text else None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            ids, versions, texts = (batch.column(i) for i in range(3))
            for id_, version, text in zip(ids.to_pylist(), versions.to_pylist(), texts, strict=True):
                if not text.is_valid:
                    continue
                for place, n, chunk in chunks(text.as_py(), window, divisor):
                    if n < 2:
                        continue
                    raw = chunk.encode("utf-8", "surrogatepass")
                    key = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)
                    for column, value in zip(out, (id_, version, place, key, chunk), strict=True):
                        column.append(value)
                    held += len(raw) if with_text else 40
                if held > 8 << 20:
                    yield _batch(out, batch.schema, flags)
                    out, held = [[], [], [], [], []], 0
            yield _batch(out, batch.schema, flags)

    kind = docs.schema["__id"].dataType.simpleString()
    schema = f"id {kind}, version long, place long, hash long" + ", chunk string" * with_text
    return docs.select("__id", "__version", "__text").mapInArrow(run, schema)


def _batch(out: list[list], schema: pa.Schema, flags: np.ndarray | None) -> pa.RecordBatch:
    kinds = [schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
    n = 4 if flags is None else 5
    names = ["id", "version", "place", "hash", "chunk"][:n]
    made = pa.RecordBatch.from_arrays([pa.array(out[i], kinds[i]) for i in range(n)], names)
    return made if flags is None else made.filter(pa.array(flags[slot(made.column("hash").to_numpy())]))


def repeated_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    divisor: int = DIVISOR,
) -> DataFrame:
    """(id, version, place) of every chunk whose bytes occurred before."""
    rows = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(text).alias("__version"), F.col(text).alias("__text")
    )
    # A repeat needs a hash seen twice; that many longs are all that is counted first.
    counted = (
        _chunk_rows(rows, window, divisor)
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("hash")
    )
    again = written(counted, "chunk-hashes")
    placed = F.struct(F.col("id").isNull().alias("none"), "id", "version", "place")
    salt = F.pmod(F.xxhash64("id", "version", "place"), F.lit(_SALTS)).cast("int")
    found = (
        _chunk_rows(rows, window, divisor, member_filter(again))
        .withColumn("salt", salt)
        .join(again.select("hash", F.explode(_salts()).alias("salt")).hint("merge"), ["hash", "salt"])
        .select("hash", "chunk", placed.alias("at"))
    )
    suspects = written(found, "chunks")
    # Grouping by the text itself is the comparison of bytes.
    first = (
        suspects.groupBy("hash", "chunk")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("hash", F.sha2("chunk", 256).alias("digest"), "first", F.explode(_salts()).alias("salt"))
    )
    return (
        suspects.select("hash", F.sha2("chunk", 256).alias("digest"), "at")
        .withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(_SALTS)).cast("int"))
        .join(first, ["hash", "digest", "salt"])
        .where(~F.col("at").eqNullSafe(F.col("first")))
        .select("at.id", "at.version", "at.place")
        .distinct()
    )


_SALTS = 8


def _salts() -> Column:
    return F.sequence(F.lit(0), F.lit(_SALTS - 1))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    divisor: int = DIVISOR,
) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, plus ``removed_chunks`` (array of
    first lines, null if none) and ``removed_lines``; columns of these names are replaced."""
    gone = (
        repeated_chunks(docs, id_col, text, window, divisor)
        .groupBy(F.col("id").alias("__gone_id"), F.col("version").alias("__gone_version"))
        .agg(F.array_sort(F.collect_list("place")).alias("__places"))
    )
    keyed = docs.drop("removed_chunks", "removed_lines").withColumn("__version", F.xxhash64(text))
    both = keyed.join(
        gone,
        F.col(id_col).eqNullSafe(F.col("__gone_id"))
        & (F.col("__version") == F.col("__gone_version")),
        "left",
    ).drop("__gone_id", "__gone_version", "__version")
    return _cut(both, text, window, divisor)


def _cut(docs: DataFrame, text: str, window: int, divisor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at, places = names.index(text), batch.column(names.index("__places")).to_pylist()
            texts, removed = batch.column(at).to_pylist(), []
            for i, (value, cut) in enumerate(zip(texts, places, strict=True)):
                gone = 0
                if value is not None and cut:
                    cut, kept = set(cut), []
                    for place, n, chunk in chunks(value, window, divisor):
                        if place in cut:
                            gone += n
                        else:
                            kept.append(chunk)
                    texts[i] = "\n".join(kept)
                removed.append(gone)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, pa.int64())], [*names, "__removed"]
            )

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return (
        docs.mapInArrow(run, f"{kinds}, `__removed` long")
        .withColumnRenamed("__places", "removed_chunks")
        .withColumnRenamed("__removed", "removed_lines")
    )


LINE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL
), h AS (
  SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS h0 FROM l
), w AS (
  SELECT *, coalesce(lag(h0, 1) OVER d, 0) AS h1, coalesce(lag(h0, 2) OVER d, 0) AS h2,
         lead(i) OVER d IS NULL AS last
  FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), e AS (
  SELECT *, last OR ((((((h2 * 1000003) % 4294967296 + h1) % 4294967296 * 1000003) % 4294967296 + h0)
                     % 4294967296) // 256) % 4 = 0 AS closes FROM w
), c AS (
  SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e
), g AS (
  SELECT doc_id, chunk, min(i) AS place, count(*) AS n,
         string_agg(line, chr(10) ORDER BY i) AS txt FROM c GROUP BY 1, 2
), r AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY txt, n >= 2 ORDER BY doc_id, place) > 1 AS gone FROM g
), k AS (
  SELECT doc_id, string_agg(txt, chr(10) ORDER BY place) FILTER (WHERE NOT gone) AS kept,
         coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS removed_lines,
         count(*) FILTER (WHERE gone) AS removed_chunks FROM r GROUP BY 1
)
SELECT d.doc_id, coalesce(k.removed_chunks, 0)::BIGINT AS removed_chunks,
  coalesce(k.removed_lines, 0)::BIGINT AS removed_lines,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.kept, '')) END::BIGINT AS kept_chars,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


@query("op5_line_dedup", LINE_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeated chunks of lines are gone?"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.coalesce(F.size("removed_chunks"), F.lit(0)).cast("long").alias("removed_chunks"),
        "removed_lines",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )

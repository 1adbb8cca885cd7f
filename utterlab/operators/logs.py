"""Append-only logs: latest record per key, work lists, consistency checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.sources.tables import small_side


def latest(log: DataFrame, keys: list[str], position: str = "ingest_pos") -> DataFrame:
    """The last written record of each key, by log position (not by clock).

    A hash-partitioned aggregate with a map-side partial: a key repeated a
    billion times still sends one record per task.
    """
    rest = [c for c in log.columns if c not in keys and c != position]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("__r"))
    return best.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def missing(wanted: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Work list: wanted keys without a record."""
    return wanted.join(log.select(*keys).distinct(), keys, "left_anti")


def pending_grid(
    examples: DataFrame, log: DataFrame, conditions: list[str], runs: int
) -> DataFrame:
    """Work list over language x example x condition x run.

    A cell is done once its latest record is scored; "incomplete" is retried.
    The grid is expanded in the row, so no product of tables is built.
    """
    keys = ["language", "example_id", "condition", "run"]
    grid = (
        examples.select("language", "example_id")
        .withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
        .withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    )
    done = latest(log.select(*keys, "outcome", "ingest_pos"), keys).where("outcome <> 'incomplete'")
    return missing(grid, done, keys)


def pending_verdicts(population: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items still to judge: scored and unparsed are done, incomplete is not."""
    done = latest(verdicts, ["key"]).where(F.col("status").isin("scored", "unparsed"))
    return missing(population, done, ["key"])


def reuse_transcripts(
    examples: DataFrame, log: DataFrame, keys: list[str], fresh: Column | None = None
) -> DataFrame:
    """Logged text where there is one, else ``fresh`` (null = still to transcribe)."""
    cached = latest(log, keys).select(*keys, F.col("raw_text").alias("__cached"))
    fallback = fresh if fresh is not None else F.lit(None).cast("string")
    return (
        examples.join(cached, keys, "left")
        .withColumn("reused", F.col("__cached").isNotNull())
        .withColumn("raw_text", F.coalesce("__cached", fallback))
        .drop("__cached")
    )


def append_log(log: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write new records and return the rejects (empty example_id), never dropped
    silently: the caller reports or stores them.

    Every append is a folder of its own, numbered on from those there, so that
    ``read_log`` can order records over appends. One writer appends at a time; rows of
    one append keep the order they have in ``ingest_pos``, else that of their partitions.
    """
    spark = log.sparkSession
    number = _appends(spark, path) + 1
    good = log.where(F.col("example_id").isNotNull() & (F.col("example_id") != ""))
    place = F.col("ingest_pos") if "ingest_pos" in log.columns else F.monotonically_increasing_id()
    writer = good.withColumn("append_pos", place).drop("ingest_pos").write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/append={number:09d}")
    return log.where(F.col("example_id").isNull() | (F.col("example_id") == ""))


def _appends(spark: SparkSession, path: str) -> int:
    """Number of the last append, from the folder names alone."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).agg(F.max("append")).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An appended log with ``ingest_pos``: later appends, then later rows, come last."""
    log = spark.read.parquet(path)
    return log.withColumn("ingest_pos", F.struct("append", "append_pos")).drop("append", "append_pos")


def with_task(outcomes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Outcomes beside their task; example ids repeat across languages."""
    return outcomes.join(manifest, ["language", "example_id"])


def drifted_rows(now: DataFrame, then: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows whose text changed since it was selected."""
    old = then.select(*keys, F.col(column).alias("__then"))
    return now.join(old, keys).where(~F.col(column).eqNullSafe(F.col("__then"))).drop("__then")


def one_sided(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only, with the side."""
    tagged = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        tagged.groupBy(*keys)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .where("l + r = 1")
        .select(*keys, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))
    )


def report_difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Largest absolute difference of two reports and whether they agree to 1e-12."""
    other = b.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    gap = F.greatest(
        *[F.abs(F.col(v).cast("double") - F.col(f"__{v}").cast("double")) for v in values],
        F.lit(0.0),
    )
    one_side = reduce(
        lambda x, y: x | y, [F.col(v).isNull() != F.col(f"__{v}").isNull() for v in values]
    )
    return (
        a.join(other, keys, "full")
        .agg(
            F.count(F.lit(1)).alias("n_compared"),
            F.coalesce(F.max(gap), F.lit(0.0)).alias("max_gap"),
            F.count_if(one_side).alias("n_one_sided"),
        )
        .withColumn("agrees", (F.col("max_gap") < 1e-12) & (F.col("n_one_sided") == 0))
    )


def fingerprint(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Order-free digest of a corpus: the sum of 60-bit row digests, and the count.

    The ordered digest of a joined text would need a single task; this one is a
    partial-then-final sum and is independent of order and partitioning.
    """
    digest = F.md5(F.concat_ws("|", F.col(id_column).cast("string"), F.col(text_column)))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    return texts.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(number).cast("string").alias("digest")
    )


def common_to_all(df: DataFrame, id_column: str, arm_column: str, arms: int) -> DataFrame:
    """Rows whose id every arm has."""
    everywhere = (
        df.groupBy(id_column, arm_column)
        .agg(F.lit(1).alias("one"))
        .groupBy(id_column)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == arms)
        .select(id_column)
    )
    return df.join(everywhere, id_column, "left_semi")


def strict_lookup(
    items: DataFrame, found: DataFrame, keys: list[str], column: str, small: bool = False
) -> DataFrame:
    """Left join that refuses a missing match when the row is used."""
    right = found.select(*keys, F.col(column))
    joined = items.join(small_side(right) if small else right, keys, "left")
    return joined.withColumn(
        column,
        F.when(F.col(column).isNull(), F.raise_error(F.lit(f"no {column} for an item"))).otherwise(
            F.col(column)
        ),
    )

"""Parquet tables and the one place that decides how many tasks read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.session import BROADCAST_LIMIT_ROWS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, tasks_per_core: int = 3) -> DataFrame:
    """Give CPU-heavy work several tasks per core.

    A file is cut into splits by its bytes, but only a split that holds the start of a row
    group has rows, so a few small or coarse files leave most cores idle. Inputs with enough
    splits (any large table) pass through untouched, so no shuffle is added.
    """
    tasks = tasks_per_core * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks)


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it is known to hold at most ``limit`` rows.

    The check reads at most ``limit + 1`` rows; beyond it the hint is dropped
    and Catalyst shuffles both sides instead.
    """
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def load_text_column(
    spark: SparkSession,
    paths: list[str],
    candidates: tuple[str, ...] = ("text", "transcript", "sentence", "normalized_text"),
) -> DataFrame:
    """Text of every file, whichever candidate column it is stored under.

    Each schema is read from the footer only; files are grouped by the column
    they offer, so the scan still reads that one column and nothing else.
    """
    by_column: dict[str, list[str]] = {}
    for path in paths:
        names = spark.read.parquet(path).columns
        chosen = next((c for c in candidates if c in names), None)
        if chosen is None:
            raise ValueError(f"none of {candidates} is a column of {path}; it has {sorted(names)}")
        by_column.setdefault(chosen, []).append(path)
    out: DataFrame | None = None
    for column, group in by_column.items():
        part = spark.read.parquet(*group).select(
            F.col("_metadata.file_path").alias("shard"),
            F.col("_metadata.row_index").alias("row"),
            F.col(column).cast("string").alias("text"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files given")
    return out


def corpus_rows(spark: SparkSession, path: str) -> DataFrame:
    """Corpus text with its metadata; the split comes from the shard's name."""
    scan = spark.read.parquet(path)
    extra = [
        F.col(c).cast("string").alias(c) if c in scan.columns else F.lit("").alias(c)
        for c in ("scenario", "task_name")
    ]
    shard = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    split = F.regexp_extract(F.col("_metadata.file_path"), r"([A-Za-z]+)-\d+-of-\d+", 1)
    return scan.select(
        split.alias("split"),
        shard.alias("shard"),
        F.col("_metadata.row_index").alias("row"),
        F.col("text").cast("string").alias("text"),
        *extra,
    )

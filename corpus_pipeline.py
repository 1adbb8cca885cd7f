"""Corpus pipeline: toxicity, line dedup, near-duplicate join, decontamination, packing.

Every stage reads all that its predecessor kept and, but for the last, returns the columns
of ``documents``. Defined cases are those of the operators; a null text is never toxic,
contaminated or a copy and packs as its end token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.llm.decontamination import decontaminate
from utterlab.llm.jaccard_join import near_duplicates
from utterlab.llm.line_dedup import dedup_lines
from utterlab.llm.packing import pack_documents
from utterlab.llm.shared import written
from utterlab.llm.toxicity import THRESHOLD, score, train_from

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores below its threshold."""
    scored = score(docs, train_from(spark, docs, sf_dir), out="__toxicity")
    return scored.where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks; a document that held nothing else goes."""
    cut = dedup_lines(docs)
    emptied = (F.col("removed_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    length = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return (
        cut.where(~F.coalesce(emptied, F.lit(False)))
        .withColumn("n_chars", length.cast("long"))
        .select(*docs.columns)
    )


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    groups = near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(written(groups, "copies"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document that is left."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Scores of a trained classifier are no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Readers for the evaluation logs. A reader keeps the position of every line, since
"latest" means last written, never last by clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = (
    "dataset string, example_id string, split string, stt string, model string, "
    "condition string, ground_truth_text string, raw_text string, run string"
)
OUTCOME = (
    "example_id string, language string, index int, condition string, run int, outcome string, "
    "tool_call variant, error_class string, model string, ts string"
)
VERDICT = (
    "key string, language string, example_id string, parameter string, equivalent boolean, "
    "status string, error_class string, model string, ts string"
)
LATENCY = (
    "uttid string, arm string, warmup boolean, clip_s double, endpoint_ms double, "
    "stt_ms double, llm_ms double, tts_ms double, total_ms double, clamped double, "
    "transcript_chars int, error string"
)
HYPOTHESIS = "uttid string, stt string, model string, raw_text string, rejected boolean"
TRANSCRIPT_KEY = ["dataset", "example_id", "stt", "model", "condition"]
OUTCOMES = ("pass", "fail", "incomplete")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Non-blank lines parsed by ``schema``, with ingest_pos and bad_line.

    ingest_pos orders by file, then by split, then by line: comparable across a
    whole log and independent of how splits are packed into tasks.
    """
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("ingest_pos"),
        "value",
    )
    return parse_lines(lines.where(F.trim("value") != ""), schema)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``value`` parsed by ``schema``; a line that is not JSON keeps its text in bad_line."""
    parsed = lines.withColumn(
        "r",
        F.from_json(
            "value",
            f"{schema}, bad_line string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"},
        ),
    )
    return parsed.select(*[c for c in lines.columns if c != "value"], "r.*")


def good_rows(log: DataFrame) -> DataFrame:
    return log.where("bad_line is null").drop("bad_line")


def rejected_rows(log: DataFrame) -> DataFrame:
    return log.where("bad_line is not null").select("ingest_pos", "bad_line")


Log = tuple[DataFrame, DataFrame]
"""(good rows, rejected lines): a reader never drops a line without handing it over."""


def split_log(log: DataFrame) -> Log:
    return good_rows(log), rejected_rows(log)


def read_transcripts(spark: SparkSession, path: str) -> Log:
    return split_log(json_lines(spark, path, TRANSCRIPT))


def with_outcome_defaults(log: DataFrame) -> DataFrame:
    """Missing error_class, model and ts become empty text."""
    return log.fillna("", ["error_class", "model", "ts"])


def read_outcomes(spark: SparkSession, path: str) -> Log:
    good, rejected = split_log(json_lines(spark, path, OUTCOME))
    return with_outcome_defaults(good), rejected


def read_verdicts(spark: SparkSession, path: str) -> Log:
    return split_log(json_lines(spark, path, VERDICT))


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LATENCY).json(path).fillna("", ["error"])


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HYPOTHESIS).json(path)


def keyed_text(line: Column) -> tuple[Column, Column]:
    """(id, text) of "id text", cut at the first blank."""
    return (
        F.regexp_extract(line, r"^(\S*) ?(.*)$", 1),
        F.trim(F.regexp_extract(line, r"^(\S*) ?(.*)$", 2)),
    )


def read_references(spark: SparkSession, path: str) -> Log:
    """Keyed texts; lines without an id are rejected."""
    uttid, text = keyed_text(F.col("value"))
    lines = spark.read.text(path).withColumns({"uttid": uttid, "text": text})
    return (
        lines.where("uttid <> ''").select("uttid", "text"),
        lines.where("uttid = ''").select(F.col("value").alias("bad_line")),
    )


def read_sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "seed int, max_seconds double, "
        "items array<struct<uttid:string,seconds:double,sample_rate_hz:int>>"
    )
    manifest = spark.read.schema(schema).option("multiLine", True).json(path)
    return manifest.select(F.posexplode("items").alias("ord", "item")).select("ord", "item.*")


def read_tool_tasks(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Tasks of one manifest (a JSON array), in file order; a task without exactly one
    expected call gets a null name and is left to the caller to reject."""
    from utterlab.operators.judging import array_params, expected_call

    schema = (
        "id string, query string, path string, functions variant, expected_tool_call variant"
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    functions = F.to_json("functions")
    call = expected_call(F.to_json("expected_tool_call"))
    return (
        raw.withColumn("call", call)
        .select(
            F.lit(language).alias("language"),
            F.col("id").alias("example_id"),
            "query",
            F.col("path").alias("audio_path"),
            functions.alias("functions_json"),
            F.col("call.name").alias("expected_name"),
            F.col("call.arguments").alias("expected"),
            F.monotonically_increasing_id().alias("ingest_pos"),
        )
        .withColumn("array_params", array_params(F.col("functions_json"), F.col("expected_name")))
    )


def read_label_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Human labels; the reader drops a byte-order mark on its own."""
    sheet = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    label = next(c for c in sheet.columns if c.startswith("label"))
    return sheet.withColumnRenamed(label, "label").withColumn("item", F.col("item").cast("int"))


LABEL_COLUMNS = [
    "item", "language", "user_query", "function", "parameter", "accepted_values",
    "returned_value", "label", "note",
]


def write_label_sheet(items: DataFrame, path: str) -> None:
    """Blank labelling sheet in the fixed column order; every part file has a header."""
    sheet = items.withColumns({"label": F.lit(""), "note": F.lit("")}).select(*LABEL_COLUMNS)
    sheet.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def unmatched_labels(labels: DataFrame, population: DataFrame, columns: list[str]) -> DataFrame:
    """Label rows whose text columns match no judged item."""
    return labels.join(population.select(*columns).distinct(), columns, "left_anti")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)

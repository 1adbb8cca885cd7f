"""Latency, session and sweep reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.operators.intervals import STAGES, TURN, stage_totals
from utterlab.operators.percentiles import percentiles
from utterlab.operators.scan import running_before
from utterlab.session import checkpoints
from utterlab.sources.tables import small_side

STAGE_MS = ("endpoint_ms", "stt_ms", "llm_ms", "tts_ms")

# Default latency budgets in milliseconds; "ttfa" is the overall target.
DEFAULT_BUDGETS = {"ttfa": 800.0, "endpoint": 300.0, "stt": 200.0, "llm": 300.0, "tts": 150.0}


def stage_split(instants: list[Column]) -> Column:
    """struct of the four stage durations, total_ms and clamped from five instants
    (ns); an instant before its predecessor is moved up to it."""
    fixed = [instants[0]]
    for point in instants[1:]:
        fixed.append(F.greatest(point, fixed[-1]))
    clamped = sum(
        (F.when(p < f, 1).otherwise(0) for p, f in zip(instants[1:], fixed, strict=False)),
        F.lit(0),
    )
    ms = [(b - a) / 1_000_000 for a, b in zip(fixed, fixed[1:], strict=False)]
    return F.struct(
        *[d.alias(n) for d, n in zip(ms, STAGE_MS, strict=True)],
        ((fixed[-1] - fixed[0]) / 1_000_000).alias("total_ms"),
        clamped.alias("clamped"),
    )


def latency_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """p50 / p90 of each stage and the total, warm-ups left out: keys + population,
    metric, n, p50, p90.

    Two populations: all completed turns, and those without a premature endpoint.
    """
    done = rows.where(~F.col("warmup") & F.coalesce(F.col("error") == "", F.lit(True)))
    metrics = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("ms"))
            for m in (*STAGE_MS, "total_ms")
        ]
    )
    populations = F.array_compact(
        F.array(F.lit("completed"), F.when(F.col("clamped") == 0, "no_premature_endpoint"))
    )
    long = done.select(*keys, F.explode(populations).alias("population"), metrics.alias("m")).select(
        *keys, "population", F.inline("m")
    )
    return percentiles(long, [*keys, "population", "metric"], "ms", {"p50": 50, "p90": 90}).drop(
        "max"
    )


def latency_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return (
        rows.where(~F.col("warmup"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.count_if(~failed).alias("n_completed"),
            F.count_if(failed).alias("n_failed"),
            F.count_if(~failed & (F.col("clamped") > 0)).alias("n_premature_endpoint"),
        )
    )


def session_percentiles(spans: DataFrame, times: DataFrame, as_of: Column | int) -> DataFrame:
    """Per session and stage: n, p50, p90, p99, max over its turns. A turn without the
    stage counts as 0 ms; "ttfa" only covers turns that have one."""
    totals = stage_totals(spans, as_of)
    per_turn = totals.groupBy(*TURN).agg(
        *[
            F.coalesce(F.max(F.when(F.col("stage") == s, F.col("total_ms"))), F.lit(0.0)).alias(s)
            for s in STAGES
        ]
    )
    wide = times.join(per_turn, TURN, "left").fillna(0.0, list(STAGES))
    long = wide.select(
        "session_id",
        F.inline(
            F.array(
                *[F.struct(F.lit(s).alias("stage"), F.col(s).alias("ms")) for s in STAGES],
                F.struct(F.lit("ttfa").alias("stage"), F.col("ttfa_ms").alias("ms")),
            )
        ),
    )
    found = percentiles(
        long, ["session_id", "stage"], "ms", {"p50_ms": 50, "p90_ms": 90, "p99_ms": 99}
    ).withColumnRenamed("max", "max_ms")
    silent = (
        times.groupBy("session_id")
        .agg(F.count("ttfa_ms").alias("k"))
        .where("k = 0")
        .select(
            "session_id",
            F.lit("ttfa").alias("stage"),
            F.lit(0).cast("bigint").alias("n"),
            *[F.lit(0.0).alias(c) for c in ("p50_ms", "p90_ms", "p99_ms", "max_ms")],
        )
    )
    return found.unionByName(silent)


def budget_table(spark: SparkSession, budgets: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(
        list((budgets or DEFAULT_BUDGETS).items()), "stage string, budget_ms double"
    )


def violations(totals: DataFrame, times: DataFrame, budgets: DataFrame) -> DataFrame:
    """Stages, and time to first audio, strictly over budget, with the excess."""
    actual = totals.select(*TURN, "stage", F.col("total_ms").alias("actual_ms")).unionByName(
        times.where("ttfa_ms is not null").select(
            *TURN, F.lit("ttfa").alias("stage"), F.col("ttfa_ms").alias("actual_ms")
        )
    )
    return (
        actual.join(small_side(budgets), "stage")
        .where(F.col("actual_ms") > F.col("budget_ms"))
        .withColumn("over_by_ms", F.col("actual_ms") - F.col("budget_ms"))
    )


def sweep_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per grid cell: corpus error rate, p50 / p90 of stt_ms, real-time factor, n.

    ``rows`` has edits, ref_words, stt_ms, audio_ms. They are read once: what the report needs
    of rows of equal stt_ms is kept, and every part of the report starts from that.
    """
    checkpoints(rows.sparkSession)
    summed = ("edits", "ref_words", "audio_ms")
    equal = (
        rows.groupBy(*keys, "stt_ms")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in summed])
        .checkpoint()
    )
    stt_ms = F.sum(F.col("stt_ms") * F.col("rows"))
    sums = equal.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("edits"), F.sum("ref_words")), F.lit(0.0)).alias("wer"),
        F.coalesce(F.try_divide(stt_ms, F.sum("audio_ms")), F.lit(0.0)).alias("realtime_factor"),
    )
    points = {"stt_p50_ms": 50, "stt_p90_ms": 90}
    spread_ = percentiles(equal, keys, "stt_ms", points, count="rows").drop("max")
    return sums.join(spread_.withColumnRenamed("n", "n_utterances"), keys)


def pareto_front(points: DataFrame, x: str = "wer", y: str = "stt_p50_ms") -> DataFrame:
    """Points no other beats on both axes (lower is better); equal points stay.

    A point survives when it has the least x of its y and no smaller y reaches
    that x: one prefix minimum over the distinct y values, in two levels of order-
    preserving buckets.
    """
    best = points.groupBy(y).agg(F.min(x).alias("__best"))
    front = running_before(
        best.withColumn("__all", F.lit(0)), ["__all"], F.floor(y), [y], -F.col("__best"), "max", "__low"
    ).select(y, "__best", (-F.col("__low")).alias("__below"))
    return (
        points.join(front, y)
        .where(
            (F.col(x) == F.col("__best"))
            & (F.col("__below").isNull() | (F.col("__below") > F.col("__best")))
        )
        .drop("__best", "__below")
    )


def choose_threshold(costs: DataFrame) -> DataFrame:
    """Threshold of least canonical_miss + corruption; ties take the higher one."""
    cost = F.col("canonical_miss") + F.col("corruption_rate")
    return costs.agg(
        F.min_by("threshold", F.struct(cost.alias("c"), (-F.col("threshold")).alias("t"))).alias(
            "threshold"
        ),
        F.min(cost).alias("cost"),
    )

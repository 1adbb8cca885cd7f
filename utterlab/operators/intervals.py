"""Interval union, turn timing and the critical path over span and mark tables.

Every step is an aggregate, a bucketed scan or a join on the turn key, so one
turn holding a large share of all spans is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlab.operators.scan import running_before
from utterlab.session import checkpoints

TURN = ["session_id", "turn_id"]
SLICE_NS = 60_000_000_000
STAGES = ("capture", "endpoint", "stt", "llm", "tool", "tts", "playback")


def _with_previous_end(spans: DataFrame, keys: list[str], as_of: Column | int) -> DataFrame:
    closed = spans.withColumn("end_ns", F.coalesce("end_ns", _lit(as_of)))
    return running_before(
        closed,
        keys,
        F.floor(F.col("start_ns") / SLICE_NS),
        ["start_ns", "end_ns"],
        F.col("end_ns"),
        "max",
        "prev_end",
    )


def _lit(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def merged(spans: DataFrame, keys: list[str], as_of: Column | int) -> DataFrame:
    """Overlapping or touching spans merged: keys + start_ns, end_ns, n_spans."""
    fresh = F.col("prev_end").isNull() | (F.col("start_ns") > F.col("prev_end"))
    marked = _with_previous_end(spans, keys, as_of).withColumn("fresh", fresh.cast("int"))
    numbered = running_before(
        marked,
        keys,
        F.floor(F.col("start_ns") / SLICE_NS),
        ["start_ns", "end_ns"],
        F.col("fresh"),
        "sum",
        "before",
    )
    island = (F.coalesce("before", F.lit(0)) + F.col("fresh")).alias("island")
    return (
        numbered.select(*keys, island, "start_ns", "end_ns")
        .groupBy(*keys, "island")
        .agg(
            F.min("start_ns").alias("start_ns"),
            F.max("end_ns").alias("end_ns"),
            F.count(F.lit(1)).alias("n_spans"),
        )
        .drop("island")
    )


def stage_totals(spans: DataFrame, as_of: Column | int, keys: list[str] | None = None) -> DataFrame:
    """Time covered by the spans of each (turn, stage), overlaps counted once; open
    spans end at ``as_of``."""
    keys = [*(keys or TURN), "stage"]
    scanned = _with_previous_end(spans, keys, as_of)
    start, end, prev = F.col("start_ns"), F.col("end_ns"), F.col("prev_end")
    added = F.when(prev.isNull() | (start > prev), end - start).otherwise(
        F.greatest(end - prev, F.lit(0))
    )
    return scanned.groupBy(*keys).agg((F.sum(added) / 1_000_000).alias("total_ms"))


def turn_times(spans: DataFrame, marks: DataFrame) -> DataFrame:
    """Per turn: t0 (last end-of-speech mark, else its first instant), time to first
    audio and total time, in milliseconds."""
    from_spans = spans.groupBy(*TURN).agg(
        F.min("start_ns").alias("s_first"), F.max("end_ns").alias("s_last")
    )
    speech = F.col("name") == "user_speech_end"
    audio = F.col("name") == "first_audio_out"
    from_marks = marks.groupBy(*TURN).agg(
        F.max_by(F.when(speech, F.col("at_ns")), F.when(speech, F.col("seq"))).alias("speech_ns"),
        F.min_by(F.when(audio, F.col("at_ns")), F.when(audio, F.col("seq"))).alias("audio_ns"),
        F.min("at_ns").alias("m_first"),
        F.max("at_ns").alias("m_last"),
    )
    both = from_spans.join(from_marks, TURN, "full")
    return both.select(
        *TURN,
        F.coalesce("speech_ns", F.least("s_first", "m_first")).alias("t0_ns"),
        "audio_ns",
        F.greatest("s_last", "m_last").alias("last_ns"),
    ).withColumns(
        {
            "ttfa_ms": (F.col("audio_ns") - F.col("t0_ns")) / 1_000_000,
            "total_ms": (F.col("last_ns") - F.col("t0_ns")) / 1_000_000,
        }
    )


def critical_path(spans: DataFrame, times: DataFrame) -> DataFrame:
    """Spans on the way from t0 to first audio (or to the last closed span).

    A cursor moves back per turn to the earliest start among the spans covering
    it, until it reaches t0, stops moving, or nothing covers it. All turns move
    together, one join and one partial aggregate per step; the number of steps is
    the depth of the deepest path.
    """
    checkpoints(spans.sparkSession)
    last_end = spans.groupBy(*TURN).agg(F.max("end_ns").alias("last_end"))
    cursors = (
        times.join(last_end, TURN)
        .select(*TURN, "t0_ns", F.coalesce("audio_ns", "last_end").alias("cursor"))
        .where(F.col("cursor") > F.col("t0_ns"))
        .checkpoint()
    )
    visited = cursors
    while not cursors.isEmpty():
        covering = spans.select(*TURN, "start_ns", "end_ns").join(cursors, TURN)
        covering = covering.where(
            (F.col("start_ns") <= F.col("cursor"))
            & (F.col("cursor") <= F.coalesce("end_ns", "cursor"))
        )
        cursors = (
            covering.groupBy(*TURN, "t0_ns", "cursor")
            .agg(F.min("start_ns").alias("next"))
            .where((F.col("next") < F.col("cursor")) & (F.col("next") > F.col("t0_ns")))
            .select(*TURN, "t0_ns", F.col("next").alias("cursor"))
            .checkpoint()
        )
        visited = visited.unionByName(cursors)
    seen = visited.select(*[F.col(k).alias(f"__{k}") for k in TURN], "cursor")
    return spans.join(
        seen,
        (F.col("session_id") == F.col("__session_id"))
        & (F.col("turn_id") == F.col("__turn_id"))
        & (F.col("start_ns") <= F.col("cursor"))
        & (F.col("cursor") <= F.coalesce("end_ns", "cursor")),
        "left_semi",
    )


def barge_ins(turns: DataFrame, speech_starts: DataFrame) -> DataFrame:
    """Speech starting while a turn runs: that turn is interrupted.

    Both sides are cut into time slices first, so the join is an equi-join on
    (session, slice) and a long session is spread over its slices.
    """
    slices = turns.withColumn(
        "slice",
        F.explode(
            F.sequence(
                F.floor(F.col("start_ns") / SLICE_NS), F.floor(F.col("end_ns") / SLICE_NS)
            )
        ),
    )
    starts = speech_starts.withColumn("slice", F.floor(F.col("at_ns") / SLICE_NS))
    return slices.join(starts, ["session_id", "slice"]).where(
        (F.col("at_ns") > F.col("start_ns")) & (F.col("at_ns") < F.col("end_ns"))
    ).drop("slice")

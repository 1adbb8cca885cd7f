"""Intervals, turn times, critical path, latency, endpointing."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from utterlab.operators import endpointing as ep
from utterlab.operators import intervals as iv
from utterlab.plans import timing

MS = 1_000_000
SPAN = "session_id long, turn_id string, stage string, start_ns long, end_ns long, seq long"
MARK = "session_id long, turn_id string, name string, at_ns long, seq long"


def spans(spark, rows):
    return spark.createDataFrame([(1, "t", s, a * MS, None if b is None else b * MS, i)
                                  for i, (s, a, b) in enumerate(rows)], SPAN)


def test_union_counts_overlap_once(spark):
    df = spans(spark, [("stt", 0, 300), ("stt", 100, 250), ("llm", 0, 10), ("llm", 10, 20), ("tts", 5, None)])
    got = {r.stage: r.total_ms for r in iv.stage_totals(df, 50 * MS).collect()}
    assert got == {"stt": 300.0, "llm": 20.0, "tts": 45.0}


def test_union_across_slices_equals_a_sweep(spark):
    rng = random.Random(1)
    minute = 60_000
    rows = [("stt", a := rng.randrange(0, 90 * minute), a + rng.randrange(0, 6 * minute)) for _ in range(400)]
    total, last = 0, -1
    for _, a, b in sorted(rows, key=lambda r: (r[1], r[2])):
        total += max(0, b - max(a, last))
        last = max(last, b)
    df = spans(spark, rows)
    assert iv.stage_totals(df, 0).first().total_ms == total
    merged = iv.merged(df, [*iv.TURN, "stage"], 0).collect()
    assert sum(r.end_ns - r.start_ns for r in merged) == total * MS
    assert sum(r.n_spans for r in merged) == 400


def test_turn_times(spark):
    marks = spark.createDataFrame(
        [(1, "t", "user_speech_end", 50 * MS, 0), (1, "t", "first_audio_out", 650 * MS, 1),
         (1, "t", "first_audio_out", 900 * MS, 2), (2, "u", "final_transcript", 5 * MS, 0)], MARK)
    got = {r.session_id: r for r in iv.turn_times(spans(spark, [("stt", 0, 80)]), marks).collect()}
    assert got[1].ttfa_ms == 600.0 and got[1].total_ms == 850.0
    assert got[2].ttfa_ms is None and got[2].t0_ns == 5 * MS


def test_critical_path(spark):
    df = spans(spark, [("stt", 0, 80), ("llm", 80, 780), ("tts", 80, 780), ("tool", 10, 20)])
    marks = spark.createDataFrame(
        [(1, "t", "user_speech_end", 0, 0), (1, "t", "first_audio_out", 380 * MS, 1)], MARK)
    times = iv.turn_times(df, marks)
    assert {r.stage for r in iv.critical_path(df, times).collect()} == {"stt", "llm", "tts"}
    gap = spans(spark, [("stt", 0, 80), ("llm", 100, 400)])
    assert {r.stage for r in iv.critical_path(gap, iv.turn_times(gap, marks)).collect()} == {"llm"}


def test_session_percentiles_count_a_missing_stage_as_zero(spark):
    df = spans(spark, [("stt", 0, 100)]).unionByName(
        spark.createDataFrame([(1, "u", "llm", 0, 10 * MS, 9)], SPAN)
    )
    marks = spark.createDataFrame([], MARK)
    got = {r.stage: r for r in timing.session_percentiles(df, iv.turn_times(df, marks), 0).collect()}
    assert got["stt"].n == 2 and got["stt"].p50_ms == 50.0 and got["stt"].max_ms == 100.0
    assert got["ttfa"].n == 0 and got["ttfa"].p99_ms == 0.0 and got["playback"].max_ms == 0.0


def test_stage_split_clamps(spark):
    def split(*ms):
        return spark.range(1).select(timing.stage_split([F.lit(x * MS).cast("long") for x in ms]).alias("s")).first().s

    s = split(0, 500, 800, 1100, 1400)
    assert [s.endpoint_ms, s.stt_ms, s.llm_ms, s.tts_ms] == [500, 300, 300, 300] and s.clamped == 0
    s = split(100, 50, 800, 1100, 1400)
    assert s.endpoint_ms == 0 and s.clamped == 1 and s.total_ms == 1300


def test_budget(spark):
    totals = spark.createDataFrame([(1, "t", "stt", 201.0), (1, "t", "llm", 300.0)],
                                   "session_id long, turn_id string, stage string, total_ms double")
    times = spark.createDataFrame([(1, "t", 900.0)], "session_id long, turn_id string, ttfa_ms double")
    got = timing.violations(totals, times, timing.budget_table(spark)).collect()
    assert {r.stage: r.over_by_ms for r in got} == {"stt": 1.0, "ttfa": 100.0}


def machine(probs, n):
    events, speaking, silent = [], False, 0
    for i, p in enumerate(probs):
        if p >= 0.5:
            if not speaking:
                events.append(("start", i))
            speaking, silent = True, 0
        elif speaking:
            silent += 1
            if silent >= n:
                events.append(("end", i))
                speaking, silent = False, 0
    return events


def test_endpointing_equals_the_state_machine(spark):
    rng = random.Random(4)
    streams = [[rng.choice([0.9, 0.1, 0.1]) for _ in range(rng.randint(1, 60))] for _ in range(150)]
    rows = [(s, i, p) for s, ps in enumerate(streams) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, prob double").repartition(8)
    got = {}
    for r in ep.utterances(df, min_silence_ms=100.0).collect():
        got.setdefault(r.stream_id, []).append(("start", r.start_seq))
        if r.end_seq is not None:
            got[r.stream_id].append(("end", r.end_seq))
    assert ep.silent_windows(100.0) == 3
    for s, probs in enumerate(streams):
        assert sorted(got.get(s, []), key=lambda e: e[1]) == machine(probs, 3)

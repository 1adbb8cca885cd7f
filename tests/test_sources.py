"""Readers, work lists, checks and streams on small files."""

from __future__ import annotations

import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from utterlab.operators import logs as ops
from utterlab.plans import wer
from utterlab.sources import logs, messages, tables
from utterlab.streaming import operators as st
from utterlab.streaming import run


def record(example, text, stt="s"):
    return {"dataset": "d", "example_id": example, "split": "test", "stt": stt, "model": "m",
            "condition": "clean", "ground_truth_text": "a b", "raw_text": text, "run": "r"}


def test_transcript_log_later_line_wins(spark, tmp_path):
    lines = [record("1", "old"), record("2", "x"), record("1", "new")]
    (tmp_path / "log.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\nnot json\n")
    raw = logs.json_lines(spark, str(tmp_path / "log.jsonl"), logs.TRANSCRIPT)
    assert [r.bad_line for r in logs.rejected_rows(raw).collect()] == ["not json"]
    log, rejected = logs.read_transcripts(spark, str(tmp_path / "log.jsonl"))
    assert [r.bad_line for r in rejected.collect()] == ["not json"]
    latest = ops.latest(log, logs.TRANSCRIPT_KEY)
    assert {r.example_id: r.raw_text for r in latest.collect()} == {"1": "new", "2": "x"}


def test_append_refuses_an_empty_id_and_work_lists_resume(spark, tmp_path):
    df = spark.createDataFrame([record("1", "x"), record("", "y")])
    rejected = ops.append_log(df, str(tmp_path / "log"), ["dataset", "stt"])
    assert rejected.count() == 1
    assert ops.append_log(spark.createDataFrame([record("1", "newer")]), str(tmp_path / "log"), ["dataset", "stt"]).count() == 0
    log = ops.read_log(spark, str(tmp_path / "log"))
    assert [r.raw_text for r in ops.latest(log, ["example_id"]).collect()] == ["newer"]
    wanted = spark.createDataFrame([("1",), ("2",)], "example_id string")
    assert [r.example_id for r in ops.missing(wanted, log, ["example_id"]).collect()] == ["2"]


def test_outcome_defaults_and_tool_tasks(spark, tmp_path):
    row = {"example_id": "1", "language": "english", "index": 0, "condition": "gt", "run": 1,
           "outcome": "pass", "tool_call": {"name": "f", "arguments": {"a": 1}}}
    (tmp_path / "runs.jsonl").write_text(json.dumps(row) + "\n")
    got = logs.read_outcomes(spark, str(tmp_path / "runs.jsonl"))[0].first()
    assert (got.error_class, got.model, got.ts) == ("", "", "")
    task = [{"id": "1", "query": "q", "path": "p", "functions": [{"name": "f", "parameters": {"properties": {
        "t": {"type": "array"}}}}], "expected_tool_call": [{"f": {"t": ["x"], "n": [3]}}]},
        {"id": "2", "query": "q", "path": "p", "functions": [], "expected_tool_call": [{"f": {}}, {"g": {}}]}]
    (tmp_path / "tasks.json").write_text(json.dumps(task))
    tasks = logs.read_tool_tasks(spark, str(tmp_path / "tasks.json"), "english").orderBy("ingest_pos").collect()
    assert tasks[0].expected == {"t": ["x"], "n": ["3"]} and tasks[0].array_params == ["t"]
    assert tasks[1].expected_name is None


def test_references_manifest_labels(spark, tmp_path):
    (tmp_path / "text").write_text("u1 hello there\nu2\n u3\n", encoding="utf-8")
    good, rejected = logs.read_references(spark, str(tmp_path / "text"))
    assert {r.uttid: r.text for r in good.collect()} == {"u1": "hello there", "u2": ""}
    assert [r.bad_line for r in rejected.collect()] == [" u3"]
    items = [{"uttid": "a", "seconds": 1.5, "sample_rate_hz": 8000}]
    (tmp_path / "m.json").write_text(json.dumps({"seed": 0, "max_seconds": 9, "items": items}, indent=1))
    assert logs.read_sample_manifest(spark, str(tmp_path / "m.json")).first().seconds == 1.5
    sheet = '﻿item,language,user_query,function,parameter,accepted_values,returned_value,' \
        'label (equivalent / not_equivalent),note\n1,english,"say ""hi""\nnow",f,p,a | b,"[""x""]",equivalent,\n'  # fmt: skip
    (tmp_path / "l.csv").write_text(sheet, encoding="utf-8")
    row = logs.read_label_sheet(spark, str(tmp_path / "l.csv")).first()
    assert (row["item"], row.label, row.returned_value) == (1, "equivalent", '["x"]')
    assert row.user_query == 'say "hi"\nnow'
    items = spark.createDataFrame([(1, "en", "q", "f", "p", "a", "b")], logs.LABEL_COLUMNS[:7])
    logs.write_label_sheet(items, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == logs.LABEL_COLUMNS


def test_text_column_is_found_per_file(spark, tmp_path):
    spark.createDataFrame([("x", 1)], "text string, a int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("y",)], "sentence string").write.parquet(str(tmp_path / "b"))
    got = tables.load_text_column(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(r.text for r in got.collect()) == ["x", "y"]
    spark.createDataFrame([(1,)], "z int").write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="is a column of"):
        tables.load_text_column(spark, [str(tmp_path / "c")])


def test_messages(spark):
    good = {"event": "start", "start": {"streamSid": "S", "accountSid": "A", "callSid": "C",
            "tracks": ["inbound"], "mediaFormat": {"encoding": "u", "sampleRate": 8000, "channels": 1}}}
    raws = [json.dumps(good), '{"event":"mark","streamSid":"S","mark":{"name":"m"}}', "{", '{"event":"x"}',
            '{"event":"mark","streamSid":"S"}', '{"event":"clear"}', "[]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = messages.parse_messages(df).orderBy("i").collect()
    assert [r.reject for r in got] == [
        None, None, "bad_json", "unknown_event", "missing_field", "missing_field", "unknown_event",
    ]
    assert got[0].m.start.mediaFormat.sampleRate == 8000 and got[1].m.mark.name == "m"


def test_report_difference_and_one_sided(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.5)], "k string, v double")
    got = ops.report_difference(a, b, ["k"], ["v"]).first()
    assert got.max_gap == 0.5 and not got.agrees
    assert ops.report_difference(a, a, ["k"], ["v"]).first().agrees
    assert {r.k: r.side for r in ops.one_sided(a, b.where("k = 'x'"), ["k"]).collect()} == {"y": "left"}


def test_utterance_stream_over_many_batches_equals_batch(spark, tmp_path):
    probs = [0.9, 0, 0, 0.9, 0, 0, 0, 0, 0.8, 0.1, 0.7, 0, 0, 0]
    rows = [(1, i, float(p), 1_700_000_000_000 + 1000 * i) for i, p in enumerate(probs)]
    seen = set()
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], "stream_id long, seq long, prob double, t long").select(
            "stream_id", "seq", "prob", F.timestamp_millis("t").alias("ts")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for part in (tmp_path / "in").glob("*.parquet"):  # files are taken oldest first
            if part not in seen:
                os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
                seen.add(part)
    stream = spark.readStream.schema("stream_id long, seq long, prob double, ts timestamp").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run.run_append(st.utterance_events(stream, min_silence_ms=100.0), "test").orderBy("seq").collect()
    assert [(r.event, r.seq) for r in out] == [
        ("speech_started", 0), ("speech_ended", 6), ("speech_started", 8), ("speech_ended", 13)
    ]


def test_turn_stream_closes_on_a_mark(spark, tmp_path):
    ms = 1_000_000
    rows = [(1, "t", "mark", "user_speech_end", 0, None, 0), (1, "t", "span", "stt", 0, 300 * ms, 1),
            (1, "t", "span", "stt", 100 * ms, 250 * ms, 2), (1, "t", "mark", "first_audio_out", 600 * ms, None, 3),
            (1, "t", "mark", "turn_end", 700 * ms, None, 4), (1, "u", "span", "llm", 0, 5 * ms, 5)]
    spark.createDataFrame(
        rows, "session_id long, turn_id string, kind string, name string, start_ns long, end_ns long, seq long"
    ).withColumn("ts", F.lit("2026-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run.run_append(st.turns(events), "turns").collect()
    assert [(r.turn_id, r.closed_by, r.ttfa_ms, r.total_ms) for r in got] == [("t", "mark", 600.0, 700.0)]
    assert json.loads(got[0].stage_ms) == {"stt": 300.0}


def test_wer_on_a_log_file_end_to_end(spark, tmp_path):
    lines = [record("1", "a"), record("2", "a b c"), record("2", "a b")]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    log = ops.latest(logs.read_transcripts(spark, str(tmp_path / "log.jsonl"))[0], logs.TRANSCRIPT_KEY)
    assert wer.corpus_wer(wer.scored_transcripts(log)).first().wer == 0.25


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    from utterlab.streaming import run

    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(7).write.parquet(f"{tmp_path}/orders.parquet")
    streamed = run.run_append(run.read_stream(spark, str(tmp_path), "events"), "several")
    assert sorted(r.id for r in streamed.collect()) == list(range(100))


def _batches(spark, path, schema, batches):
    seen = set()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for part in pathlib.Path(path).glob("part-*"):
            if part not in seen:
                os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
                seen.add(part)
    kind = spark.read.parquet(path).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_turns_that_share_a_bucket_close_one_by_one(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda minutes: datetime(2026, 1, 1) + timedelta(minutes=minutes)
    big = 1_700_000_000_000_000_001  # a float would lose the last digits
    batches = [
        [(1, "t", "span", "stt", big, big + 1000, 1, at(0)), (1, "u", "span", "llm", 0, None, 2, at(0))],
        [(1, "t", "span", "stt", big + 900, big + 2000, 3, at(30)), (2, "v", "span", "stt", 0, 9, 4, at(300))],
        [(2, "v", "mark", "turn_end", 10, None, 5, at(301)), (2, "w", "span", "stt", 0, 9, 6, at(302))],
    ]
    schema = "session_id long, turn_id string, kind string, name string, start_ns long, end_ns long, seq long, ts timestamp"
    events = _batches(spark, str(tmp_path / "in"), schema, batches)
    closed, state = run.run_with_state(st.turns(events, buckets=1), "turns")
    assert state.count() == 1
    got = closed.unionByName(st.open_turns(state)).collect()
    assert sorted((r.turn_id, r.closed_by, r.n_spans) for r in got) == [
        ("t", "idle", 2), ("u", "idle", 1), ("v", "mark", 1), ("w", "open", 1)
    ]
    assert [json.loads(r.stage_ms) for r in got if r.turn_id == "t"] == [{"stt": 0.002}]


def test_tool_calls_that_share_a_bucket_are_kept_apart(spark, tmp_path):
    batches = [
        [(1, 0, 0, "a", "f", '{"k":', False), (2, 0, 0, "", "g", '{"x', False)],
        [(2, 0, 1, None, None, '":2}', True), (3, 1, 0, "", "h", "oops", True)],
        [(1, 0, 1, "", "", "1}", True)],
    ]
    schema = "turn_id long, index int, seq int, id string, name string, arguments string, is_final boolean"
    calls = st.tool_calls(_batches(spark, str(tmp_path / "in"), schema, batches), ["turn_id"], buckets=1)
    got, state = run.run_with_state(calls, "calls")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, "a", "f", '{"k":1}'), (2, 0, "call_0", "g", '{"x":2}'), (3, 1, "call_1", "h", "{}")
    ]
    assert state.count() == 0

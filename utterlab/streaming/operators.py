"""Streaming forms: windows of state per key, interval joins and rolling aggregates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from utterlab.operators import mentions as m
from utterlab.operators.endpointing import silent_windows
from utterlab.sources.lexicon import Lexicon


def _batch_rows(chunks: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """One key's rows of this micro-batch, in order (a batch is bounded by its trigger)."""
    frames = list(chunks)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames) if frames else pd.DataFrame()
    return rows if len(rows) < 2 else rows.sort_values(order)


BUCKETS = 2048
"""Groups of a keyed stream. Each call of a group costs milliseconds, so the short-lived keys
of a stream share groups; a group's state holds its unfinished keys only."""


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def _by_key(rows: pd.DataFrame, keys: list[str], rest: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each key of a group with its rows, which are sorted by ``rest[0]``."""
    held: dict[tuple, list[tuple]] = {}
    columns = [rows[c].tolist() for c in (*keys, *rest)]
    n = len(keys)
    for row in zip(*columns, strict=True):
        held.setdefault(row[:n], []).append(row[n:])
    for key, found in held.items():
        found.sort(key=lambda r: r[0])
        yield key, found


def utterance_events(
    windows: DataFrame,
    threshold: float = 0.5,
    min_silence_ms: float = 500.0,
    idle: str = "10 minutes",
) -> DataFrame:
    """(stream_id, seq, prob, ts) -> speech_started / speech_ended events.

    State per stream is three numbers. A window at or before the last one seen is
    a repeat and is ignored; a stream that stays silent past the watermark is
    forgotten.
    """
    limit = silent_windows(min_silence_ms)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(
        key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        speaking, silent, last = state.get if state.exists else (False, 0, -1)
        out: list[tuple[Any, str, int]] = []
        rows = _batch_rows(chunks, "seq")
        for seq, prob in zip(rows["seq"], rows["prob"], strict=True):
            if seq <= last:
                continue
            last = int(seq)
            if prob >= threshold:
                if not speaking:
                    out.append((key[0], "speech_started", last))
                speaking, silent = True, 0
            elif speaking:
                silent += 1
                if silent >= limit:
                    out.append((key[0], "speech_ended", last))
                    speaking, silent = False, 0
        state.update((speaking, silent, last))
        newest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "event", "seq"])

    kind = windows.schema["stream_id"].dataType.simpleString()
    return (
        windows.withWatermark("ts", idle)
        .groupBy("stream_id")
        .applyInPandasWithState(
            step,
            f"stream_id {kind}, event string, seq long",
            "speaking boolean, silent int, last long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


TURN_EVENT = (
    "session_id, turn_id, kind ('span' or 'mark'), name (stage or mark name), "
    "start_ns, end_ns (null = open), seq, ts"
)
_TURN_OUT = (
    "session_id long, turn_id string, n_spans long, t0_ns long, ttfa_ms double, "
    "total_ms double, stage_ms string, closed_by string"
)
_NONE = -(1 << 62)


def _merge(intervals: list[list[int]], start: int, end: int) -> list[list[int]]:
    """Insert an interval into a sorted list of disjoint ones."""
    kept = [i for i in intervals if i[1] < start or i[0] > end]
    touched = [i for i in intervals if not (i[1] < start or i[0] > end)]
    kept.append([min([start, *(i[0] for i in touched)]), max([end, *(i[1] for i in touched)])])
    return sorted(kept)


_NAMES = [c.split()[0] for c in _TURN_OUT.split(", ")]


def _turn_row(key: tuple, s: dict, why: str) -> tuple:
    """A turn record from its state; spans still open end at the turn's last instant."""
    last = max(s["last"], s["last_start"])
    for stage, starts in s["open"].items():
        for start in starts:
            s["stages"][stage] = _merge(s["stages"].get(stage, []), start, max(start, last))
    t0 = s["speech"][1] if s["speech"][1] != _NONE else s["first"]
    audio = s["audio"][1]
    totals = {k: sum(b - a for a, b in v) / 1e6 for k, v in sorted(s["stages"].items())}
    return (
        *key, s["n"], t0,
        None if audio == _NONE else (audio - t0) / 1e6,
        None if s["last"] == _NONE else (s["last"] - t0) / 1e6,
        json.dumps(totals), why,
    )


def turns(
    events: DataFrame,
    delay: str = "10 minutes",
    idle: str = "1 hour",
    closing: str = "turn_end",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Turn records assembled from a stream of span and mark events.

    A turn is emitted when its closing mark arrives or when nothing came for
    ``idle`` of event time; spans still open then end at the turn's last instant.
    State per turn: a few instants and the disjoint intervals of each stage, beside those of
    the other unfinished turns of its bucket. Turns that are still open when a run ends are
    read from its state by ``open_turns``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def add(s: dict, rows: list[tuple]) -> bool:
        """Takes the rows of a turn into its state; whether they close it."""
        closed = False
        for seq, kind, name, start, end, _ in rows:
            start = int(start)
            s["first"] = min(s["first"], start)
            s["last_start"] = max(s["last_start"], start)
            if kind == "span":
                s["n"] += 1
                if not isinstance(end, str):
                    s["open"].setdefault(name, []).append(start)
                else:
                    end = int(end)
                    s["last"] = max(s["last"], end)
                    s["stages"][name] = _merge(s["stages"].get(name, []), start, end)
                continue
            s["last"] = max(s["last"], start)
            if name == "user_speech_end" and seq > s["speech"][0]:
                s["speech"] = [int(seq), start]
            elif name == "first_audio_out" and seq < s["audio"][0]:
                s["audio"] = [int(seq), start]
            closed = closed or name == closing
        return closed

    def step(
        _bucket: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        # turn -> [when it is idle, its state]
        held = {(a, b): [at, s] for a, b, at, s in json.loads(state.get[0])} if state.exists else {}
        mark, out, seen = state.getCurrentWatermarkMs(), [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(chunks))
            rows["ms"] = rows["ts"].astype("datetime64[ms]").astype("int64")
            order = ["seq", "kind", "name", "start_ns", "end_text", "ms"]
            for key, found in _by_key(rows, ["session_id", "turn_id"], order):
                seen.add(key)
                s = held.pop(key, (0, None))[1] or {
                    "n": 0, "first": 1 << 62, "last": _NONE, "last_start": _NONE,
                    "speech": [_NONE, _NONE], "audio": [1 << 62, _NONE], "stages": {}, "open": {},
                }
                if add(s, found):
                    out.append(_turn_row(key, s, "mark"))
                else:
                    held[key] = [max(max(r[5] for r in found), mark) + idle_ms, s]
        for key in [k for k, (at, _) in held.items() if at < mark and k not in seen]:
            out.append(_turn_row(key, held.pop(key)[1], "idle"))
        if held:
            state.update((json.dumps([[*k, at, s] for k, (at, s) in held.items()]),))
            state.setTimeoutTimestamp(max(min(at for at, _ in held.values()), mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=_NAMES)

    # an integer that may be null reaches pandas as a float, which cannot hold nanoseconds
    exact = events.withWatermark("ts", delay).withColumn("end_text", F.col("end_ns").cast("string"))
    return (
        _bucketed(exact.drop("end_ns"), ["session_id", "turn_id"], buckets)
        .groupBy("__bucket")
        .applyInPandasWithState(
            step, _TURN_OUT, "s string", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def open_turns(state: DataFrame) -> DataFrame:
    """Records of the turns that a stopped ``turns`` stream still holds, as far as they came,
    from its state (key, value); ``closed_by`` is "open"."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                _turn_row((session, turn), s, "open")
                for held in pdf["s"]
                for session, turn, _, s in json.loads(held)
            ]
            yield pd.DataFrame(rows, columns=_NAMES)

    return state.select("value.groupState.s").mapInPandas(finish, _TURN_OUT)


def budget_alerts(turn_stream: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """Stages and time to first audio over budget, as the turns are emitted."""
    spent = F.map_concat(
        F.from_json("stage_ms", "map<string,double>"),
        F.when(F.col("ttfa_ms").isNotNull(), F.create_map(F.lit("ttfa"), F.col("ttfa_ms"))).otherwise(
            F.create_map().cast("map<string,double>")
        ),
    )
    limits = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])
    return (
        turn_stream.select("session_id", "turn_id", F.explode(spent).alias("stage", "actual_ms"))
        .withColumn("budget_ms", F.try_element_at(limits, F.col("stage")))
        .where(F.col("actual_ms") > F.col("budget_ms"))
        .withColumn("over_by_ms", F.col("actual_ms") - F.col("budget_ms"))
    )


def barge_ins(
    turn_stream: DataFrame,
    speech: DataFrame,
    longest: str = "12 hours",
    delay: str = "1 hour",
    keep: list[str] | None = None,
) -> DataFrame:
    """Speech starting while a turn runs: an interval join of two streams.

    turn_stream: session_id, turn_id, started, ended; speech: session_id, spoke_at.
    No turn outlasts ``longest``, which bounds the state kept on both sides. ``keep``
    names further columns of the speech side.
    """
    a = turn_stream.withWatermark("started", delay).alias("a")
    b = speech.withWatermark("spoke_at", delay).alias("b")
    return a.join(
        b,
        F.expr(
            "a.session_id = b.session_id AND b.spoke_at > a.started AND b.spoke_at < a.ended "
            f"AND b.spoke_at <= a.started + INTERVAL {longest}"
        ),
    ).select("a.session_id", "a.turn_id", "a.started", "a.ended", "b.spoke_at", *(keep or []))


_END = re.compile("[.!?।]")


def sentences(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, text, is_final) -> keys + pos, sentence as each one completes.

    State per turn is the unfinished text only; the last delta flushes it.
    """

    def step(
        key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        buffer, pos = state.get if state.exists else ("", 0)
        rows = _batch_rows(chunks, "seq")
        buffer += "".join(rows["text"])
        found, start = [], 0
        for end in _END.finditer(buffer):
            found.append(buffer[start : end.end()].strip())
            start = end.end()
        buffer = buffer[start:].lstrip() if start else buffer
        if bool(rows["is_final"].any()):
            found.append(buffer.strip())
            state.remove()
        else:
            state.update((buffer, pos + len([s for s in found if s])))
        said = [s for s in found if s]
        yield pd.DataFrame(
            [(*key, pos + i, s) for i, s in enumerate(said)], columns=[*keys, "pos", "sentence"]
        )

    kinds = ", ".join(f"{k} {deltas.schema[k].dataType.simpleString()}" for k in keys)
    return deltas.groupBy(*keys).applyInPandasWithState(
        step,
        f"{kinds}, pos long, sentence string",
        "buffer string, pos long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def tool_calls(fragments: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(keys, index, seq, id, name, arguments, is_final) -> the turn's assembled calls,
    emitted when its final fragment arrives. State per turn: its partial calls, beside those
    of the other unfinished turns of its bucket. Keys are whole numbers or texts."""

    def assembled(key: tuple, calls: dict) -> Iterator[tuple]:
        for index, (call_id, name, text) in calls.items():
            try:
                ok = isinstance(json.loads(text), dict)
            except json.JSONDecodeError:
                ok = False
            yield (*key, int(index), call_id or f"call_{index}", name, text if ok else "{}")

    def step(
        _bucket: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        held = {tuple(key): calls for key, calls in json.loads(state.get[0])} if state.exists else {}
        out: list[tuple] = []
        order = ["seq", "index", "id", "name", "arguments", "is_final"]
        for key, found in _by_key(pd.concat(list(chunks)), keys, order):
            calls = held.pop(key, {})
            for _, index, call_id, name, arguments, _ in found:
                call = calls.setdefault(str(index), ["", "", ""])
                call[0] = call_id or call[0]
                call[1] = name or call[1]
                call[2] += arguments or ""
            if any(r[5] for r in found):
                out.extend(assembled(key, calls))
            else:
                held[key] = calls
        if held:
            state.update((json.dumps([[list(k), calls] for k, calls in held.items()]),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*keys, "index", "id", "name", "arguments"])

    kinds = ", ".join(f"{k} {fragments.schema[k].dataType.simpleString()}" for k in keys)
    return _bucketed(fragments, keys, buckets).groupBy("__bucket").applyInPandasWithState(
        step,
        f"{kinds}, index int, id string, name string, arguments string",
        "calls string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def latest(log: DataFrame, keys: list[str], values: list[str], position: str) -> DataFrame:
    """Last record per key so far; run in update mode, each batch emits what changed."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), position).alias("r")).select(
        *keys, "r.*"
    )


def rolling_percentiles(
    rows: DataFrame,
    arm: str,
    value: str,
    length: str = "1 hour",
    slide: str = "15 minutes",
    delay: str = "30 minutes",
) -> DataFrame:
    """Count, p50 and p90 per arm over sliding windows of event time."""
    return (
        rows.withWatermark("ts", delay)
        .groupBy(F.window("ts", length, slide), arm)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.approx_percentile(value, 0.5).alias("p50"),
            F.approx_percentile(value, 0.9).alias("p90"),
        )
        .select(F.col("window.start").alias("window_start"), arm, "n", "p50", "p90")
    )


def corrected(stream: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """Exact correction of a transcript stream, other fields unchanged (stateless)."""
    if not lexicon.small:
        raise ValueError("a stream needs a lexicon small enough to match in the row")
    found: Column = m.mentions_in_row(F.col(text), lexicon)
    return (
        stream.withColumn("__m", found)
        .withColumn(text, m.canonicalise(F.col(text), F.col("__m")))
        .drop("__m")
    )

"""Latency, turn timing, critical path and sweep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlab.catalog import query
from utterlab.catalog.transcripts import scored_log
from utterlab.catalog.transcripts import SCORED_SQL
from utterlab.operators import intervals as iv
from utterlab.plans import timing, wer
from utterlab.sources import derived
from utterlab.sources.derived import MARKS_SQL, SPANS_SQL
from utterlab.sources.tables import table

AS_OF = 1_706_745_600_000_000_000  # 2024-02-01, after the last event

TOTALS_SQL = f"""{SPANS_SQL},
closed AS (SELECT * EXCLUDE (end_ns), coalesce(end_ns, {AS_OF}) AS end_ns FROM spans),
prev AS (
  SELECT *, max(end_ns) OVER (PARTITION BY session_id, turn_id, stage ORDER BY start_ns, end_ns
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM closed
),
islands AS (
  SELECT *, sum((prev_end IS NULL OR start_ns > prev_end)::INT) OVER (
    PARTITION BY session_id, turn_id, stage ORDER BY start_ns, end_ns) AS island FROM prev
),
merged AS (
  SELECT session_id, turn_id, stage, min(start_ns) AS start_ns, max(end_ns) AS end_ns,
         count(*) AS n_spans
  FROM islands GROUP BY session_id, turn_id, stage, island
),
totals AS (
  SELECT session_id, turn_id, stage, sum(end_ns - start_ns) / 1000000 AS total_ms
  FROM merged GROUP BY ALL
)"""

TIMES_SQL = f"""{MARKS_SQL},
times AS (
  SELECT coalesce(s.session_id, m.session_id) AS session_id,
         coalesce(s.turn_id, m.turn_id) AS turn_id,
         coalesce(speech_ns, least(s_first, m_first)) AS t0_ns, audio_ns,
         greatest(s_last, m_last) AS last_ns
  FROM (SELECT session_id, turn_id, min(start_ns) AS s_first, max(end_ns) AS s_last
        FROM spans GROUP BY ALL) s
  FULL JOIN (SELECT session_id, turn_id,
      arg_max(at_ns, seq) FILTER (WHERE name = 'user_speech_end') AS speech_ns,
      arg_min(at_ns, seq) FILTER (WHERE name = 'first_audio_out') AS audio_ns,
      min(at_ns) AS m_first, max(at_ns) AS m_last FROM marks GROUP BY ALL) m
  ON s.session_id = m.session_id AND s.turn_id = m.turn_id
)"""


def spans_and_times(spark, folder):
    spans = derived.turn_spans(spark, folder)
    return spans, iv.turn_times(spans, derived.turn_marks(spark, folder))


@query(
    "span_islands",
    f"WITH {TOTALS_SQL} SELECT session_id, turn_id, stage, start_ns, end_ns, n_spans FROM merged",
)
def span_islands(spark, folder):
    return iv.merged(derived.turn_spans(spark, folder), [*iv.TURN, "stage"], AS_OF)


@query(
    "stage_totals",
    f"""WITH {TOTALS_SQL} SELECT session_id, turn_id, stage, round(total_ms, 6) AS total_ms
    FROM totals""",
)
def stage_totals(spark, folder):
    totals = iv.stage_totals(derived.turn_spans(spark, folder), AS_OF)
    return totals.withColumn("total_ms", F.round("total_ms", 6))


@query(
    "turn_times",
    f"""WITH {SPANS_SQL}, {TIMES_SQL} SELECT session_id, turn_id, t0_ns,
      round((audio_ns - t0_ns) / 1000000, 6) AS ttfa_ms,
      round((last_ns - t0_ns) / 1000000, 6) AS total_ms FROM times""",
)
def turn_times(spark, folder):
    _, times = spans_and_times(spark, folder)
    return times.select(
        *iv.TURN, "t0_ns", F.round("ttfa_ms", 6).alias("ttfa_ms"),
        F.round("total_ms", 6).alias("total_ms"),
    )


@query(
    "session_percentiles",
    f"""WITH {TOTALS_SQL}, {TIMES_SQL},
    names AS (SELECT unnest(['capture','endpoint','stt','llm','tool','tts','playback']) AS stage),
    long AS (
      SELECT t.session_id, n.stage, coalesce(x.total_ms, 0) AS ms
      FROM times t CROSS JOIN names n LEFT JOIN totals x
        ON x.session_id = t.session_id AND x.turn_id = t.turn_id AND x.stage = n.stage
      UNION ALL SELECT session_id, 'ttfa', (audio_ns - t0_ns) / 1000000 FROM times)
    SELECT session_id, stage, count(ms) AS n,
      round(coalesce(quantile_cont(ms, 0.5), 0), 0) AS p50_ms,
      round(coalesce(quantile_cont(ms, 0.9), 0), 0) AS p90_ms,
      round(coalesce(quantile_cont(ms, 0.99), 0), 0) AS p99_ms,
      coalesce(max(ms), 0) AS max_ms
    FROM long GROUP BY session_id, stage""",
)
def session_percentiles(spark, folder):
    spans, times = spans_and_times(spark, folder)
    out = timing.session_percentiles(spans, times, AS_OF)
    return out.withColumns(
        {c: F.round(c, 0) for c in ("p50_ms", "p90_ms", "p99_ms")}
    )


@query(
    "budget_violations",
    f"""WITH {TOTALS_SQL}, {TIMES_SQL}, actual AS (
      SELECT session_id, turn_id, stage, total_ms AS actual_ms FROM totals
      UNION ALL SELECT session_id, turn_id, 'ttfa', (audio_ns - t0_ns) / 1000000 FROM times
      WHERE audio_ns IS NOT NULL),
    budgets(stage, budget_ms) AS (VALUES ('ttfa', 800.0::DOUBLE), ('endpoint', 300.0),
      ('stt', 200.0), ('llm', 300.0), ('tts', 150.0))
    SELECT session_id, turn_id, stage, budget_ms, round(actual_ms, 6) AS actual_ms,
           round(actual_ms - budget_ms, 6) AS over_by_ms
    FROM actual JOIN budgets USING (stage) WHERE actual_ms > budget_ms""",
)
def budget_violations(spark, folder):
    spans, times = spans_and_times(spark, folder)
    out = timing.violations(iv.stage_totals(spans, AS_OF), times, timing.budget_table(spark))
    return out.withColumns({c: F.round(c, 6) for c in ("actual_ms", "over_by_ms")})


@query(
    "critical_path",
    f"""WITH RECURSIVE {SPANS_SQL}, {TIMES_SQL},
    start AS (
      SELECT t.session_id, t.turn_id, t0_ns, coalesce(audio_ns, e.last_end) AS cursor
      FROM times t JOIN (SELECT session_id, turn_id, max(end_ns) AS last_end FROM spans
                         GROUP BY ALL) e USING (session_id, turn_id)),
    walk AS (
      SELECT session_id, turn_id, t0_ns, cursor FROM start WHERE cursor > t0_ns
      UNION
      SELECT w.session_id, w.turn_id, w.t0_ns, n.next FROM walk w, LATERAL (
        SELECT min(start_ns) AS next FROM spans s WHERE s.session_id = w.session_id
          AND s.turn_id = w.turn_id AND s.start_ns <= w.cursor
          AND w.cursor <= coalesce(s.end_ns, w.cursor)) n
      WHERE n.next < w.cursor AND n.next > w.t0_ns)
    SELECT DISTINCT s.session_id, s.turn_id, s.stage, s.seq FROM spans s JOIN walk w
      ON s.session_id = w.session_id AND s.turn_id = w.turn_id
      AND s.start_ns <= w.cursor AND w.cursor <= coalesce(s.end_ns, w.cursor)""",
)
def critical_path(spark, folder):
    spans, times = spans_and_times(spark, folder)
    return iv.critical_path(spans, times).select(*iv.TURN, "stage", "seq")


@query(
    "barge_ins",
    f"""WITH {SPANS_SQL}, t AS (
      SELECT session_id, turn_id, seq, start_ns, end_ns FROM spans
      WHERE stage = 'tts' AND end_ns IS NOT NULL),
    s AS (SELECT session_id, start_ns AS at_ns, seq AS speech_seq FROM spans
          WHERE stage = 'endpoint')
    SELECT t.session_id, t.turn_id, t.seq, count(*) AS n_interruptions, min(at_ns) AS first_ns
    FROM t JOIN s ON s.session_id = t.session_id AND at_ns > start_ns AND at_ns < end_ns
    GROUP BY ALL""",
)
def barge_ins(spark, folder):
    spans = derived.turn_spans(spark, folder)
    turns = spans.where("stage = 'tts' and end_ns is not null").drop("stage")
    starts = spans.where("stage = 'endpoint'").select(
        "session_id", F.col("start_ns").alias("at_ns")
    )
    return (
        iv.barge_ins(turns, starts)
        .groupBy("session_id", "turn_id", "seq")
        .agg(F.count(F.lit(1)).alias("n_interruptions"), F.min("at_ns").alias("first_ns"))
    )


INSTANTS_SQL = """
inst AS (
  SELECT l_returnflag AS arm, l_linenumber = 7 AS warmup,
    CASE WHEN l_orderkey % 50 = 0 THEN 'timeout' ELSE '' END AS error,
    0::BIGINT AS i0, CAST(l_quantity * 10000000 AS BIGINT) AS i1,
    CAST(l_quantity * 9000000 + l_discount * 1000000000 AS BIGINT) AS i2,
    CAST(l_extendedprice * 10000 AS BIGINT) AS i3,
    CAST(l_extendedprice * 10000 + (l_tax - 0.02) * 1000000000 AS BIGINT) AS i4
  FROM lineitem
),
f1 AS (SELECT *, greatest(i1, i0) AS f1 FROM inst),
f2 AS (SELECT *, greatest(i2, f1) AS f2 FROM f1),
f3 AS (SELECT *, greatest(i3, f2) AS f3 FROM f2),
rows AS (
  SELECT arm, warmup, error, f1 - i0 AS a, f2 - f1 AS b, f3 - f2 AS c,
    greatest(i4, f3) - f3 AS d, greatest(i4, f3) - i0 AS t,
    (i1 < i0)::INT + (i2 < f1)::INT + (i3 < f2)::INT + (i4 < f3)::INT AS clamped FROM f3
),
lat AS (
  SELECT arm, warmup, error, clamped, a / 1000000 AS endpoint_ms, b / 1000000 AS stt_ms,
    c / 1000000 AS llm_ms, d / 1000000 AS tts_ms, t / 1000000 AS total_ms FROM rows
)"""


def latency_rows(spark, folder):
    li = table(spark, folder, "lineitem")
    ns = [
        F.lit(0).cast("bigint"),
        F.round(F.col("l_quantity") * 10_000_000).cast("bigint"),
        F.round(F.col("l_quantity") * 9_000_000 + F.col("l_discount") * 1_000_000_000).cast("bigint"),
        F.round(F.col("l_extendedprice") * 10_000).cast("bigint"),
        F.round(
            F.col("l_extendedprice") * 10_000 + (F.col("l_tax") - 0.02) * 1_000_000_000
        ).cast("bigint"),
    ]
    return li.select(
        F.col("l_returnflag").alias("arm"),
        (F.col("l_linenumber") == 7).alias("warmup"),
        F.when(F.col("l_orderkey") % 50 == 0, "timeout").otherwise("").alias("error"),
        timing.stage_split(ns).alias("s"),
    ).select("arm", "warmup", "error", "s.*")


@query(
    "latency_summary",
    f"""WITH {INSTANTS_SQL}, ok AS (SELECT * FROM lat WHERE NOT warmup AND error = ''),
    long AS (UNPIVOT (SELECT arm, 'completed' AS population, endpoint_ms, stt_ms, llm_ms, tts_ms,
        total_ms FROM ok
      UNION ALL SELECT arm, 'no_premature_endpoint', endpoint_ms, stt_ms, llm_ms, tts_ms, total_ms
        FROM ok WHERE clamped = 0)
      ON endpoint_ms, stt_ms, llm_ms, tts_ms, total_ms INTO NAME metric VALUE ms)
    SELECT arm, population, metric, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50,
      round(quantile_cont(ms, 0.9), 6) AS p90 FROM long GROUP BY ALL""",
)
def latency_summary(spark, folder):
    out = timing.latency_summary(latency_rows(spark, folder), ["arm"])
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p90")})


@query(
    "latency_counts",
    f"""WITH {INSTANTS_SQL} SELECT arm, count(*) AS turns,
      count(*) FILTER (WHERE error = '') AS n_completed,
      count(*) FILTER (WHERE error <> '') AS n_failed,
      count(*) FILTER (WHERE error = '' AND clamped > 0) AS n_premature_endpoint
    FROM lat WHERE NOT warmup GROUP BY arm""",
)
def latency_counts(spark, folder):
    return timing.latency_counts(latency_rows(spark, folder), ["arm"])


SWEEP_SQL = f"""{SCORED_SQL},
timed AS (SELECT *, lang || '/' || stt || '/' || condition AS cell,
    length(raw_text) * 7.5::DOUBLE AS stt_ms, ref_words * 400.0::DOUBLE AS audio_ms FROM scored),
points AS (
  SELECT lang, stt, condition, sum(edits) / sum(ref_words) AS wer,
    sum(stt_ms) / sum(audio_ms) AS realtime_factor, count(*) AS n_utterances,
    quantile_cont(stt_ms, 0.5) AS stt_p50_ms, quantile_cont(stt_ms, 0.9) AS stt_p90_ms
  FROM timed GROUP BY ALL
)"""


def sweep(spark, folder):
    scored = scored_log(spark, folder).withColumns(
        {
            "stt_ms": F.length("raw_text") * F.lit(7.5),
            "audio_ms": F.col("ref_words") * F.lit(400.0),
        }
    )
    return timing.sweep_points(scored, ["lang", "stt", "condition"])


@query(
    "sweep_points",
    f"""WITH {SWEEP_SQL} SELECT lang, stt, condition, round(wer, 9) AS wer,
      round(realtime_factor, 9) AS realtime_factor, n_utterances, stt_p50_ms, stt_p90_ms
    FROM points""",
)
def sweep_points(spark, folder):
    return sweep(spark, folder).withColumns({c: F.round(c, 9) for c in ("wer", "realtime_factor")})


@query(
    "sweep_pareto",
    f"""WITH {SWEEP_SQL} SELECT lang, stt, condition, round(wer, 9) AS wer, stt_p50_ms
    FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o
      WHERE o.wer <= p.wer AND o.stt_p50_ms <= p.stt_p50_ms
        AND (o.wer < p.wer OR o.stt_p50_ms < p.stt_p50_ms))""",
)
def sweep_pareto(spark, folder):
    front = timing.pareto_front(sweep(spark, folder))
    return front.select("lang", "stt", "condition", F.round("wer", 9).alias("wer"), "stt_p50_ms")

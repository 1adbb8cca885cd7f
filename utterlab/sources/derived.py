"""Evaluation inputs derived from the driver tables.

The corpora the reports were designed for are gated, so transcripts, outcomes,
spans and calls are built from whole driver tables by deterministic arithmetic
that SQL can restate. Nothing is sampled or cut short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.sources.tables import spread, table

# arm, condition, modulus of its noise
NOISE = (("alpha", "clean", 11), ("alpha", "degraded", 5), ("beta", "clean", 7))
SENTENCE = r"[^.!?\n]*[.!?\n]|[^.!?\n]+\z"


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every document, as one utterance."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    parts = docs.select(
        "doc_id",
        "lang",
        "source",
        F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("sent", "raw"),
    )
    tokens = F.regexp_extract_all("raw", F.lit(r"[^ \t\n\f\r]+"), F.lit(0))
    return (
        parts.withColumn("tokens", tokens)
        .where(F.size("tokens") > 0)
        .select(
            "doc_id",
            "sent",
            "lang",
            "source",
            F.concat_ws("#", F.lit("documents"), F.concat_ws(":", "doc_id", "sent")).alias(
                "example_id"
            ),
            "tokens",
            F.array_join("tokens", " ").alias("ground_truth_text"),
        )
    )


def _heard(modulus: int) -> Column:
    """Ground truth with a word dropped, garbled or doubled at fixed positions."""

    def one(word: Column, pos: Column) -> Column:
        slot = (F.col("__first_slot") + pos) % modulus
        return (
            F.when(slot > 2, F.array(word))
            .when(slot == 0, F.array().cast("array<string>"))
            .when(slot == 1, F.array(F.concat(word, F.lit("x"))))
            .when(slot == 2, F.array(word, word))
            .otherwise(F.array(word))
        )

    return F.array_join(F.flatten(F.transform("tokens", one)), " ")


def paired_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per utterance with every arm's text side by side."""
    placed = utterances(spark, folder).withColumn("__first_slot", F.col("doc_id") * 31 + F.col("sent") * 7)
    return placed.select(
        "doc_id",
        "sent",
        "lang",
        "source",
        "example_id",
        "ground_truth_text",
        *[_heard(m).alias(f"{arm}_{cond}") for arm, cond, m in NOISE],
    )


def transcripts(
    spark: SparkSession, folder: str, once: dict[str, Column] | None = None
) -> DataFrame:
    """The same in log shape: one row per (utterance, arm, condition).

    ``once`` adds columns of the utterance, computed before its arms are set apart.
    """
    once = once or {}
    wide = paired_transcripts(spark, folder)
    for name, column in once.items():
        wide = wide.withColumn(name, column)
    arms = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(arm).alias("stt"),
                    F.lit(cond).alias("condition"),
                    F.col(f"{arm}_{cond}").alias("raw_text"),
                )
                for arm, cond, _ in NOISE
            ]
        )
    ).alias("a")
    kept = ["doc_id", "sent", "lang", "source", "example_id", "ground_truth_text", *once]
    return wide.select(*kept, arms).select(*kept, "a.*")


UTT_SQL = r"""
utt_parts AS (
  SELECT doc_id, lang, source,
         generate_subscripts(parts, 1) - 1 AS sent, unnest(parts) AS raw
  FROM (SELECT doc_id, lang, source,
               regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+$') AS parts FROM documents)
),
utt_tokens AS (
  SELECT *, list_filter(string_split_regex(raw, '[ \t\n\f\r]+'), lambda w: w <> '') AS tokens
  FROM utt_parts
),
utt AS (
  SELECT doc_id, sent, lang, source, tokens,
         'documents#' || doc_id || ':' || sent AS example_id,
         array_to_string(tokens, ' ') AS ground_truth_text
  FROM utt_tokens WHERE len(tokens) > 0
),
arms(stt, condition, modulus) AS (
  VALUES ('alpha', 'clean', 11), ('alpha', 'degraded', 5), ('beta', 'clean', 7)
),
trans AS (
  SELECT doc_id, sent, lang, source, example_id, ground_truth_text, stt, condition,
    coalesce(array_to_string(flatten(list_transform(tokens, lambda w, i:
      CASE (doc_id * 31 + sent * 7 + i - 1) % modulus
        WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [w || 'x'] WHEN 2 THEN [w, w] ELSE [w] END
    )), ' '), '') AS raw_text
  FROM utt, arms
)"""


def canonical_sql(expr: str) -> str:
    """Scoring form of a text, restated for the oracle."""
    return (
        r"trim(regexp_replace(regexp_replace(lower(nfc_normalize(" + expr + r")), "
        r"'[^\p{L}\p{M}\p{N} \t\n\v\f\r]+', '', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'))"
    )


def words_sql(expr: str) -> str:
    return f"list_filter(string_split({expr}, ' '), lambda w: w <> '')"


def edits_sql(ref: str, hyp: str, vocab: str) -> str:
    """Word edit distance: each distinct word of the pair becomes one byte, then
    the built-in byte-level distance applies (pairs hold under 127 words)."""
    code = (
        "coalesce(array_to_string(list_transform({x}, "
        f"lambda w: chr(list_position({vocab}, w)::INT)), ''), '')"
    )
    return f"levenshtein({code.format(x=ref)}, {code.format(x=hyp)})"


def scored_sql(source: str, ref: str = "ground_truth_text", hyp: str = "raw_text", p: str = "") -> str:
    """CTEs {p}canon, {p}vocab, {p}scored over ``source`` with edits and word counts."""
    return f"""
{p}canon AS (
  SELECT *, {words_sql(canonical_sql(ref))} AS {p}ref, {words_sql(canonical_sql(hyp))} AS {p}hyp
  FROM {source}
),
{p}vocab AS (SELECT *, list_distinct(list_concat({p}ref, {p}hyp)) AS {p}v FROM {p}canon),
{p}scored AS (
  SELECT *, len({p}ref) AS {p}ref_words, len({p}hyp) AS {p}hyp_words,
         {edits_sql(p + "ref", p + "hyp", p + "v")} AS {p}edits
  FROM {p}vocab
)"""


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Model outcomes from events; repeats of a key arise naturally."""
    ev = table(spark, folder, "events")
    return ev.select(
        F.when(F.col("user_id") % 2 == 0, "english").otherwise("hindi").alias("language"),
        F.concat(F.lit("task_"), F.col("user_id").cast("string")).alias("example_id"),
        F.floor(F.col("user_id") / 2).cast("bigint").alias("index"),
        F.when(F.col("event_type") == "view", "gt")
        .otherwise(F.col("event_type"))
        .alias("condition"),
        (1 + F.col("event_id") % 3).cast("int").alias("run"),
        F.when(F.col("value") < 1, "incomplete")
        .when(F.col("value") >= 20, "pass")
        .otherwise("fail")
        .alias("outcome"),
        F.col("event_id").alias("ingest_pos"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


OUTCOMES_SQL = """
outcomes AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'english' ELSE 'hindi' END AS language,
         'task_' || user_id AS example_id, CAST(floor(user_id / 2) AS BIGINT) AS idx,
         CASE WHEN event_type = 'view' THEN 'gt' ELSE event_type END AS condition,
         CAST(1 + event_id % 3 AS INT) AS run,
         CASE WHEN value < 1 THEN 'incomplete' WHEN value >= 20 THEN 'pass' ELSE 'fail' END
           AS outcome,
         event_id AS ingest_pos, ts
  FROM events
),
latest AS (
  SELECT language, example_id, condition, run, max(idx) AS idx,
         arg_max(outcome, ingest_pos) AS outcome
  FROM outcomes GROUP BY ALL
)"""


def span_columns() -> dict[str, Column]:
    """Stage, start and end of the span an event stands for."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    kind = F.col("event_type")
    stage = (
        F.when(kind == "view", "endpoint")
        .when(kind == "click", "stt")
        .when(kind == "signup", "llm")
        .when(kind == "error", "tool")
        .otherwise("tts")
    )
    length = F.floor(F.col("value") * 60_000_000).cast("bigint") * 1000
    return {
        "stage": stage,
        "start_ns": start,
        "end_ns": F.when(F.col("event_id") % 97 != 0, start + length),
    }


def turn_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Stage spans: a user's events of one day are one turn."""
    span = span_columns()
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("turn_id"),
        *[column.alias(name) for name, column in span.items()],
        F.col("event_id").alias("seq"),
    )


SPANS_SQL = """
spans AS (
  SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d') AS turn_id,
         CASE event_type WHEN 'view' THEN 'endpoint' WHEN 'click' THEN 'stt'
              WHEN 'signup' THEN 'llm' WHEN 'error' THEN 'tool' ELSE 'tts' END AS stage,
         epoch_us(ts) * 1000 AS start_ns,
         CASE WHEN event_id % 97 <> 0
              THEN epoch_us(ts) * 1000 + CAST(floor(value * 60000000) AS BIGINT) * 1000 END
           AS end_ns,
         event_id AS seq
  FROM events
)"""


def mark_columns() -> dict[str, Column]:
    """Name of the mark an event stands for: speech ends at a view, audio starts at a
    purchase."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", "user_speech_end")
        .when(kind == "purchase", "first_audio_out")
        .when(kind == "click", "final_transcript")
        .when(kind == "signup", "first_llm_token")
        .otherwise("first_partial")
    )
    return {"name": name}


def turn_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Marks of the same turns."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("turn_id"),
        mark_columns()["name"].alias("name"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at_ns"),
        F.col("event_id").alias("seq"),
    )


MARKS_SQL = """
marks AS (
  SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d') AS turn_id,
         CASE event_type WHEN 'view' THEN 'user_speech_end' WHEN 'purchase' THEN 'first_audio_out'
              WHEN 'click' THEN 'final_transcript' WHEN 'signup' THEN 'first_llm_token'
              ELSE 'first_partial' END AS name,
         epoch_us(ts) * 1000 AS at_ns, event_id AS seq
  FROM events
)"""


def tool_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """One tool task per part: its expected call and function schema as JSON."""
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    part = spread(table(spark, folder, "part").select(*columns))
    words = F.split("p_name", " ")
    brand_no = F.regexp_extract("p_brand", r"(\d+)", 1)
    expected = F.concat(
        F.lit('[{"find_part":{"brand":["'), F.col("p_brand"), F.lit('","No. '), brand_no,
        F.lit('"],"words":["'), F.array_join(words, '","'), F.lit('"]}}]'),
    )
    functions = F.lit(
        '[{"name":"find_part","parameters":{"type":"dict","properties":'
        '{"brand":{"type":"string"},"words":{"type":"array"},"size":{"type":"float"}}}}]'
    )
    return part.select(
        F.when(F.col("p_partkey") % 2 == 0, "english").otherwise("hindi").alias("language"),
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("example_id"),
        F.concat(F.lit("find "), F.col("p_name"), F.lit(" by "), F.col("p_brand")).alias("query"),
        expected.alias("expected_json"),
        functions.alias("functions_json"),
        "p_partkey",
        "p_brand",
        "p_type",
        "p_size",
        words.alias("words"),
    )


def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Logged calls of three runs under two conditions, wrong in nine ways."""
    from utterlab.operators.judging import array_params, expected_call

    cells = (
        tool_tasks(spark, folder)
        .withColumn("expected_call", expected_call(F.col("expected_json")))
        .withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("run", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    )
    way = F.col("way")
    words = (
        F.when(way == 1, F.reverse("words"))
        .when(way == 2, F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(1))))
        .otherwise(F.col("words"))
    )
    brand = (
        F.when(way == 3, F.upper("p_brand")).when(way == 7, "ब्रांड").otherwise(F.col("p_brand"))
    )
    listed = F.concat(F.lit('["'), F.array_join(words, '","'), F.lit('"]'))
    tail = (
        F.when(way == 6, "}")
        .when(
            way == 8, F.concat(F.lit(',"words":"'), F.col("words")[0], F.lit('","note":2.0}'))
        )
        .otherwise(F.concat(F.lit(',"words":'), listed, F.lit("}")))
    )
    called = way != 4
    return (
        cells.withColumn("way", (F.col("p_partkey") * 3 + F.col("run") * 5 + F.col("c") * 2) % 9)
        .select(
            "language",
            "example_id",
            F.when(F.col("c") == 0, "gt").otherwise("alpha").alias("condition"),
            "run",
            "query",
            F.when(way == 5, "find_supplier").when(called, "find_part").alias("called_name"),
            F.when(called, F.concat(F.lit('{"brand":"'), brand, F.lit('"'), tail)).alias(
                "arguments_json"
            ),
            F.col("expected_call.name").alias("expected_name"),
            F.col("expected_call.arguments").alias("expected"),
            array_params(F.col("functions_json"), F.col("expected_call.name")).alias(
                "array_params"
            ),
            F.when((way == 4) & (F.col("p_size") % 2 == 0), "tool_validation_failed")
            .otherwise("")
            .alias("error_class"),
            F.when(way.isin(0, 8), "pass").otherwise("fail").alias("outcome"),
            (F.col("p_partkey") * 6 + F.col("c") * 3 + F.col("run")).alias("ingest_pos"),
        )
    )


CALLS_SQL = """
cells AS (
  SELECT *, string_split(p_name, ' ') AS words, (p_partkey * 3 + run * 5 + c * 2) % 9 AS way
  FROM part, (SELECT unnest([0, 1]) AS c), (SELECT unnest([1, 2, 3]) AS run)
),
calls AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'english' ELSE 'hindi' END AS language,
         'part_' || p_partkey AS example_id, CASE c WHEN 0 THEN 'gt' ELSE 'alpha' END AS condition,
         CAST(run AS INT) AS run, p_partkey,
         CASE WHEN way = 5 THEN 'find_supplier' WHEN way <> 4 THEN 'find_part' END AS called_name,
         CASE WHEN way = 3 THEN upper(p_brand) WHEN way = 7 THEN 'ब्रांड'
              ELSE p_brand END AS brand,
         [p_brand, 'No. ' || regexp_extract(p_brand, '[0-9]+')] AS brand_ok,
         words AS words_ok,
         CASE WHEN way = 1 THEN list_reverse(words)
              WHEN way = 2 THEN list_slice(words, 1, greatest(len(words) - 1, 1))
              WHEN way = 8 THEN [words[1]] ELSE words END AS given,
         way = 8 AS scalar, way = 6 AS no_words,
         CASE WHEN way = 4 AND p_size % 2 = 0 THEN 'tool_validation_failed' ELSE '' END
           AS error_class,
         CASE WHEN way IN (0, 8) THEN 'pass' ELSE 'fail' END AS outcome,
         p_partkey * 6 + c * 3 + run AS ingest_pos
  FROM cells
),
judged AS (
  SELECT *,
    coalesce(called_name = 'find_part' AND NOT no_words, false) AS reached,
    list_contains(list_transform(brand_ok, lambda b: lower(b)), lower(brand)) AS brand_good,
    CASE WHEN scalar THEN list_contains(list_transform(words_ok, lambda w: lower(w)),
                                        lower(given[1])) ELSE false END AS words_exact,
    list_sort(list_distinct(list_transform(given, lambda w: lower(w))))
      = list_sort(list_distinct(list_transform(words_ok, lambda w: lower(w)))) AS words_listed,
    CASE WHEN scalar THEN '"' || given[1] || '"'
         ELSE '["' || array_to_string(given, '", "') || '"]' END AS words_json
  FROM calls
),
items AS (
  SELECT *, 'brand' AS parameter, '"' || brand || '"' AS returned_value,
         array_to_string(brand_ok, ' | ') AS accepted_values
  FROM judged WHERE reached AND NOT brand_good
  UNION ALL BY NAME
  SELECT *, 'words' AS parameter, words_json AS returned_value,
         array_to_string(words_ok, ' | ') AS accepted_values
  FROM judged WHERE reached AND NOT words_listed
),
keyed AS (
  SELECT *, language || '|' || example_id || '|' || parameter || '|' || lower(returned_value)
    AS key FROM items
)"""


def score_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Speech scores: a user's events in time order are one stream of windows."""
    from utterlab.operators.scan import ranked

    ev = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    placed = ranked(ev, ["user_id"], F.date_trunc("day", "ts"), ["ts", "event_id"], "n")
    return placed.select(
        F.col("user_id").alias("stream_id"),
        (F.col("n") - 1).alias("seq"),
        F.least(F.col("value") / 50, F.lit(1.0)).alias("prob"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


WINDOWS_SQL = """
windows AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
           AS seq, least(value / 50, 1.0) AS prob
  FROM events
)"""


def call_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Call-stream text frames from events; every fiftieth is broken in some way."""
    return table(spark, folder, "events").select("event_id", "user_id", message_text())


def message_text() -> Column:
    sid = F.concat(F.lit('"streamSid":"S'), F.col("user_id").cast("string"), F.lit('"'))
    kind = F.col("event_id") % 7
    chunk = F.floor(F.col("event_id") / 7).cast("string")
    body = (
        F.when(kind == 0, F.lit('{"event":"connected","protocol":"Call","version":"1.0"}'))
        .when(
            kind == 1,
            F.concat(
                F.lit('{"event":"start",'), sid, F.lit(',"start":{'), sid,
                F.lit(',"accountSid":"A","callSid":"C","tracks":["inbound"],"mediaFormat":'
                      '{"encoding":"audio/x-mulaw","sampleRate":8000,"channels":1}}}'),
            ),
        )
        .when(kind == 2, F.concat(F.lit('{"event":"stop",'), sid,
                                  F.lit(',"stop":{"accountSid":"A","callSid":"C"}}')))
        .when(kind == 3, F.concat(F.lit('{"event":"mark",'), sid, F.lit(',"mark":{"name":"m"}}')))
        .when(kind == 4, F.concat(F.lit('{"event":"dtmf",'), sid,
                                  F.lit(',"dtmf":{"track":"inbound","digit":"1"}}')))
        .when(kind == 5, F.concat(F.lit('{"event":"clear",'), sid, F.lit("}")))
        .otherwise(F.concat(F.lit('{"event":"media",'), sid, F.lit(',"media":{"payload":"AA==","chunk":"'),
                            chunk, F.lit('"}}')))
    )
    broken = F.col("event_id") % 50
    return (
        F.when(broken == 0, F.lit('{"event":"media"'))
        .when(broken == 17, F.lit('{"event":"video"}'))
        .when(broken == 34, F.lit('{"event":"media","media":{"payload":"AA=="}}'))
        .otherwise(body)
        .alias("raw")
    )


def text_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns cut into five-character deltas."""
    turns = table(spark, folder, "conversations")
    pieces = F.regexp_extract_all("text", F.lit(r"(?s).{1,5}"), F.lit(0))
    return turns.select("conv_id", "turn", F.posexplode(pieces).alias("seq", "text"))


def call_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return fragments_of(table(spark, folder, "orders"))


def fragments_of(orders: DataFrame) -> DataFrame:
    """Streamed tool-call fragments: two calls per order, arguments in three parts."""
    rows = (
        orders.withColumn("index", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    )
    key = F.col("o_orderkey").cast("string")
    seq = F.col("seq")
    call_id = (
        F.when((F.col("index") == 0) & (seq == 0), F.concat(F.lit("first_"), key))
        .when(
            (F.col("index") == 0) & (seq == 2) & (F.col("o_orderkey") % 3 == 0),
            F.concat(F.lit("last_"), key),
        )
        .otherwise("")
    )
    arguments = (
        F.when(seq == 0, '{"status":')
        .when(seq == 1, F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('","k":')))
        .when(F.col("o_orderkey") % 11 == 0, "oops")
        .otherwise(F.concat(key, F.lit("}")))
    )
    return rows.select(
        F.col("o_orderkey").alias("turn_id"),
        "index",
        "seq",
        call_id.alias("id"),
        F.when(seq == 0, "find").when(seq == 2, "find_order").otherwise("").alias("name"),
        arguments.alias("arguments"),
    )

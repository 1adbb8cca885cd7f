"""Queries over the readers and sinks: driver tables go through files and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from utterlab.catalog import query
from utterlab.functions import text as tx
from utterlab.operators import logs as ops
from utterlab.session import shared_folder
from utterlab.sources import derived, lexicon, logs
from utterlab.sources.derived import OUTCOMES_SQL
from utterlab.sources.tables import corpus_rows, load_text_column, table


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _in_order(lines, by):
    """Part files in the order of ``by``, as a writer that appends would leave them."""
    return lines.repartitionByRange(4, by).sortWithinPartitions(by)


def _json_log(spark, rows, order, broken, name):
    """``rows`` as JSON lines in order; lines under ``broken`` are cut short."""
    place = _place(spark, name)
    line = F.to_json(F.struct(*[c for c in rows.columns if c != order]))
    cut = F.when(broken, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    _in_order(rows.withColumn("line", line), order).select(cut.alias("value")).write.text(place)
    return place


def _transcripts(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        F.lit("d").alias("dataset"),
        F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")).alias("example_id"),
        F.lit("test").alias("split"),
        F.col("event_type").alias("stt"),
        F.lit("m").alias("model"),
        F.lit("clean").alias("condition"),
        F.lit("words").alias("ground_truth_text"),
        F.concat(F.lit('said "'), F.col("event_id"), F.lit('"')).alias("raw_text"),
        F.lit("r").alias("run"),
    )


@query(
    "transcript_lines",
    """SELECT CASE WHEN user_id % 10 = 0 THEN '' ELSE user_id::VARCHAR END AS example_id,
      event_type AS stt, 'said "' || max(event_id) || '"' AS raw_text, 0::BIGINT AS rejected
    FROM events WHERE event_id % 50 <> 3 GROUP BY ALL
    UNION ALL SELECT NULL, NULL, NULL, count(*) FROM events WHERE event_id % 50 = 3""",
)
def transcript_lines(spark, folder):
    """A transcript log written and read: the later line wins, broken lines are counted."""
    rows = _transcripts(spark, folder)
    place = _json_log(spark, rows, "event_id", F.col("event_id") % 50 == 3, "transcripts")
    good, rejected = logs.read_transcripts(spark, place)
    latest = ops.latest(good, logs.TRANSCRIPT_KEY)
    none = F.lit(None).cast("string")
    bad = rejected.agg(F.count(F.lit(1)).alias("rejected")).select(
        none.alias("example_id"), none.alias("stt"), none.alias("raw_text"), "rejected"
    )
    return latest.select("example_id", "stt", "raw_text", F.lit(0).cast("long").alias("rejected")).unionByName(bad)


@query(
    "appended_log",
    """WITH e AS (SELECT *, event_id % 2 AS part FROM events WHERE user_id % 10 <> 0)
    SELECT user_id::VARCHAR AS example_id, event_type AS stt,
      'said "' || arg_max(event_id, part * 1000000000000 + event_id) || '"' AS raw_text
    FROM e GROUP BY ALL""",
)
def appended_log(spark, folder):
    """Two appends to one log: the later append wins, empty ids are refused."""
    rows = _transcripts(spark, folder).withColumnRenamed("event_id", "ingest_pos")
    place = _place(spark, "log")
    for part in (0, 1):
        ops.append_log(rows.where(F.col("ingest_pos") % 2 == part), place, ["dataset", "stt"])
    return ops.latest(ops.read_log(spark, place), logs.TRANSCRIPT_KEY).select("example_id", "stt", "raw_text")


@query(
    "refused_records",
    "SELECT event_type AS stt, count(*) AS refused FROM events WHERE user_id % 10 = 0 GROUP BY ALL",
)
def refused_records(spark, folder):
    """Records an append hands back."""
    rejects = ops.append_log(_transcripts(spark, folder), _place(spark, "log"), ["stt"])
    return rejects.groupBy("stt").agg(F.count(F.lit(1)).alias("refused"))


@query(
    "outcome_log",
    f"""WITH {OUTCOMES_SQL} SELECT language, condition, outcome, count(*) AS n,
      '' AS error_class, '' AS model FROM outcomes GROUP BY ALL""",
)
def outcome_log(spark, folder):
    """An outcome log written and read; missing fields take their defaults."""
    rows = derived.outcomes(spark, folder).drop("ts").withColumn("index", F.col("index").cast("int"))
    place = _json_log(spark, rows, "ingest_pos", F.lit(False), "outcomes")
    good, _ = logs.read_outcomes(spark, place)
    return good.groupBy("language", "condition", "outcome", "error_class", "model").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "verdict_log",
    """WITH v AS (SELECT doc_id % 500 AS k, doc_id, quality, toxic FROM labels)
    SELECT k::VARCHAR AS key, arg_max(quality = 1, doc_id) AS equivalent,
      arg_max(CASE WHEN toxic = 1 THEN 'unparsed' ELSE 'scored' END, doc_id) AS status
    FROM v GROUP BY k""",
)
def verdict_log(spark, folder):
    """A verdict log written and read: the latest verdict of each key."""
    rows = table(spark, folder, "labels").select(
        "doc_id",
        (F.col("doc_id") % 500).cast("string").alias("key"),
        (F.col("quality") == 1).alias("equivalent"),
        F.when(F.col("toxic") == 1, "unparsed").otherwise("scored").alias("status"),
    )
    place = _json_log(spark, rows, "doc_id", F.lit(False), "verdicts")
    good, _ = logs.read_verdicts(spark, place)
    return ops.latest(good, ["key"]).select("key", "equivalent", "status")


@query(
    "telephone_hypotheses",
    """SELECT 'u' || doc_id AS uttid, doc_id % 9 = 0 AS rejected,
      CASE WHEN doc_id % 9 <> 0 THEN md5(text) END AS said FROM documents""",
)
def telephone_hypotheses(spark, folder):
    """Hypotheses written and read, a rejected one without text."""
    lost = F.col("doc_id") % 9 == 0
    rows = table(spark, folder, "documents").select(
        F.concat(F.lit("u"), F.col("doc_id")).alias("uttid"),
        F.when(~lost, F.col("text")).alias("raw_text"),
        lost.alias("rejected"),
    )
    place = _place(spark, "hypotheses")
    rows.write.json(place)
    return logs.read_hypotheses(spark, place).select("uttid", "rejected", F.md5("raw_text").alias("said"))


@query(
    "latency_rows",
    """SELECT 'o' || l_orderkey || '-' || l_linenumber AS uttid, l_quantity::DOUBLE AS stt_ms,
      l_linenumber = 1 AS warmup, '' AS error FROM lineitem""",
)
def latency_rows(spark, folder):
    """Latency rows written and read; a missing error is empty."""
    rows = table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.concat(F.lit("o"), F.col("l_orderkey")), "l_linenumber").alias("uttid"),
        F.col("l_quantity").cast("double").alias("stt_ms"),
        (F.col("l_linenumber") == 1).alias("warmup"),
    )
    place = _place(spark, "latency")
    rows.write.json(place)
    return logs.read_latency(spark, place).select("uttid", "stt_ms", "warmup", "error")


@query(
    "label_sheet",
    """SELECT p_brand AS function, count(*) AS n,
      count(*) FILTER (WHERE p_partkey % 4 = 0) AS unmatched FROM part GROUP BY ALL""",
)
def label_sheet(spark, folder):
    """A labelling sheet written and read, and how many of its rows match no judged item."""
    part = table(spark, folder, "part")
    items = part.select(
        F.col("p_partkey").cast("int").alias("item"),
        F.lit("english").alias("language"),
        F.concat(F.col("p_name"), F.lit(', "quoted"\nnext')).alias("user_query"),
        F.col("p_brand").alias("function"),
        F.lit("p").alias("parameter"),
        F.col("p_partkey").cast("string").alias("accepted_values"),
        F.col("p_type").alias("returned_value"),
    )
    place = _place(spark, "sheet")
    logs.write_label_sheet(items, place)
    sheet = logs.read_label_sheet(spark, place)
    texts = ["language", "user_query", "function", "accepted_values", "returned_value"]
    lost = logs.unmatched_labels(sheet, items.where("item % 4 <> 0"), texts)
    n = F.count(F.lit(1))
    by_function = lost.groupBy("function").agg(n.alias("unmatched"))
    both = sheet.groupBy("function").agg(n.alias("n")).join(by_function, "function", "left")
    return both.select("function", "n", F.coalesce("unmatched", F.lit(0)).alias("unmatched"))


@query(
    "corpus_texts",
    "SELECT md5(text) AS text_md5 FROM documents UNION ALL SELECT md5(text) FROM benchmark",
)
def corpus_texts(spark, folder):
    """The text column of files that name it differently."""
    other = _place(spark, "corpus")
    table(spark, folder, "benchmark").select(F.col("text").alias("sentence")).write.parquet(other)
    texts = load_text_column(spark, [f"{folder}/documents.parquet", other], ("text", "sentence"))
    return texts.select(F.md5("text").alias("text_md5"))


@query(
    "corpus_metadata",
    """SELECT CASE WHEN doc_id % 3 = 0 THEN 'valid' ELSE 'train' END AS split,
      lang AS scenario, source AS task_name, count(*) AS n FROM documents GROUP BY ALL""",
)
def corpus_metadata(spark, folder):
    """Corpus rows by the split in the shard's name and by scenario and task."""
    place, docs = _place(spark, "corpus"), table(spark, folder, "documents")
    valid = F.col("doc_id") % 3 == 0
    for name, keep in (("train-00000-of-00002", ~valid), ("valid-00001-of-00002", valid)):
        docs.where(keep).select(
            "text", F.col("lang").alias("scenario"), F.col("source").alias("task_name")
        ).write.parquet(f"{place}/{name}")
    rows = corpus_rows(spark, f"{place}/*")
    return rows.groupBy("split", "scenario", "task_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "report_round_trip",
    "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL",
)
def report_round_trip(spark, folder):
    """A report written as JSON and read."""
    report = table(spark, folder, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )
    place = _place(spark, "report")
    logs.write_report(report, place)
    return spark.read.schema(report.schema).json(place)


_SPELLINGS_SQL = """
s AS (
  SELECT p_name AS canonical, 'latin' AS script, unnest([lower(p_name), upper(p_name)]) AS variant FROM part
  UNION ALL SELECT p_name, 'devanagari', p_brand FROM part
)"""


def _lexicon(spark, folder):
    part = table(spark, folder, "part")
    return lexicon.spelling_rows(
        part.select(
            F.col("p_partkey").cast("int").alias("entry_ord"),
            F.col("p_name").alias("canonical"),
            F.create_map(
                F.lit("latin"), F.array(F.lower("p_name"), F.upper("p_name")),
                F.lit("devanagari"), F.array("p_brand"),
            ).alias("variants"),
        )
    )


@query("lexicon_spellings", f"WITH {_SPELLINGS_SQL} SELECT script, canonical, variant FROM s")
def lexicon_spellings(spark, folder):
    """A lexicon as one row per spelling."""
    return _lexicon(spark, folder).select("script", "canonical", "variant")


@query(
    "lexicon_lookup",
    f"""WITH {_SPELLINGS_SQL} SELECT script, canonical, variant FROM s
    WHERE canonical IN (SELECT p_name FROM part WHERE p_size < 5)""",
)
def lexicon_lookup(spark, folder):
    """Entries of the names asked for."""
    names = table(spark, folder, "part").where("p_size < 5").select(F.col("p_name").alias("canonical"))
    return lexicon.find(_lexicon(spark, folder), names).select("script", "canonical", "variant")


@query(
    "outcome_tasks",
    f"""WITH {OUTCOMES_SQL}, m AS (
      SELECT CASE WHEN c_custkey % 2 = 0 THEN 'english' ELSE 'hindi' END AS language,
             'task_' || c_custkey AS example_id, c_name AS query FROM customer)
    SELECT language, example_id, condition, run, outcome, query
    FROM outcomes JOIN m USING (language, example_id)""",
)
def outcome_tasks(spark, folder):
    """Logged outcomes with their task: ids repeat across languages, so both columns join."""
    manifest = table(spark, folder, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, "english").otherwise("hindi").alias("language"),
        F.concat(F.lit("task_"), F.col("c_custkey")).alias("example_id"),
        F.col("c_name").alias("query"),
    )
    joined = ops.with_task(derived.outcomes(spark, folder), manifest)
    return joined.select("language", "example_id", "condition", "run", "outcome", "query")


@query(
    "blank_transcripts",
    r"""WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN E' \t\n' ELSE text END AS said
      FROM conversations)
    SELECT conv_id, turn, CASE WHEN trim(said, E' \t\n') = '' THEN 'fail' ELSE 'judge' END AS outcome,
      CASE WHEN trim(said, E' \t\n') = '' THEN 'empty_text' ELSE '' END AS error_class FROM t""",
)
def blank_transcripts(spark, folder):
    """A blank transcript fails without a call."""
    said = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, " \t\n").otherwise(F.col("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", tx.blank_outcome(said).alias("o"))
    return rows.select("conv_id", "turn", "o.outcome", "o.error_class")


@query(
    "scripts_by_block",
    """WITH t AS (SELECT doc_id, translate(text, 'eo', CASE doc_id % 3 WHEN 0 THEN 'अआ' WHEN 1 THEN 'கஅ' ELSE 'eo' END) AS t
      FROM documents), n AS (
      SELECT doc_id, length(regexp_replace(t, '[^ऀ-ॿ]', '', 'g')) AS d, length(regexp_replace(t, '[^஀-௿]', '', 'g')) AS m FROM t)
    SELECT CASE WHEN d > 0 AND d >= m THEN 'devanagari' WHEN m > 0 THEN 'tamil' ELSE 'latin' END AS script,
      count(*) AS n FROM n GROUP BY ALL""",
)
def scripts_by_block(spark, folder):
    """Texts by block, with letters of two other blocks put in."""
    k = F.col("doc_id") % 3
    mixed = (
        F.when(k == 0, F.translate("text", "eo", "अआ"))
        .when(k == 1, F.translate("text", "eo", "கஅ"))
        .otherwise(F.col("text"))
    )
    rows = table(spark, folder, "documents").select(tx.script_by_block(mixed).alias("script"))
    return rows.groupBy("script").agg(F.count(F.lit(1)).alias("n"))

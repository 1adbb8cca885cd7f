"""Sampling, split, eligibility and log-consistency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlab.catalog import query
from utterlab.functions import text as tx
from utterlab.operators import logs
from utterlab.operators import sampling as s
from utterlab.sources import derived
from utterlab.sources.derived import UTT_SQL
from utterlab.sources.tables import spread, table


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source")


def has_digits(column="text"):
    return F.col(column).rlike("[0-9]{4}")


def h(seed: object, *ids: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || {i}" for i in ids) + ")"


@query(
    "sample_uniform",
    f"SELECT doc_id, lang FROM documents ORDER BY {h(7, 'doc_id')}, doc_id LIMIT 50",
)
def sample_uniform(spark, folder):
    return s.uniform(docs(spark, folder).select("doc_id", "lang"), ["doc_id"], 50, seed=7)


@query(
    "sample_shard_quota",
    f"""WITH d AS (SELECT doc_id, source, regexp_matches(text, '[0-9]{{4}}') AS is_entity
                   FROM documents),
    q AS (SELECT greatest(1, CAST(ceil(100.0 / count(DISTINCT source)) AS INT)) AS q FROM d)
    SELECT doc_id, source, is_entity FROM d, q
    QUALIFY is_entity OR row_number() OVER (PARTITION BY source, is_entity
      ORDER BY {h(3, 'doc_id')}, doc_id) <= q""",
)
def sample_shard_quota(spark, folder):
    out = s.shard_quota(
        docs(spark, folder), "source", ["doc_id"], has_digits(), n_clean=100, seed=3
    )
    return out.select("doc_id", "source", "is_entity")


@query(
    "sample_cluster",
    f"""WITH d AS (SELECT doc_id, source, regexp_matches(text, '[0-9]{{4}}') AS is_entity
                   FROM documents),
    g AS (SELECT source, count(*) FILTER (WHERE is_entity) AS n FROM d GROUP BY source),
    b AS (SELECT source, coalesce(sum(n) OVER (ORDER BY {h(5, 'source')}, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
    r AS (SELECT d.* FROM d JOIN b USING (source) WHERE before < 30)
    SELECT doc_id, source, is_entity FROM r WHERE is_entity
    UNION ALL
    (SELECT doc_id, source, is_entity FROM r WHERE NOT is_entity
     ORDER BY {h(5, 'doc_id')}, doc_id LIMIT 60)""",
)
def sample_cluster(spark, folder):
    out = s.cluster_sample(
        docs(spark, folder), "source", ["doc_id"], has_digits(), min_entity=30, n_clean=60, seed=5
    )
    return out.select("doc_id", "source", "is_entity")


@query(
    "sample_duration_budget",
    f"""WITH e AS (SELECT event_id, round(value * 100)::BIGINT AS cs,
        sum(round(value * 100)::BIGINT) OVER (ORDER BY {h(1, 'event_id')}, event_id) AS run
      FROM events)
    SELECT event_id, cs FROM e WHERE run <= 2000000""",
)
def sample_duration_budget(spark, folder):
    clips = table(spark, folder, "events").select(
        "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cs")
    )
    return s.duration_budget(clips, ["event_id"], "cs", 2_000_000, seed=1)


@query(
    "sample_profile",
    f"""WITH e AS (SELECT event_id, event_type, round(value * 100)::BIGINT AS cs,
        sum(round(value * 100)::BIGINT) OVER (ORDER BY {h(1, 'event_id')}, event_id) AS run
      FROM events)
    SELECT event_type, count(*) AS n_clips, CAST(sum(cs) AS BIGINT) AS total_cs,
      max(cs) AS longest_cs, round(sum(cs) / 360000 * 30, 6) AS cost
    FROM e WHERE run <= 2000000 GROUP BY event_type""",
)
def sample_profile(spark, folder):
    return (
        sample_duration_budget(spark, folder)
        .join(table(spark, folder, "events").select("event_id", "event_type"), "event_id")
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n_clips"),
            F.sum("cs").alias("total_cs"),
            F.max("cs").alias("longest_cs"),
            F.round(F.sum("cs") / 360000 * 30, 6).alias("cost"),
        )
    )


@query(
    "split_by_row",
    f"""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
    SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang
        ORDER BY {h(0, 'doc_id')}, doc_id) <= round_even(n * 0.3::DOUBLE, 0)
      THEN 'dev' ELSE 'test' END AS split
    FROM documents JOIN n USING (lang)""",
)
def split_by_row(spark, folder):
    rows = docs(spark, folder).select("doc_id", "lang")
    return s.row_split(rows, "lang", ["doc_id"])


@query(
    "split_by_speaker",
    """SELECT source, list_reduce(list_transform(string_split(sha256(source), ''),
        lambda h: CAST(strpos('0123456789abcdef', h) - 1 AS BIGINT)),
        lambda a, d: (a * 16 + d) % 100) < 30 AS is_dev, count(*) AS n
    FROM documents GROUP BY source""",
)
def split_by_speaker(spark, folder):
    return (
        docs(spark, folder)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("is_dev", s.is_dev_speaker(F.col("source")))
    )


@query(
    "sample_stratified",
    f"""SELECT doc_id, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {h(0, 'doc_id')}, doc_id) <= 25""",
)
def sample_stratified(spark, folder):
    rows = docs(spark, folder).select("doc_id", "lang")
    return s.stratified(rows, "lang", ["doc_id"], 25)[0].select("doc_id", "lang")


@query(
    "sample_shortfall",
    """SELECT lang, count(*) AS available, greatest(150 - count(*), 0) AS shortfall
    FROM documents GROUP BY lang""",
)
def sample_shortfall(spark, folder):
    rows = docs(spark, folder).select("doc_id", "lang")
    return s.stratified(rows, "lang", ["doc_id"], 150)[1]


@query(
    "file_order_head",
    """SELECT event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 40""",
)
def file_order_head(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type")
    return s.file_order_head(rows, ["event_type"], "event_id", 40)


@query(
    "manifest_index",
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type
      ORDER BY event_id) - 1 AS idx FROM events""",
)
def manifest_index(spark, folder):
    rows = table(spark, folder, "events").select("event_type", "event_id")
    ranked = s.ranked(
        rows, ["event_type"], F.floor(F.col("event_id") / 1_000_000), ["event_id"], "rank"
    )
    return ranked.select("event_type", "event_id", (F.col("rank") - 1).alias("idx"))


@query(
    "eligibility_reasons",
    """WITH a AS (SELECT doc_id AS uttid, 1.0 + quality * 20 + toxic * 15 AS seconds FROM labels),
    r AS (SELECT CASE WHEN a.uttid IS NULL THEN 'no_audio'
        WHEN text = '' OR contains(text, '<') THEN 'empty_or_tagged_reference'
        WHEN NOT seconds BETWEEN 1.0 AND 29.5 THEN 'duration_out_of_range' END AS reason
      FROM documents LEFT JOIN a ON a.uttid = doc_id)
    SELECT reason, count(*) AS n FROM r GROUP BY reason""",
)
def eligibility_reasons(spark, folder):
    refs = docs(spark, folder).select(F.col("doc_id").alias("uttid"), "text")
    audio = table(spark, folder, "labels").select(
        F.col("doc_id").alias("uttid"),
        (1.0 + F.col("quality") * 20 + F.col("toxic") * 15).alias("seconds"),
    )
    return s.eligibility(refs, audio).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "repeat_agreement",
    f"""WITH {UTT_SQL} SELECT count(*) AS n,
      count(*) FILTER (WHERE a.raw_text = b.raw_text) AS n_identical,
      round(count(*) FILTER (WHERE a.raw_text = b.raw_text) / count(*), 9) AS fraction_identical
    FROM trans a JOIN trans b USING (example_id)
    WHERE a.stt = 'alpha' AND a.condition = 'clean' AND b.stt = 'beta'""",
)
def repeat_agreement(spark, folder):
    log = derived.transcripts(spark, folder)
    first = log.where("stt = 'alpha' AND condition = 'clean'")
    out = s.repeat_agreement(first, log.where("stt = 'beta'"), ["example_id"], "raw_text")
    return out.withColumn("fraction_identical", F.round("fraction_identical", 9))


@query(
    "work_list_transcripts",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def work_list_transcripts(spark, folder):
    return logs.missing(
        docs(spark, folder).select("doc_id"), table(spark, folder, "labels"), ["doc_id"]
    )


@query(
    "reuse_transcripts",
    """WITH cached AS (
      SELECT conv_id, arg_max(text, turn) AS raw_text FROM conversations GROUP BY conv_id)
    SELECT doc_id AS conv_id, c.conv_id IS NOT NULL AS reused,
           coalesce(c.raw_text, 'fresh') AS raw_text
    FROM documents LEFT JOIN cached c ON c.conv_id = doc_id""",
)
def reuse_transcripts(spark, folder):
    log = table(spark, folder, "conversations").select(
        "conv_id", F.col("text").alias("raw_text"), F.col("turn").alias("ingest_pos")
    )
    wanted = docs(spark, folder).select(F.col("doc_id").alias("conv_id"))
    return logs.reuse_transcripts(wanted, log, ["conv_id"], F.lit("fresh"))


@query(
    "row_drift",
    "SELECT doc_id, text FROM documents WHERE text <> rtrim(text) OR contains(text, '@')",
)
def row_drift(spark, folder):
    now = docs(spark, folder).select("doc_id", "text")
    then = now.withColumn("text", F.replace(F.rtrim("text"), F.lit("@"), F.lit("")))
    return logs.drifted_rows(now, then, ["doc_id"], "text")


@query(
    "report_cross_check",
    """WITH r AS (SELECT lang, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY lang)
    SELECT count(*) AS n_compared, 0.0::DOUBLE AS max_gap, 0::BIGINT AS n_one_sided,
           true AS agrees FROM r""",
)
def report_cross_check(spark, folder):
    base = table(spark, folder, "documents").groupBy("lang")
    a = base.agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"))
    b = base.agg(
        F.sum(F.lit(1)).alias("n"), (F.sum("n_chars") / F.count("n_chars")).alias("mean")
    )
    return logs.report_difference(a, b, ["lang"], ["n", "mean"])


@query(
    "corpus_fingerprint",
    """SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(doc_id || '|' || text), 1, 15))
      AS HUGEINT)) AS VARCHAR) AS digest FROM documents""",
)
def corpus_fingerprint(spark, folder):
    return logs.fingerprint(spread(docs(spark, folder)), "doc_id", "text")


@query(
    "transcript_latest",
    """SELECT user_id, event_type, arg_max(value, event_id) AS value
    FROM events GROUP BY ALL""",
)
def transcript_latest(spark, folder):
    log = table(spark, folder, "events").select(
        "user_id", "event_type", "value", F.col("event_id").alias("ingest_pos")
    )
    return logs.latest(log, ["user_id", "event_type"])


@query(
    "speakable_turns",
    r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'),
      '\n{2,}', chr(10), 'g'), E' \t\n\r') AS spoken FROM conversations""",
)
def speakable_turns(spark, folder):
    turns = table(spark, folder, "conversations")
    # the same text as a heading, list items, nested emphasis, code and a link
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(F.trim(x) == "", x)
        .when(i == 0, F.concat(F.lit("## "), x))
        .when(i % 4 == 1, F.concat(F.lit("- "), x))
        .when(i % 4 == 2, F.concat(F.lit("12. "), x))
        .when(i % 4 == 3, F.concat(F.lit("* ["), x, F.lit("](http://a.b/c)")))
        .otherwise(F.concat(F.lit("`"), x, F.lit("`"))),
    )
    words = F.transform(
        F.split(F.array_join(lines, "\n"), " "),
        lambda w, i: F.when((i % 9 == 4) & w.rlike(r"^[\p{L}]+$"), F.concat(F.lit("**_"), w, F.lit("_**"))).otherwise(w),
    )
    return turns.select("conv_id", "turn", tx.speakable(F.array_join(words, " ")).alias("spoken"))


@query(
    "turn_sentences",
    """WITH s AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS n, unnest(p) AS raw FROM (
        SELECT conv_id, turn, regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$') AS p
        FROM conversations)),
    t AS (SELECT conv_id, turn, n, trim(raw, E' \\t\\n\\r') AS sentence FROM s)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS pos,
           sentence FROM t WHERE sentence <> ''""",
)
def turn_sentences(spark, folder):
    return (
        table(spark, folder, "conversations")
        .select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("p", "sentence"))
        .select("conv_id", "turn", F.col("p").cast("bigint").alias("pos"), "sentence")
    )


@query(
    "channel_labels",
    """SELECT l_linenumber, l_discount, l_tax, l_returnflag,
      CASE WHEN l_linenumber % 2 = 0 THEN '8k' ELSE '16k' END
      || CASE WHEN l_returnflag = 'A' THEN '-ulaw' ELSE '' END
      || CASE WHEN l_discount <> 0 THEN '-loss' || CAST(round(l_discount * 100) AS INT) || '%'
              ELSE '' END
      || CASE WHEN l_tax <> 0 THEN '-jit' || CAST(round(l_tax * 1000) AS INT) || 'ms' ELSE '' END
        AS label, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def channel_labels(spark, folder):
    label = tx.channel_label(
        F.when(F.col("l_linenumber") % 2 == 0, 8000).otherwise(16000),
        F.col("l_returnflag") == "A",
        F.col("l_discount"),
        F.col("l_tax") * 1000,
    )
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_linenumber", "l_discount", "l_tax", "l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("label", label)
    )


@query(
    "attempt_outcomes",
    """WITH a AS (SELECT *, CASE event_type WHEN 'click' THEN 400 WHEN 'view' THEN 429
        WHEN 'signup' THEN 200 + (event_id % 4) * 101 END AS status FROM events),
    o AS (SELECT CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'incomplete|connection'
      WHEN status = 400 THEN 'fail|http_400'
      WHEN status IN (408, 429) OR status >= 500 THEN 'incomplete|http_' || status
      WHEN status IS NOT NULL THEN 'fatal|http_' || status
      WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'fail|tool_validation_failed'
      WHEN event_type = 'error' THEN 'incomplete|api_error'
      WHEN value >= 20 THEN 'pass|' ELSE 'fail|' END AS o FROM a)
    SELECT string_split(o, '|')[1] AS outcome, string_split(o, '|')[2] AS error_class,
           count(*) AS n FROM o GROUP BY ALL""",
)
def attempt_outcomes(spark, folder):
    ev = table(spark, folder, "events")
    kind = F.col("event_type")
    status = (
        F.when(kind == "click", 400)
        .when(kind == "view", 429)
        .when(kind == "signup", 200 + (F.col("event_id") % 4) * 101)
    )
    message = F.when(
        kind == "error",
        F.when(F.col("user_id") % 2 == 0, "Tool call validation failed: x").otherwise("boom"),
    )
    lost = (kind == "purchase") & (F.col("user_id") % 3 == 0)
    return (
        ev.select(tx.attempt_outcome(status, message, lost, F.col("value") >= 20).alias("o"))
        .groupBy("o.outcome", "o.error_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )

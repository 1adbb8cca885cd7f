"""Error-rate queries over transcript logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from utterlab.catalog import query
from utterlab.catalog.resamples import ratio_sql
from utterlab.catalog.noise import P_SQL
from utterlab.functions import text as tx
from utterlab.functions.numbers import digit_strings, digit_text, to_digit_text
from utterlab.operators import logs, pairing
from utterlab.operators.bootstrap import ratio_ci
from utterlab.operators.sampling import is_dev_speaker
from utterlab.plans import wer
from utterlab.sources import derived
from utterlab.sources.derived import UTT_SQL, canonical_sql, scored_sql
from utterlab.sources.tables import spread, table

SCORED_SQL = f"""{UTT_SQL},{scored_sql("trans")}"""


@query(
    "wer_by_arm",
    f"""WITH {SCORED_SQL}
SELECT stt, condition, count(*) AS n_rows, CAST(sum(edits) AS BIGINT) AS edits,
       CAST(sum(ref_words) AS BIGINT) AS reference_words,
       round(sum(edits) / sum(ref_words), 9) AS wer
FROM scored GROUP BY stt, condition""",
)
def wer_by_arm(spark, folder):
    scored = scored_log(spark, folder)
    out = wer.corpus_wer(scored, "stt", "condition")
    return out.select(
        "stt",
        "condition",
        "n_rows",
        "edits",
        "reference_words",
        F.round("wer", 9).alias("wer"),
    )


def canonical_transcripts(spark, folder, **once):
    """Transcripts with the canonical form of both texts; what belongs to the utterance alone
    (its own canonical form, and ``once``) is computed before its arms are set apart."""
    once = {"ref_text": tx.canonical_text(F.col("ground_truth_text"))} | once
    return derived.transcripts(spark, folder, once).withColumn(
        "hyp_text", tx.canonical_text(F.col("raw_text"))
    )


def scored_log(spark, folder, **once):
    log = canonical_transcripts(spark, folder, **once)
    return wer.score(log, F.col("ref_text"), F.col("hyp_text"), kinds=False)


def _is_dev_sql(column: str) -> str:
    """sha256 modulo 100, folded digit by digit; below 30 is the dev split."""
    return (
        f"list_reduce(list_transform(string_split(sha256({column}), ''), "
        "lambda h: CAST(strpos('0123456789abcdef', h) - 1 AS BIGINT)), "
        "lambda a, d: (a * 16 + d) % 100) < 30"
    )


@query(
    "wer_by_slice",
    f"""WITH {SCORED_SQL}, flagged AS (
      SELECT *, NOT ({_is_dev_sql("source")}) AS is_test,
             regexp_matches(ground_truth_text, '[0-9]') AS ent FROM scored)
    SELECT stt, condition, count(*) AS all_rows, CAST(sum(ref_words) AS BIGINT) AS all_words,
      round(sum(edits) / sum(ref_words), 9) AS all_wer,
      count(*) FILTER (WHERE is_test) AS test_rows,
      CAST(sum(ref_words) FILTER (WHERE is_test) AS BIGINT) AS test_words,
      round(sum(edits) FILTER (WHERE is_test) / sum(ref_words) FILTER (WHERE is_test), 9)
        AS test_wer,
      count(*) FILTER (WHERE is_test AND ent) AS test_entity_rows,
      CAST(sum(ref_words) FILTER (WHERE is_test AND ent) AS BIGINT) AS test_entity_words,
      round(sum(edits) FILTER (WHERE is_test AND ent)
            / sum(ref_words) FILTER (WHERE is_test AND ent), 9) AS test_entity_wer,
      count(*) FILTER (WHERE is_test AND NOT ent) AS test_clean_rows,
      CAST(sum(ref_words) FILTER (WHERE is_test AND NOT ent) AS BIGINT) AS test_clean_words,
      round(sum(edits) FILTER (WHERE is_test AND NOT ent)
            / sum(ref_words) FILTER (WHERE is_test AND NOT ent), 9) AS test_clean_wer
    FROM flagged GROUP BY stt, condition""",
)
def wer_by_slice(spark, folder):
    once = {
        "is_test": ~is_dev_speaker(F.col("source")),
        "is_entity": F.col("ground_truth_text").rlike("[0-9]"),
    }
    scored = scored_log(spark, folder, **once)
    out = wer.wer_slices(scored, F.col("is_test"), F.col("is_entity"), "stt", "condition")
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith("_wer")})


@query(
    "wer_per_utterance",
    f"""WITH {SCORED_SQL} SELECT example_id, stt, condition, CAST(edits AS INT) AS edits,
      CAST(ref_words AS INT) AS ref_words, CAST(hyp_words AS INT) AS hyp_words,
      round(CASE WHEN ref_words > 0 THEN edits / ref_words WHEN hyp_words = 0 THEN 0.0
                 ELSE 1.0 END, 9) AS utt_wer FROM scored""",
)
def wer_per_utterance(spark, folder):
    scored = scored_log(spark, folder)
    return scored.select(
        "example_id",
        "stt",
        "condition",
        "edits",
        "ref_words",
        "hyp_words",
        F.round("utt_wer", 9).alias("utt_wer"),
    )


@query(
    "wer_edit_types",
    f"""WITH {SCORED_SQL} SELECT stt, condition, count(*) AS n_rows,
      CAST(sum(edits) AS BIGINT) AS all_edits,
      CAST(sum(ref_words) - sum(hyp_words) AS BIGINT) AS deletions_less_insertions,
      CAST(sum(ref_words) AS BIGINT) AS reference_words FROM scored GROUP BY stt, condition""",
)
def wer_edit_types(spark, folder):
    """Which of equal alignments is taken splits S, D and I; their sum and D - I are fixed."""
    scored = scored_log(spark, folder)
    out = wer.corpus_wer(scored, "stt", "condition")
    return out.select(
        "stt",
        "condition",
        "n_rows",
        F.col("edits").alias("all_edits"),
        (F.col("reference_words") - F.col("hypothesis_words")).alias("deletions_less_insertions"),
        "reference_words",
    )


def digit_text_sql(tokens: str) -> str:
    """Neighbouring digit tokens merged unless one has over four digits (the prose
    holds no number words)."""
    return rf"""CASE WHEN len({tokens}) = 0 THEN '' ELSE array_to_string(list_transform(
      list_reduce(list_transform({tokens}, lambda t: [t]), lambda acc, x:
        CASE WHEN regexp_matches(acc[len(acc)], '^[0-9|]+$') AND regexp_matches(x[1], '^[0-9]+$')
             THEN list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || '|' || x[1]])
             ELSE list_concat(acc, x) END),
      lambda g: CASE WHEN NOT contains(g, '|') THEN g
                     WHEN regexp_matches(g, '[0-9]{{5}}') THEN replace(g, '|', ' ')
                     ELSE replace(g, '|', '') END), ' ') END"""


DIGITS_SQL = f"""{SCORED_SQL},
digits AS (
  SELECT *, {digit_text_sql("ref")} AS ref_digits, {digit_text_sql("hyp")} AS hyp_digits
  FROM scored
)"""


def numbered(spark, folder):
    """Transcripts with the digit form of both texts."""
    log = canonical_transcripts(spark, folder, ref_digits=digit_text(tx.nfc(F.col("ref_text"))))
    return log.withColumn("hyp_digits", digit_text(tx.nfc(F.col("hyp_text"))))


@query(
    "wer_number_normalised",
    f"""WITH {DIGITS_SQL}, {scored_sql("digits", "ref_digits", "hyp_digits", "n_")}
    SELECT stt, condition, round(sum(edits) / sum(ref_words), 9) AS raw,
      round(sum(n_edits) / sum(n_ref_words), 9) AS number_normalised,
      round(100 * (sum(edits) / sum(ref_words) - sum(n_edits) / sum(n_ref_words)), 6)
        AS inflation_pp
    FROM n_scored GROUP BY stt, condition""",
)
def wer_number_normalised(spark, folder):
    df = wer.score(numbered(spark, folder), F.col("ref_text"), F.col("hyp_text"), kinds=False)
    df = wer.score(df, F.col("ref_digits"), F.col("hyp_digits"), "n_", kinds=False)
    raw = wer.corpus_rate(F.col("edits"), F.col("ref_words"))
    normal = wer.corpus_rate(F.col("n_edits"), F.col("n_ref_words"))
    return (
        df.groupBy("stt", "condition")
        .agg(raw.alias("raw"), normal.alias("number_normalised"))
        .withColumn("inflation_pp", F.round(100 * (F.col("raw") - F.col("number_normalised")), 6))
        .withColumns({c: F.round(c, 9) for c in ("raw", "number_normalised")})
    )


UNITS_SQL = f"""{DIGITS_SQL},
wanted AS (
  SELECT example_id, stt, condition, source, unit, count(*) AS n FROM (
    SELECT *, unnest(regexp_extract_all(ref_digits, '[0-9]{{4,}}')) AS unit FROM digits)
  GROUP BY ALL
),
heard AS (
  SELECT example_id, stt, condition, unit, count(*) AS h FROM (
    SELECT *, unnest(regexp_extract_all(hyp_digits, '[0-9]{{4,}}')) AS unit FROM digits)
  GROUP BY ALL
),
units AS (
  SELECT w.*, least(n, coalesce(h, 0)) AS hit FROM wanted w
  LEFT JOIN heard h USING (example_id, stt, condition, unit)
)"""


def with_units(spark, folder):
    """Units of the utterances that have any; only their transcripts are read for digits."""
    wanted = digit_strings(to_digit_text(F.col("ground_truth_text")))
    log = derived.transcripts(spark, folder, {"wanted": wanted}).where(F.size("wanted") > 0)
    df = log.withColumn("heard", digit_strings(to_digit_text(F.col("raw_text"))))
    return df.withColumn("units", pairing.matched_units(F.col("wanted"), F.col("heard")))


@query(
    "digit_exact_match",
    f"""WITH {UNITS_SQL}, s AS (
      SELECT stt, condition, CAST(sum(hit) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n
      FROM units GROUP BY ALL),
    w AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS d FROM s)
    SELECT stt, condition, k, n, round(p, 9) AS rate,
      round(greatest(0, ((p + 3.8416 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n
        + 3.8416 / (4 * n * n))) / d), 9) AS lo,
      round(least(1, ((p + 3.8416 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n
        + 3.8416 / (4 * n * n))) / d), 9) AS hi FROM w""",
)
def digit_exact_match(spark, folder):
    out = pairing.match_rate(with_units(spark, folder), "units", ["stt", "condition"])
    return out.withColumns({c: F.round(c, 9) for c in ("rate", "lo", "hi")})


@query(
    "digit_density",
    f"""WITH {UNITS_SQL}, base AS (
      SELECT example_id, source, ref_digits, NOT ({_is_dev_sql("source")}) AS is_test
      FROM digits WHERE stt = 'alpha' AND condition = 'clean'),
    u AS (SELECT example_id, is_test, unnest(regexp_extract_all(ref_digits, '[0-9]{{4,}}')) AS unit
          FROM base)
    SELECT CASE WHEN is_test THEN 'test' ELSE 'dev' END AS split,
      count(DISTINCT example_id) AS rows_with_units, count(*) AS n_units,
      array_to_string(list_sort(list(DISTINCT length(unit))), ',') AS lengths_seen,
      CASE WHEN count(*) >= 100 THEN 'pass (>= 100)' WHEN count(*) >= 30
           THEN 'report intervals (30-100)' ELSE 'fail (< 30)' END AS density_check
    FROM u GROUP BY is_test""",
)
def digit_density(spark, folder):
    base = (
        derived.utterances(spark, folder)
        .withColumn("units", digit_strings(to_digit_text(F.col("ground_truth_text"))))
        .where(F.size("units") > 0)
        .withColumn("split", F.when(is_dev_speaker(F.col("source")), "dev").otherwise("test"))
    )
    by_length = (
        base.select("split", F.posexplode("units").alias("at", "unit"))
        .groupBy("split", F.length("unit").alias("length"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 0).alias("firsts"))
    )
    return by_length.groupBy("split").agg(
        F.sum("firsts").alias("rows_with_units"),
        F.sum("n").alias("n_units"),
        F.array_join(F.array_sort(F.collect_list("length")).cast("array<string>"), ",").alias(
            "lengths_seen"
        ),
    ).withColumn(
        "density_check",
        F.when(F.col("n_units") >= 100, "pass (>= 100)")
        .when(F.col("n_units") >= 30, "report intervals (30-100)")
        .otherwise("fail (< 30)"),
    )


@query(
    "channel_digits",
    f"""WITH {UNITS_SQL}, p AS (
      SELECT c.n, c.hit AS a, d.hit AS b FROM units c JOIN units d
        ON c.example_id = d.example_id AND c.unit = d.unit
      WHERE c.stt = 'alpha' AND d.stt = 'alpha' AND c.condition = 'clean'
        AND d.condition = 'degraded'),
    s AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(a) AS BIGINT) AS clean_k,
      CAST(sum(b) AS BIGINT) AS degraded_k,
      CAST(sum(greatest(a - b, 0)) AS BIGINT) AS worse,
      CAST(sum(greatest(b - a, 0)) AS BIGINT) AS better FROM p),
    t AS (SELECT *, worse AS a, better AS b, 100 * (clean_k - degraded_k) / n AS drop_pp FROM s),
    r AS (SELECT *, {P_SQL} AS mcnemar_p FROM t)
    SELECT n, clean_k, degraded_k, worse, better, round(clean_k / n, 9) AS clean_rate,
      round(degraded_k / n, 9) AS degraded_rate, round(drop_pp, 6) AS drop_pp, mcnemar_p,
      drop_pp >= 5 AND mcnemar_p < 0.05 AS degrades FROM r""",
)
def channel_digits(spark, folder):
    wide = derived.paired_transcripts(spark, folder)
    digits = {
        c: digit_strings(to_digit_text(F.col(t)))
        for c, t in (
            ("wanted", "ground_truth_text"),
            ("clean", "alpha_clean"),
            ("degraded", "alpha_degraded"),
        )
    }
    units = wide.withColumns(digits).where(F.size("wanted") > 0)
    units = units.select(
        pairing.matched_units(F.col("wanted"), F.col("clean")).alias("c"),
        pairing.matched_units(F.col("wanted"), F.col("degraded")).alias("d"),
    ).withColumn("x", pairing.discordant(F.col("c"), F.col("d")))
    sums = units.agg(
        F.sum(pairing.total(F.col("c"), "n")).alias("n"),
        F.sum(pairing.total(F.col("c"), "hit")).alias("clean_k"),
        F.sum(pairing.total(F.col("d"), "hit")).alias("degraded_k"),
        F.sum("x.only_a").alias("worse"),
        F.sum("x.only_b").alias("better"),
    )
    out = pairing.degradation(sums)
    return out.withColumns(
        {c: F.round(c, 9) for c in ("clean_rate", "degraded_rate")}
        | {c: F.round(c, 6) for c in ("drop_pp", "mcnemar_p")}
    )


@query(
    "telephone_wer_intervals",
    f"""WITH {SCORED_SQL}, p AS (
      SELECT stt, condition, sum(edits) / sum(ref_words) AS wer,
             CAST(sum(ref_words) AS BIGINT) AS reference_words, count(*) AS utterances
      FROM scored GROUP BY stt, condition),
    g AS (SELECT *, 100 * (wer - min(CASE WHEN condition = 'clean' THEN wer END)
                           OVER (PARTITION BY stt)) AS gap FROM p),
    {ratio_sql("ends", "scored", ["stt", "condition"], "edits", "ref_words", upper_shift=1)}
    SELECT stt, condition, round(wer, 9) AS wer, reference_words, utterances,
      round(gap, 6) AS gap_pp, round(lo, 9) AS lo, round(hi, 9) AS hi
    FROM g JOIN ends USING (stt, condition)""",
)
def telephone_wer_intervals(spark, folder):
    scored = scored_log(spark, folder)
    keys = ["stt", "condition"]
    # one alignment: equal (edits, words) collapse, and both reports read the counts
    counted = scored.groupBy(*keys, "edits", "ref_words").agg(F.count(F.lit(1)).alias("rows"))
    point = counted.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("edits") * F.col("rows")), F.sum(F.col("ref_words") * F.col("rows"))).alias("wer"),
        F.sum(F.col("ref_words") * F.col("rows")).alias("reference_words"),
        F.sum("rows").alias("utterances"),
    )
    ci = ratio_ci(counted, keys, "edits", "ref_words", upper_shift=1, count="rows")
    clean = F.min(F.when(F.col("condition") == "clean", F.col("wer"))).over(
        Window.partitionBy("stt")
    )
    return (
        point.join(ci, keys)
        .withColumn("gap_pp", F.round(100 * (F.col("wer") - clean), 6))
        .withColumns({c: F.round(c, 9) for c in ("wer", "lo", "hi")})
    )


@query(
    "common_utterances",
    f"""WITH {UTT_SQL}, kept AS (
      SELECT * FROM trans WHERE raw_text <> '')
    SELECT stt, condition, count(*) AS n FROM kept WHERE example_id IN (
      SELECT example_id FROM kept GROUP BY example_id
      HAVING count(DISTINCT stt || condition) = 3) GROUP BY ALL""",
)
def common_utterances(spark, folder):
    kept = (
        derived.transcripts(spark, folder)
        .where("raw_text <> ''")
        .withColumn("arm", F.concat_ws("/", "stt", "condition"))
    )
    return (
        logs.common_to_all(kept, "example_id", "arm", 3)
        .groupBy("stt", "condition")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "script_histogram",
    """SELECT lang, CASE WHEN regexp_matches(text, '\\p{L}') THEN 'latin' ELSE 'none' END
      AS script, count(*) AS n_rows, count(*) FILTER (WHERE trim(text) = '') AS n_empty
    FROM documents GROUP BY ALL""",
)
def script_histogram(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    return (
        docs.groupBy("lang", tx.dominant_script(F.col("text")).alias("script"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(tx.is_blank(F.col("text"))).alias("n_empty"))
    )


@query(
    "canonical_texts",
    f"SELECT doc_id, {canonical_sql('text')} AS canonical FROM documents",
)
def canonical_texts(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tx.canonical_text(F.col("text")).alias("canonical"))

"""Tool-call judging and rater agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlab.catalog import query
from utterlab.catalog.resamples import agreement_sql
from utterlab.functions import text as tx
from utterlab.operators import judging as j
from utterlab.operators import logs
from utterlab.operators.bootstrap import RESAMPLES
from utterlab.plans import judges
from utterlab.sources import derived
from utterlab.sources.derived import CALLS_SQL
from utterlab.sources.tables import table

CELL = ["language", "example_id", "condition", "run"]


def prepared(spark, folder):
    return j.prepare(derived.tool_calls(spark, folder))


def verdicts(population):
    """A stand-in for the model judge: equivalent when the value has even length."""
    return population.select(
        "key",
        (F.length("returned_value") % 2 == 0).alias("equivalent"),
        F.when(F.length("returned_value") % 5 == 0, "unparsed")
        .when(F.length("returned_value") % 7 == 0, "incomplete")
        .otherwise("scored")
        .alias("status"),
    )


VERDICT_SQL = f"""{CALLS_SQL},
population AS (
  SELECT key, arg_min(returned_value, ingest_pos) AS returned_value,
         arg_min(accepted_values, ingest_pos) AS accepted_values,
         min(language) AS language, min(example_id) AS example_id, min(parameter) AS parameter
  FROM keyed GROUP BY key
),
verdicts AS (
  SELECT key, length(returned_value) % 2 = 0 AS equivalent,
         CASE WHEN length(returned_value) % 5 = 0 THEN 'unparsed'
              WHEN length(returned_value) % 7 = 0 THEN 'incomplete' ELSE 'scored' END AS status
  FROM population
)"""


@query(
    "judge_calls",
    f"""WITH {CALLS_SQL} SELECT language, example_id, condition, run,
      reached AND brand_good AND words_exact AS exact_ok,
      reached AND brand_good AND words_listed AS list_ok,
      CASE WHEN called_name IS NULL THEN '' ELSE array_to_string(list_filter([
        CASE WHEN NOT brand_good THEN 'brand' END,
        CASE WHEN NOT no_words AND NOT words_exact THEN 'words' END],
        lambda x: x IS NOT NULL), ',') END AS mismatching
    FROM judged""",
)
def judge_calls(spark, folder):
    bad = F.array_join(F.array_sort(j.mismatches(False)), ",")
    return prepared(spark, folder).select(
        *CELL,
        j.verdict(False).alias("exact_ok"),
        j.verdict(True).alias("list_ok"),
        F.when(F.col("called_name").isNotNull(), bad).otherwise(F.lit("")).alias("mismatching"),
    )


@query(
    "judge_failures",
    f"""WITH {CALLS_SQL}, f AS (
      SELECT language, run,
        CASE WHEN error_class = 'tool_validation_failed' THEN 'provider_rejected'
             WHEN called_name IS NULL THEN 'no_call'
             WHEN called_name <> 'find_part' THEN 'wrong_function'
             WHEN no_words THEN 'missing_argument' ELSE 'value_mismatch' END AS category,
        NOT words_exact AS listed, NOT brand_good AND brand = 'ब्रांड' AS deva
      FROM judged WHERE condition = 'gt' AND outcome = 'fail')
    SELECT language, run, category, count(*) AS n,
      count(*) FILTER (WHERE category = 'value_mismatch' AND listed) AS n_list_valued,
      count(*) FILTER (WHERE category = 'value_mismatch' AND deva) AS n_devanagari,
      count(*) FILTER (WHERE category = 'value_mismatch' AND NOT listed AND NOT deva) AS n_other
    FROM f GROUP BY ROLLUP (language, run, category)""",
)
def judge_failures(spark, folder):
    return judges.failure_report(prepared(spark, folder))


@query(
    "judge_rejudge_check",
    f"""WITH {CALLS_SQL} SELECT count(*) AS n_cells, count(*) FILTER (
      WHERE (reached AND brand_good AND words_exact) <> (outcome = 'pass')) AS n_disagree
    FROM judged""",
)
def judge_rejudge_check(spark, folder):
    return judges.rejudge_disagreements(prepared(spark, folder))


@query(
    "judge_rescored_rates",
    f"""WITH {CALLS_SQL} SELECT language, condition, count(*) AS n,
      count(*) FILTER (WHERE reached AND brand_good AND words_listed) AS n_pass
    FROM judged GROUP BY ALL""",
)
def judge_rescored_rates(spark, folder):
    log = judges.rescored(prepared(spark, folder), list_aware=True)
    return log.groupBy("language", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "pass").alias("n_pass")
    )


@query(
    "judge_population",
    f"""WITH {VERDICT_SQL} SELECT key, language, example_id, parameter, returned_value,
      accepted_values FROM population""",
)
def judge_population(spark, folder):
    return j.judged_population(prepared(spark, folder)).select(
        "key", "language", "example_id", "parameter", "returned_value", "accepted_values"
    )


@query(
    "judge_three_way",
    f"""WITH {VERDICT_SQL}, cell AS (
      SELECT language, example_id, condition, run, bool_and(v.equivalent) AS all_eq
      FROM keyed k JOIN verdicts v USING (key) GROUP BY ALL)
    SELECT j.language, j.condition, count(*) AS n,
      round(100 * avg((reached AND brand_good AND words_exact)::INT), 6) AS registered_pct,
      round(100 * avg((reached AND brand_good AND words_listed)::INT), 6) AS list_aware_pct,
      round(100 * avg((reached AND coalesce(all_eq, true))::INT), 6) AS meaning_pct
    FROM judged j LEFT JOIN cell c ON j.language = c.language AND j.example_id = c.example_id
      AND j.condition = c.condition AND j.run = c.run
    GROUP BY ALL""",
)
def judge_three_way(spark, folder):
    calls = prepared(spark, folder)
    found = verdicts(j.judged_population(calls))
    return judges.three_judges(calls, found, CELL).withColumns(
        {c: F.round(c, 6) for c in ("registered_pct", "list_aware_pct", "meaning_pct")}
    )


@query(
    "judge_verdict_status",
    f"""WITH {VERDICT_SQL} SELECT count(*) AS n_items,
      count(*) FILTER (WHERE status = 'scored') AS scored,
      count(*) FILTER (WHERE status = 'unparsed') AS unparsed,
      count(*) FILTER (WHERE status = 'incomplete') AS incomplete,
      count(*) FILTER (WHERE status = 'scored') = count(*) AS complete FROM verdicts""",
)
def judge_verdict_status(spark, folder):
    return judges.verdict_status(verdicts(j.judged_population(prepared(spark, folder))))


@query(
    "work_list_verdicts",
    f"WITH {VERDICT_SQL} SELECT key FROM verdicts WHERE status = 'incomplete'",
)
def work_list_verdicts(spark, folder):
    population = j.judged_population(prepared(spark, folder))
    log = verdicts(population).withColumn("ingest_pos", F.lit(1))
    return logs.pending_verdicts(population.select("key"), log)


@query(
    "judge_array_tasks",
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'english' ELSE 'hindi' END AS language,
      count(*) AS any_array_param,
      count(*) FILTER (WHERE len(string_split(p_name, ' ')) >= 2) AS two_or_more_items,
      count(*) AS n_tasks FROM part GROUP BY 1""",
)
def judge_array_tasks(spark, folder):
    tasks = derived.tool_tasks(spark, folder).withColumn(
        "call", j.expected_call(F.col("expected_json"))
    )
    return judges.array_tasks(
        tasks.select(
            "language",
            F.col("call.arguments").alias("expected"),
            j.array_params(F.col("functions_json"), F.col("call.name")).alias("array_params"),
        )
    )


@query(
    "judge_prompts",
    f"""WITH {VERDICT_SQL}
    SELECT p.key, 'User request: find ' || t.p_name || ' by ' || t.p_brand
      || chr(10) || 'Function: find_part' || chr(10) || 'Parameter: ' || p.parameter
      || chr(10) || 'ACCEPTED value(s): ' || p.accepted_values
      || chr(10) || 'RETURNED value: ' || p.returned_value AS user_prompt
    FROM population p JOIN part t ON p.example_id = 'part_' || t.p_partkey""",
)
def judge_prompts(spark, folder):
    items = j.judged_population(prepared(spark, folder))
    messages = tx.judge_messages(
        "Do the two values mean the same?",
        F.col("query"),
        F.col("expected_name"),
        F.col("parameter"),
        F.col("accepted_values"),
        F.col("returned_value"),
    )
    return items.select("key", messages[1]["content"].alias("user_prompt"))


@query(
    "judge_verdict_text",
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN quality = 1
                          WHEN doc_id % 4 = 2 THEN toxic = 1 END AS equivalent
    FROM labels""",
)
def judge_verdict_text(spark, folder):
    labels = table(spark, folder, "labels")
    flag = F.when(F.col("quality") == 1, "true").otherwise("false")
    toxic = F.when(F.col("toxic") == 1, "true").otherwise("false")
    answer = (
        F.when(
            F.col("doc_id") % 4 == 0, F.concat(F.lit('{"equivalent": '), flag, F.lit("}"))
        )
        .when(
            F.col("doc_id") % 4 == 1,
            F.concat(F.lit('Sure: {"note": 1} then {"equivalent": '), flag, F.lit("} done")),
        )
        .when(
            F.col("doc_id") % 4 == 2,
            F.concat(F.lit('{"equivalent": "yes"} {bad} {"equivalent":'), toxic, F.lit("}")),
        )
        .otherwise(F.lit('{"equivalent": 1}'))
    )
    return labels.select("doc_id", tx.parse_verdict(answer).alias("equivalent"))


@query(
    "tool_schema_repair",
    """SELECT p_partkey, '{"type":"function","function":{"name":"f' || p_partkey
      || '","parameters":{"properties":{"n":{"default":' || p_size
      || ',"type":"number"},"o":{"properties":{"k":{"type":"string"}},"type":"object"}},'
      || '"type":"object"}}}' AS tool FROM part""",
)
def tool_schema_repair(spark, folder):
    raw = F.concat(
        F.lit('[ {"name": "f'), F.col("p_partkey").cast("string"),
        F.lit('", "parameters": {"type": "dict", "properties": {"n": {"type": "float", "default": '),
        F.col("p_size").cast("string"),
        F.lit('}, "o": {"type" : "dict", "properties": {"k": {"type": "string"}}}}}}]'),
    )
    return table(spark, folder, "part").select(
        "p_partkey", F.explode(tx.as_tools(raw)).alias("tool")
    )


RATERS_SQL = """
votes AS (SELECT doc_id, quality = 1 AS judge, toxic = 0 AS owner FROM labels),
cells AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE judge AND owner) AS both_yes,
    count(*) FILTER (WHERE judge AND NOT owner) AS yes_no,
    count(*) FILTER (WHERE NOT judge AND owner) AS no_yes,
    count(*) FILTER (WHERE NOT judge AND NOT owner) AS both_no FROM votes
)"""


def votes(spark, folder):
    return table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("judge"), (F.col("toxic") == 0).alias("owner")
    )


AGREEMENT_SQL = f"""WITH {RATERS_SQL}, r AS (
  SELECT *, (both_yes + both_no) / n AS o,
    ((both_yes + yes_no) / n) * ((both_yes + no_yes) / n)
    + ((no_yes + both_no) / n) * ((yes_no + both_no) / n) AS e FROM cells)
SELECT n, both_yes, yes_no, no_yes, both_no, round((o - e) / (1 - e), 9) AS kappa,
  round(o, 9) AS raw_agreement, both_yes + yes_no AS judge_yes, both_yes + no_yes AS owner_yes,
  (o - e) / (1 - e) >= 0.6 AS meets_threshold FROM r"""


@query("rater_agreement", AGREEMENT_SQL)
def rater_agreement(spark, folder):
    return judges.agreement(votes(spark, folder)).withColumns(
        {c: F.round(c, 9) for c in ("kappa", "raw_agreement")}
    )


@query(
    "rater_agreement_intervals",
    f"""WITH {RATERS_SQL}, {agreement_sql("ends", "cells", [])}
    SELECT * FROM ({AGREEMENT_SQL}), ends""",
)
def rater_agreement_intervals(spark, folder):
    out = judges.agreement(votes(spark, folder), resamples=RESAMPLES)
    rounded = ["kappa", "raw_agreement", "kappa_lo", "kappa_hi", "raw_lo", "raw_hi"]
    return out.withColumns({c: F.round(c, 9) for c in rounded})


LANGUAGE_SQL = """
votes AS (SELECT lang AS language, quality = 1 AS judge, toxic = 0 AS owner
          FROM labels JOIN documents USING (doc_id)),
cells AS (
  SELECT language, count(*) AS n, count(*) FILTER (WHERE judge AND owner) AS both_yes,
    count(*) FILTER (WHERE judge AND NOT owner) AS yes_no,
    count(*) FILTER (WHERE NOT judge AND owner) AS no_yes,
    count(*) FILTER (WHERE NOT judge AND NOT owner) AS both_no FROM votes GROUP BY language
)"""


@query(
    "rater_agreement_by_language",
    f"""WITH {LANGUAGE_SQL}, {agreement_sql("ends", "cells", ["language"])}, r AS (
      SELECT *, (both_yes + both_no) / n AS o,
        ((both_yes + yes_no) / n) * ((both_yes + no_yes) / n)
        + ((no_yes + both_no) / n) * ((yes_no + both_no) / n) AS e FROM cells),
    k AS (SELECT *, CASE WHEN e = 1 THEN (o = 1)::INT::DOUBLE ELSE (o - e) / (1 - e) END AS kappa_raw
          FROM r)
    SELECT language, n, both_yes, yes_no, no_yes, both_no, round(kappa_raw, 9) AS kappa,
      round(o, 9) AS raw_agreement, both_yes + yes_no AS judge_yes, both_yes + no_yes AS owner_yes,
      kappa_raw >= 0.6 AS meets_threshold, kappa_lo, kappa_hi, raw_lo, raw_hi
    FROM k JOIN ends USING (language)""",
)
def rater_agreement_by_language(spark, folder):
    """Labels meet the language of their item by key; one report per language."""
    languages = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("language"))
    joined = votes(spark, folder).join(languages, "doc_id")
    out = judges.agreement(joined, ["language"], resamples=RESAMPLES)
    rounded = ["kappa", "raw_agreement", "kappa_lo", "kappa_hi", "raw_lo", "raw_hi"]
    return out.withColumns({c: F.round(c, 9) for c in rounded})


@query(
    "rater_disagreements",
    f"WITH {RATERS_SQL} SELECT doc_id, judge, owner FROM votes WHERE judge <> owner",
)
def rater_disagreements(spark, folder):
    return judges.disagreements(votes(spark, folder))

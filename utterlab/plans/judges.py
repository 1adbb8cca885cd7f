"""Judge audit reports: failure classes, judge comparison, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlab.functions.stats import cohens_kappa
from utterlab.operators import judging as j
from utterlab.operators.bootstrap import agreement_ci


def rescored(prepared: DataFrame, list_aware: bool) -> DataFrame:
    """The log with its outcome replaced by another judge's."""
    return prepared.withColumn(
        "outcome", F.when(j.verdict(list_aware), "pass").otherwise("fail")
    )


def rejudge_disagreements(prepared: DataFrame) -> DataFrame:
    """Cells whose logged outcome the registered judge does not reproduce."""
    redo = j.verdict(list_aware=False)
    return prepared.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(redo != (F.col("outcome") == "pass")).alias("n_disagree"),
    )


def failure_report(prepared: DataFrame, condition: str = "gt") -> DataFrame:
    """Failures by language, run and category, rolled up (null = all)."""
    failed = prepared.where(
        (F.col("condition") == condition) & (F.col("outcome") == "fail")
    ).withColumn("f", j.failure_class())
    return (
        failed.select("language", "run", "f.*")
        .rollup("language", "run", "category")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("list_valued").alias("n_list_valued"),
            F.count_if("devanagari").alias("n_devanagari"),
            F.count_if("other").alias("n_other"),
        )
    )


def array_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks whose expected call uses an array parameter, and with two or more items."""
    used = F.array_intersect(F.map_keys("expected"), F.col("array_params"))
    return tasks.groupBy("language").agg(
        F.count_if(F.size(used) > 0).alias("any_array_param"),
        F.count_if(F.exists(used, lambda p: F.size(F.col("expected")[p]) >= 2)).alias(
            "two_or_more_items"
        ),
        F.count(F.lit(1)).alias("n_tasks"),
    )


def three_judges(prepared: DataFrame, verdicts: DataFrame, cell: list[str]) -> DataFrame:
    """Pass rate of the same calls under each judge, in percent.

    The verdicts are reached before the join, so no argument table is shuffled.
    """
    scored = prepared.withColumns(
        {"registered_ok": j.verdict(False), "list_aware_ok": j.verdict(True)}
    )
    both = j.meaning_outcomes(scored, verdicts, cell)
    return both.groupBy("language", "condition").agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg(F.col("registered_ok").cast("int"))).alias("registered_pct"),
        (100 * F.avg(F.col("list_aware_ok").cast("int"))).alias("list_aware_pct"),
        (100 * F.avg(F.col("meaning_ok").cast("int"))).alias("meaning_pct"),
    )


def verdict_status(verdicts: DataFrame) -> DataFrame:
    """Status counts, and whether every item is scored."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("scored", "unparsed", "incomplete")],
    ).withColumn("complete", F.col("scored") == F.col("n_items"))


def agreement(
    votes: DataFrame,
    keys: list[str] | None = None,
    threshold: float = 0.6,
    resamples: int | None = None,
) -> DataFrame:
    """Kappa and raw agreement of boolean ``judge`` and ``owner`` votes.

    Votes must already be joined by item key. With ``resamples`` the bootstrap
    intervals are added.
    """
    keys = keys or []
    a, b = F.col("judge"), F.col("owner")
    cells = votes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a & b).alias("both_yes"),
        F.count_if(a & ~b).alias("yes_no"),
        F.count_if(~a & b).alias("no_yes"),
        F.count_if(~a & ~b).alias("both_no"),
    )
    kappa = cohens_kappa(F.col("both_yes"), F.col("yes_no"), F.col("no_yes"), F.col("both_no"))
    report = cells.withColumns(
        {
            "kappa": kappa,
            "raw_agreement": (F.col("both_yes") + F.col("both_no")) / F.col("n"),
            "judge_yes": F.col("both_yes") + F.col("yes_no"),
            "owner_yes": F.col("both_yes") + F.col("no_yes"),
        }
    ).withColumn("meets_threshold", F.col("kappa") >= threshold)
    if resamples is None:
        return report
    drawn = agreement_ci(cells, keys, resamples)
    names = ["both_yes", "yes_no", "no_yes", "both_no"]
    return report.join(drawn, [*keys, *names])


def disagreements(votes: DataFrame) -> DataFrame:
    return votes.where(F.col("judge") != F.col("owner"))

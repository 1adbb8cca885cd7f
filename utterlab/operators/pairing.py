"""Paired comparison of arms: multiset matches and clean/degraded outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlab.functions.stats import mcnemar_p, rate
from utterlab.functions.text import let

UNIT_COUNTS = "array<struct<unit:string,k:int>>"


def matched_units(wanted: Column, heard: Column) -> Column:
    """array<struct<unit, n, hit>> per distinct wanted unit: how often it is wanted
    and how many of those are matched, each heard unit used once.

    Equal to striking heard units off one by one, since the first ``hit``
    occurrences are the ones that match.
    """

    def count(units: Column, unit: Column) -> Column:
        return F.size(F.filter(units, lambda u: u == unit))

    return F.transform(
        F.array_distinct(wanted),
        lambda unit: let(
            F.struct(count(wanted, unit).alias("n"), count(heard, unit).alias("h")),
            lambda c: F.struct(
                unit.alias("unit"), c["n"].alias("n"), F.least(c["n"], c["h"]).alias("hit")
            ),
        ),
    )


def total(units: Column, field: str) -> Column:
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda s, u: s + u[field])


def match_rate(matches: DataFrame, units: str, keys: list[str]) -> DataFrame:
    """Units matched, units wanted, their rate and Wilson interval per group."""
    sums = matches.groupBy(*keys).agg(
        F.sum(total(F.col(units), "hit")).alias("k"), F.sum(total(F.col(units), "n")).alias("n")
    )
    r = rate(F.col("k"), F.col("n"))
    return sums.withColumns({"rate": r["rate"], "lo": r["lo"], "hi": r["hi"]})


def discordant(a: Column, b: Column) -> Column:
    """struct<only_a, only_b> over two matched-unit arrays of the same wanted units."""
    pairs = F.zip_with(a, b, lambda x, y: x["hit"] - y["hit"])
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.aggregate(pairs, zero, lambda s, d: s + F.greatest(d, F.lit(0))).alias("only_a"),
        F.aggregate(pairs, zero, lambda s, d: s + F.greatest(-d, F.lit(0))).alias("only_b"),
    )


def degradation(
    counts: DataFrame, min_drop_pp: float = 5.0, alpha: float = 0.05
) -> DataFrame:
    """``counts`` has n, clean_k, degraded_k, worse, better per group; add rates, the
    drop in points, the exact p and whether the condition degrades the measure."""
    drop = 100 * F.try_divide(F.col("clean_k") - F.col("degraded_k"), F.col("n"))
    return (
        counts.withColumn("clean_rate", F.try_divide("clean_k", "n"))
        .withColumn("degraded_rate", F.try_divide("degraded_k", "n"))
        .withColumn("drop_pp", drop)
        .withColumn("mcnemar_p", mcnemar_p(F.col("worse"), F.col("better")))
        .withColumn("degrades", (F.col("drop_pp") >= min_drop_pp) & (F.col("mcnemar_p") < alpha))
    )


def gap_class(gap_pp: Column) -> Column:
    return (
        F.when(gap_pp >= 10, "far above the clean rows")
        .when(gap_pp <= 5, "close to the clean rows")
        .otherwise("moderately above the clean rows")
    )

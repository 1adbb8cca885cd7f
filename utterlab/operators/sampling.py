"""Deterministic samples and splits, drawn in hash order.

A row's draw order is the digest of (seed, id), so a sample does not depend on
partitioning or file order, and any engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlab.operators.scan import first_k, hash_bucket, hash_order, ranked, running_before
from utterlab.sources.tables import small_side


def is_dev_speaker(speaker: Column, percent: int = 30) -> Column:
    """sha256(speaker) mod 100 below ``percent``; exact over all 256 bits."""
    digest = F.sha2(speaker, 256)

    def part(start: int, digits: int) -> Column:
        return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint") % 100

    # 16 ** 15 and its powers are 76 modulo 100
    above = part(1, 4) + part(5, 15) + part(20, 15) + part(35, 15)
    return (above * 76 + part(50, 15)) % 100 < percent


def uniform(df: DataFrame, ids: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order: a top-n per task, then one merge of those."""
    return df.withColumn("__h", hash_order(seed, *ids)).orderBy("__h", *ids).limit(n).drop("__h")


def per_group(df: DataFrame, groups: list[str], ids: list[str], n: int | Column, seed: int = 0):
    """The first n rows of each group in hash order."""
    drawn = df.withColumn("__h", hash_order(seed, *ids))
    return first_k(drawn, groups, ["__h", *ids], n).drop("__h")


def stratified(df: DataFrame, group: str, ids: list[str], n: int, seed: int = 0):
    """(sample, shortfall): n rows per group in a shuffled order, and what is missing."""
    sample = per_group(df, [group], ids, n, seed)
    order = sample.withColumn("draw", hash_order(f"{seed}-order", *ids))
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("available"))
    short = counts.withColumn(
        "shortfall", F.greatest(F.lit(n) - F.col("available"), F.lit(0))
    )
    return order, short


def shard_quota(
    df: DataFrame, shard: str, ids: list[str], is_entity: Column, n_clean: int, seed: int = 0
) -> DataFrame:
    """Every entity row, and max(1, ceil(n / shards)) clean rows of each shard."""
    flagged = df.withColumn("is_entity", is_entity)
    shards = flagged.agg(F.count_distinct(shard).alias("__s"))
    quota = F.greatest(F.lit(1), F.ceil(F.lit(n_clean) / F.col("__s"))).cast("int")
    clean = flagged.where(~F.col("is_entity")).join(F.broadcast(shards))
    picked = per_group(clean.withColumn("__q", quota), [shard], ids, F.col("__q"), seed)
    return flagged.where("is_entity").unionByName(picked.drop("__s", "__q"))


def cluster_sample(
    df: DataFrame,
    shard: str,
    ids: list[str],
    is_entity: Column,
    min_entity: int,
    n_clean: int,
    seed: int = 0,
) -> DataFrame:
    """Shards in hash order until they hold ``min_entity`` entity rows (the crossing
    shard is kept); all their entity rows, and n clean rows drawn from them."""
    flagged = df.withColumn("is_entity", is_entity)
    per_shard = flagged.groupBy(shard).agg(F.count_if("is_entity").alias("n"))
    ordered = per_shard.withColumns({"__h": hash_order(seed, shard), "__all": F.lit(0)})
    drawn = (
        running_before(
            ordered, ["__all"], hash_bucket(F.col("__h"), 3), ["__h", shard], F.col("n"), "sum", "__before"
        )
        .where(F.coalesce("__before", F.lit(0)) < min_entity)
        .select(shard)
    )
    rows = flagged.join(small_side(drawn), shard, "left_semi")
    clean = uniform(rows.where(~F.col("is_entity")), ids, n_clean, seed)
    return rows.where("is_entity").unionByName(clean)


def row_split(
    df: DataFrame, arm: str, ids: list[str], fraction: float = 0.3, seed: int = 0
) -> DataFrame:
    """First round(fraction * n) rows of each arm, in hash order, to dev (half to even)."""
    ordered = df.withColumn("__h", hash_order(seed, *ids))
    placed = ranked(ordered, [arm], hash_bucket(F.col("__h")), ["__h", *ids], "__rank")
    sizes = df.groupBy(arm).agg(F.count(F.lit(1)).alias("__n"))
    return (
        placed.join(sizes, arm)
        .withColumn(
            "split",
            F.when(F.col("__rank") <= F.bround(F.col("__n") * fraction, 0), "dev").otherwise("test"),
        )
        .drop("__h", "__rank", "__n")
    )


def duration_budget(
    df: DataFrame, ids: list[str], seconds: str, budget: float, seed: int = 0
) -> DataFrame:
    """Rows in hash order while their summed duration stays within the budget.

    Durations are never negative, so "stop at the first overflow" is the same as
    keeping every row whose running sum fits. The sum is carried across hash
    buckets, so no task sees the whole order.
    """
    ordered = df.withColumn("__h", hash_order(seed, *ids)).withColumn(
        "__b", hash_bucket(F.col("__h"))
    )
    totals = ordered.groupBy("__b").agg(F.sum(seconds).alias("__t"))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__b", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__c"))
    inside = (
        Window.partitionBy("__b")
        .orderBy("__h", *ids)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ordered.withColumn("__s", F.sum(seconds).over(inside))
        .join(F.broadcast(carry), "__b")
        .where(F.col("__s") + F.col("__c") <= budget)
        .drop("__h", "__b", "__s", "__c")
    )


def eligibility(
    references: DataFrame, audio: DataFrame, low: float = 1.0, high: float = 29.5
) -> DataFrame:
    """Add ``reason``: the first check a reference fails, null when eligible.

    ``references`` has uttid, text; ``audio`` has uttid, seconds.
    """
    joined = references.join(audio.withColumn("__has", F.lit(True)), "uttid", "left")
    return joined.withColumn(
        "reason",
        F.when(F.col("__has").isNull(), "no_audio")
        .when((F.col("text") == "") | F.contains("text", F.lit("<")), "empty_or_tagged_reference")
        .when(~F.col("seconds").between(low, high), "duration_out_of_range"),
    ).drop("__has")


def file_order_head(df: DataFrame, groups: list[str], position: str, n: int) -> DataFrame:
    """First n rows of each group in log order."""
    return first_k(df, groups, [position], n)


def repeat_agreement(first: DataFrame, second: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Share of repeated transcriptions that are identical."""
    again = second.select(*keys, F.col(text).alias("__again"))
    return first.join(again, keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(text).eqNullSafe(F.col("__again"))).alias("n_identical"),
    ).withColumn("fraction_identical", F.try_divide("n_identical", "n"))

"""Ordered computations that stay spread out when one group is huge.

A plain window hands a whole group to one task. Here a group is cut into
order-preserving buckets, each bucket is scanned on its own, and what earlier
buckets contribute arrives by a join with their (tiny) totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, *ids: str) -> Column:
    """Draw order of a row: a hex digest every engine computes alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_bucket(order: Column, digits: int = 2) -> Column:
    """Leading hex digits: 256 equal, order-preserving buckets by default."""
    return F.substring(order, 1, digits)


def ranked(
    df: DataFrame, groups: list[str], bucket: Column, order: list[Column | str], out: str = "rank"
) -> DataFrame:
    """1-based rank within each group in (bucket, order)."""
    tagged = df.withColumn("__b", bucket)
    counts = tagged.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*groups, "__b").orderBy(*order)
    return (
        tagged.withColumn("__r", F.row_number().over(inside))
        .join(offsets, [*groups, "__b"])
        .withColumn(out, F.col("__r") + F.col("__o"))
        .drop("__b", "__r", "__o")
    )


def first_k(
    df: DataFrame, groups: list[str], order: list[Column | str], k: int | Column, salts: int = 64
) -> DataFrame:
    """The k rows of each group that come first; ``order`` must be total.

    Each salt keeps its own k first, so at most salts * k rows of a group meet.
    """
    limit = F.lit(k) if isinstance(k, int) else k
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    partial = Window.partitionBy(*groups, "__s").orderBy(*order)
    final = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("__s", salt)
        .withColumn("__r", F.row_number().over(partial))
        .where(F.col("__r") <= limit)
        .drop("__s")
        .withColumn("__r", F.row_number().over(final))
        .where(F.col("__r") <= limit)
        .drop("__r")
    )


def running_before(
    df: DataFrame,
    groups: list[str],
    bucket: Column,
    order: list[Column | str],
    value: Column,
    how: str,
    out: str,
) -> DataFrame:
    """Sum or max of ``value`` over the rows strictly before each row (null if none)."""
    fold = {"sum": F.sum, "max": F.max}[how]
    tagged = df.withColumn("__b", bucket).withColumn("__v", value)
    totals = tagged.groupBy(*groups, "__b").agg(fold("__v").alias("__t"))
    earlier = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("__c", fold("__t").over(earlier)).drop("__t")
    inside = (
        Window.partitionBy(*groups, "__b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    here, before = F.col("__h"), F.col("__c")
    joined = tagged.withColumn("__h", fold("__v").over(inside)).join(carry, [*groups, "__b"])
    both = (
        F.greatest(here, before)
        if how == "max"
        else F.when(here.isNull() & before.isNull(), None).otherwise(
            F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        )
    )
    return joined.withColumn(out, both).drop("__b", "__v", "__h", "__c")

"""Exact percentiles of large groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlab.operators.scan import running_before


def _value_bucket(value: Column) -> Column:
    """Order-preserving bucket, about one percent wide, of either sign."""
    size = F.floor(F.log2(1 + F.abs(value)) * 64)
    return F.when(value < 0, -size - 1).otherwise(size)


def percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    points: dict[str, float],
    approximate: bool = False,
    count: str | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles per group: keys + n, one column per point, max.

    Equal values are counted together first; the running count is carried across
    value buckets; then only the two neighbours of each rank are picked out.
    ``approximate`` uses the built-in sketch instead. A row stands for as many equal values as
    its column ``count`` says (exact form only).
    """
    present = df.where(F.col(value).isNotNull())
    if approximate:
        return present.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.approx_percentile(value, p / 100).alias(name) for name, p in points.items()],
            F.max(value).alias("max"),
        )
    v = F.col("__value")
    counts = (
        present.select(
            *keys, F.col(value).cast("double").alias("__value"), (F.col(count) if count else F.lit(1)).alias("__rows")
        )
        .groupBy(*keys, "__value")
        .agg(F.sum("__rows").alias("__k"))
    )
    placed = running_before(counts, keys, _value_bucket(v), ["__value"], F.col("__k"), "sum", "__at")
    sizes = counts.groupBy(*keys).agg(F.sum("__k").alias("n"), F.max("__value").alias("max"))
    joined = placed.withColumn("__at", F.coalesce("__at", F.lit(0))).join(sizes, keys)
    picks = []
    for name, p in points.items():
        rank = (F.col("n") - 1) * F.lit(float(p)) / 100
        for side, k in (("lo", F.floor(rank)), ("hi", F.least(F.floor(rank) + 1, F.col("n") - 1))):
            holds = (F.col("__at") <= k) & (k < F.col("__at") + F.col("__k"))
            picks.append(F.max(F.when(holds, v)).alias(f"__{name}_{side}"))
    found = joined.groupBy(*keys, "n", "max").agg(*picks)
    out = []
    for name, p in points.items():
        rank = (F.col("n") - 1) * F.lit(float(p)) / 100
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return found.select(*keys, "n", *out, "max")

"""Percentile bootstrap on grouped data.

Rows are first collapsed to (value, count). Every collapsed row then takes its weight in each
resample from a Poisson law with that mean: a hash of (seed, key, value, resample) is looked up
in the table of the law's inverse. Nothing is drawn from a generator, so the ends depend on
the data alone, not on the partitioning, and SQL can state them. The cost follows
the distinct values, by one method for every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESAMPLES = 10_000
# Fixed values of the hash: the step between resamples, then (shift, factor) of its rounds.
STEP = 0x9E3779B9
ROUNDS = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))
CELLS = ["both_yes", "yes_no", "no_yes", "both_no"]


def seed_of(seed: int, *parts: Column | str) -> Column:
    """32 bits of an MD5 over the seed and the parts, written as text."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    texts = [F.coalesce(c.cast("string"), F.lit("?")) for c in cols]
    return F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), F.lit(1), F.lit(8)), 16, 10).cast("long")


def uniforms(seed: int, resamples: int) -> np.ndarray:
    """One 32-bit number per resample."""
    x = (np.uint64(seed) + np.arange(resamples, dtype=np.uint64) * np.uint64(STEP)) & np.uint64(0xFFFFFFFF)
    for shift, factor in ROUNDS:
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return x


@lru_cache(maxsize=16)
def poisson_steps(mean: int) -> tuple[int, np.ndarray]:
    """(first, steps): a number below ``steps[i]`` but no earlier one stands for ``first + i``.

    The table spans nine deviations, beyond which no 32-bit number reaches.
    """
    reach = int(9 * np.sqrt(mean)) + 25
    first = max(0, mean - reach)
    k = np.arange(first + 1, mean + reach + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / k))])
    mass = np.exp(logs - logs[mean - first])
    share = np.cumsum(mass) / mass.sum()
    return first, np.floor(share * 2.0**32).astype(np.uint64)


def weights(mean: int, seed: int, resamples: int) -> np.ndarray:
    """Poisson weights of one collapsed row in every resample."""
    if mean <= 0:
        return np.zeros(resamples)
    first, steps = poisson_steps(mean)
    return first + np.searchsorted(steps, uniforms(seed, resamples), side="right").astype(float)


def ratio_ci(
    df: DataFrame,
    keys: list[str],
    numerator: str,
    denominator: str | None = None,
    resamples: int = RESAMPLES,
    seed: int = 0,
    upper_shift: int = 0,
    count: str | None = None,
) -> DataFrame:
    """95% interval of sum(numerator) / sum(denominator) per key (a mean when no
    denominator is given): keys + lo, hi.

    Rows that stand for several alike name their number in ``count``. The ends are order
    statistics of the resamples with a denominator other than 0; a key without
    any gives 0 and 0. Sums of whole numbers are exact.
    """
    collapsed = (
        df.select(
            *keys,
            F.col(numerator).alias("num"),
            (F.col(denominator) if denominator else F.lit(1)).alias("den"),
            (F.col(count) if count else F.lit(1)).cast("long").alias("n"),
        )
        .groupBy(*keys, "num", "den")
        .agg(F.sum("n").alias("n"))
        .withColumn("seed", seed_of(seed, *keys, "num", "den"))
        .withColumns({c: F.col(c).cast("double") for c in ("num", "den")})
    )
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "b long, num double, den double"])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            labels = zip(*(pdf[k] for k in keys), strict=True) if keys else [()] * len(pdf)
            rows = zip(labels, pdf["n"], pdf["seed"], pdf["num"], pdf["den"], strict=True)
            for key, n, row_seed, num, den in rows:
                total = sums.setdefault(key, np.zeros((2, resamples)))
                drawn = weights(int(n), int(row_seed), resamples)
                total[0] += num * drawn
                total[1] += den * drawn
        for key, (num, den) in sums.items():
            frame = pd.DataFrame({"b": np.arange(resamples), "num": num, "den": den})
            for name, part in zip(keys, key, strict=True):
                frame[name] = part
            yield frame[[*keys, "b", "num", "den"]]

    drawn = (
        collapsed.mapInPandas(weigh, schema)
        .groupBy(*keys, "b")
        .agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
        .select(*keys, F.when(F.col("den") != 0, F.col("num") / F.col("den")).alias("v"))
    )
    # ``resamples`` numbers per key
    held = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("v"))
    r = F.size("v")
    last = F.least(r - 1, F.floor(F.lit(0.975) * r).cast("int") - upper_shift)
    end = lambda i: F.coalesce(F.get("v", i), F.lit(0.0))
    return held.select(
        *keys,
        end(F.floor(F.lit(0.025) * r).cast("int")).alias("lo"),
        end(F.greatest(F.lit(0), last)).alias("hi"),
    )


def _ends(values: np.ndarray, upper_shift: int) -> list[float | None]:
    ordered = np.sort(values)
    r = len(ordered)
    if not r:
        return [None, None]
    return [float(ordered[int(0.025 * r)]), float(ordered[max(0, min(r - 1, int(0.975 * r) - upper_shift))])]


def agreement_ci(
    cells: DataFrame, keys: list[str], resamples: int = RESAMPLES, seed: int = 0
) -> DataFrame:
    """Intervals of kappa and raw agreement from 2x2 counts, one row per key.

    ``cells`` has both_yes, yes_no, no_yes, both_no; its upper index is one lower
    than that of ``ratio_ci``, as in the published intervals. A key
    without votes has null intervals.
    """
    extra = ["kappa_lo", "kappa_hi", "raw_lo", "raw_hi"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for counts, seeds in zip(pdf[CELLS].to_numpy(), pdf["seeds"], strict=True):
                a, b, c, d = (
                    weights(int(n), int(s), resamples) for n, s in zip(counts, seeds, strict=True)
                )
                n = a + b + c + d
                a, b, c, d, n = (x[n > 0] for x in (a, b, c, d, n))
                seen, pa, pb = (a + d) / n, (a + b) / n, (a + c) / n
                chance = pa * pb + (1 - pa) * (1 - pb)
                flat = chance == 1
                kappa = np.where(
                    flat, (seen == 1).astype(float), (seen - chance) / np.where(flat, 1, 1 - chance)
                )
                rows.append([*_ends(kappa, 1), *_ends(seen, 1)])
            drawn = pd.DataFrame(rows, columns=extra, dtype=float)
            yield pd.concat([pdf.drop(columns="seeds").reset_index(drop=True), drawn], axis=1)

    counted = cells.select(*keys, *CELLS)
    schema = counted.schema
    for name in extra:
        schema = schema.add(name, "double")
    seeds = F.array(*[seed_of(seed, *keys, F.lit(name)) for name in CELLS])
    return counted.withColumn("seeds", seeds).mapInPandas(draw, schema)

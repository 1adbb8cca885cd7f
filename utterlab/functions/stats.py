"""Closed-form statistics as column expressions over aggregated counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _stirling_error(n: float) -> float:
    """ln(n!) less its Stirling approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    square = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * square)) / square) / square) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without cancellation near the mean."""
    d = (x - mean) / mean
    if abs(d) > 0.1:
        return x * math.log(x / mean) + mean - x
    # (1 + d) ln(1 + d) - d as a series in d
    total, term, k = 0.0, d * d, 2
    while abs(term) > 1e-18 * d * d:
        total += term / (k * (k - 1))
        term, k = -term * d, k + 1
    return mean * total


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-15:
            return out


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), by one formula for every size."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    size = a + b
    log_front = (
        _stirling_error(size) - _stirling_error(a) - _stirling_error(b)
        - _deviance(a, size * x) - _deviance(b, size * p)
        + 0.5 * math.log(a * b / size / (2 * math.pi))
    )
    front = math.exp(log_front)
    if x < (a + 1) / (size + 2):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, p) / b


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct<lo, hi>: Wilson score interval, (0, 0) for n = 0."""
    size = F.nullif(n, F.lit(0)).cast("double")
    p = successes / size
    denominator = 1 + z**2 / size
    center = (p + z**2 / (2 * size)) / denominator
    margin = z * F.sqrt(p * (1 - p) / size + z**2 / (4 * size * size)) / denominator
    empty = n == 0
    return F.struct(
        F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), center - margin)).alias("lo"),
        F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), center + margin)).alias("hi"),
    )


def rate(successes: Column, n: Column) -> Column:
    """struct<k, n, rate, lo, hi>."""
    ci = wilson(successes, n)
    return F.struct(
        successes.alias("k"),
        n.alias("n"),
        F.coalesce(F.try_divide(successes, n), F.lit(0.0)).alias("rate"),
        ci["lo"].alias("lo"),
        ci["hi"].alias("hi"),
    )


@F.pandas_udf(DoubleType())
def _mcnemar(fixed: pd.Series, broken: pd.Series) -> pd.Series:
    pairs = zip(fixed, broken, strict=True)
    return pd.Series([min(1.0, 2 * binomial_cdf(int(min(p)), int(sum(p)), 0.5)) for p in pairs])


def mcnemar_p(fixed: Column, broken: Column) -> Column:
    """Two-sided exact p of the discordant pairs; 1 when there are none.

    Meant for aggregated rows: one evaluation per row, by one formula for any count.
    """
    known = fixed.isNotNull() & broken.isNotNull()
    p = _mcnemar(F.coalesce(fixed, F.lit(0)), F.coalesce(broken, F.lit(0)))
    return F.when(known, p)


def cohens_kappa(both_yes: Column, yes_no: Column, no_yes: Column, both_no: Column) -> Column:
    """Kappa of two raters from their 2x2 counts; both constant gives 1 or 0."""
    n = (both_yes + yes_no + no_yes + both_no).cast("double")
    observed = (both_yes + both_no) / n
    pa, pb = (both_yes + yes_no) / n, (both_yes + no_yes) / n
    expected = pa * pb + (1 - pa) * (1 - pb)
    return F.when(
        expected == 1, F.when(observed == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise((observed - expected) / F.nullif(1 - expected, F.lit(0.0)))


def paired_counts(before: Column, after: Column) -> tuple[Column, Column]:
    """Aggregates: how many pairs turned right, how many turned wrong."""
    return F.count_if(after & ~before), F.count_if(before & ~after)

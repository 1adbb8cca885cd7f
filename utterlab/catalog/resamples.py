"""SQL of the bootstrap: the same hash, inverse table and order statistics."""

from __future__ import annotations

from utterlab.operators.bootstrap import CELLS, RESAMPLES, ROUNDS, STEP


def weights_sql(name: str, source: str, cols: list[str], seed_parts: list[str]) -> str:
    """CTEs ending in ``{name}``: cols, n, b, w for every row of ``source`` (cols, n) and resample."""
    listed = ", ".join(cols)
    parts = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '?')" for p in seed_parts)
    rounds, last = [], f"{name}_x0"
    for i, (shift, factor) in enumerate(ROUNDS, 1):
        rounds.append(f"""{name}_x{i} AS (SELECT * REPLACE (
            CAST((xor(x, x >> {shift}) * {factor}) % 4294967296 AS UBIGINT) AS x) FROM {last})""")
        last = f"{name}_x{i}"
    return f"""{name}_k AS (
      SELECT n, k, exp(k * ln(n) - n - lgamma(k + 1)) AS p FROM (
        SELECT n, unnest(range(greatest(0, n - 25 - CAST(floor(9 * sqrt(n)) AS BIGINT)),
                               n + 26 + CAST(floor(9 * sqrt(n)) AS BIGINT))) AS k
        FROM (SELECT DISTINCT n FROM {source} WHERE n > 0))),
    {name}_c AS (
      SELECT n, k, CAST(floor(4294967296 * sum(p) OVER (PARTITION BY n ORDER BY k)
        / sum(p) OVER (PARTITION BY n)) AS BIGINT) AS t FROM {name}_k),
    {name}_t AS (
      SELECT n, t, max(k) + 1 AS w FROM {name}_c GROUP BY n, t
      UNION ALL SELECT n, -1, min(k) FROM {name}_c GROUP BY n),
    {name}_x0 AS (
      SELECT *, CAST((seed + b * {STEP}) % 4294967296 AS UBIGINT) AS x FROM (
        SELECT {listed}, n, CAST(b AS UBIGINT) AS b,
          CAST('0x' || substr(md5(concat_ws('|', '0', {parts})), 1, 8) AS UBIGINT) AS seed
        FROM {source}, range({RESAMPLES}) r(b) WHERE n > 0)),
    {", ".join(rounds)},
    {name}_u AS (SELECT {listed}, n, b, CAST(x AS BIGINT) AS u FROM {last}),
    {name} AS (
      SELECT {", ".join(f"u.{c}" for c in cols)}, u.n, u.b, t.w
      FROM {name}_u u ASOF JOIN {name}_t t ON u.n = t.n AND u.u >= t.t)"""


def ends_sql(values: str, upper_shift: int) -> tuple[str, str]:
    """Both ends of a sorted list."""
    last = f"least(len({values}) - 1, CAST(floor(0.975::DOUBLE * len({values})) AS BIGINT) - {upper_shift})"
    return (
        f"{values}[1 + CAST(floor(0.025::DOUBLE * len({values})) AS BIGINT)]",
        f"{values}[1 + greatest(0, {last})]",
    )


def ratio_sql(
    name: str, source: str, keys: list[str], num: str, den: str, upper_shift: int = 0, count: str = "1"
) -> str:
    """CTEs ending in ``{name}``: keys, lo, hi, as ``ratio_ci`` gives them."""
    by = "".join(f"{k}, " for k in keys)
    lo, hi = ends_sql("v", upper_shift)
    drawn = weights_sql(f"{name}_w", f"{name}_v", [*keys, "num", "den"], [*keys, "num", "den"])
    return f"""{name}_v AS (
      SELECT {by}{num} AS num, {den} AS den, CAST(sum({count}) AS BIGINT) AS n
      FROM {source} GROUP BY ALL),
    {drawn},
    {name}_s AS (
      SELECT {by}b, CAST(sum(num * w) AS DOUBLE) AS num, CAST(sum(den * w) AS DOUBLE) AS den
      FROM {name}_w GROUP BY ALL),
    {name}_l AS (
      SELECT {by}list_sort(list(num / den) FILTER (WHERE den <> 0)) AS v FROM {name}_s GROUP BY ALL),
    {name} AS (SELECT {by}coalesce({lo}, 0) AS lo, coalesce({hi}, 0) AS hi FROM {name}_l)"""


def agreement_sql(name: str, cells: str, keys: list[str]) -> str:
    """CTEs ending in ``{name}``: keys and the four ends, as ``agreement_ci`` gives them."""
    by = "".join(f"{k}, " for k in keys)
    rows = " UNION ALL ".join(f"SELECT {by}'{c}' AS cell, {c} AS n FROM {cells}" for c in CELLS)
    a, b, c, d = (f"coalesce(sum(w) FILTER (WHERE cell = '{x}'), 0)" for x in CELLS)
    kappa, raw = ends_sql("kappas", 1), ends_sql("raws", 1)
    return f"""{name}_v AS ({rows}),
    {weights_sql(f"{name}_w", f"{name}_v", [*keys, "cell"], [*keys, "cell"])},
    {name}_s AS (
      SELECT {by}b, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS y, CAST({c} AS DOUBLE) AS z,
             CAST({d} AS DOUBLE) AS d, CAST(sum(w) AS DOUBLE) AS n FROM {name}_w GROUP BY {by}b),
    {name}_r AS (
      SELECT {by}(a + d) / n AS seen, (a + y) / n * ((a + z) / n) + (1 - (a + y) / n) * (1 - (a + z) / n)
        AS chance FROM {name}_s WHERE n > 0),
    {name}_l AS (
      SELECT {by}list_sort(list(CASE WHEN chance = 1 THEN (seen = 1)::INT
          ELSE (seen - chance) / (1 - chance) END)) AS kappas, list_sort(list(seen)) AS raws
      FROM {name}_r GROUP BY ALL),
    {name} AS (
      SELECT {by}round({kappa[0]}, 9) AS kappa_lo, round({kappa[1]}, 9) AS kappa_hi,
             round({raw[0]}, 9) AS raw_lo, round({raw[1]}, 9) AS raw_hi FROM {name}_l)"""

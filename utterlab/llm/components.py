"""Connected components by alternating large-star and small-star steps.

Before the first step every task replaces its own edges by stars of what they connect,
which leaves few and short paths. Each step lowers pointers by one aggregation and one join over the edges, and its result is
a written table, so lineage stays short and nothing of the graph reaches the driver but two
numbers. Joins leave a hub's many edges to the skew handling of adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from utterlab.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) edges; a component is its smallest node."""
    stars = edges.where("a <> b").select("a", "b").mapInArrow(_contract, "u long, v long")
    now, mark = _marked(stars.distinct())
    before = None
    while mark != before:
        before = mark
        now, mark = _marked(_small_star(_large_star(now)))
    pointers = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pointers.unionAll(pointers.select("component", "component").distinct())


def _marked(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, with their number and the sum of their hashes from its writing."""
    seen = Observation()
    watched = edges.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    )
    return written(watched, "edges"), seen.get


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node) of what the edges connect, by batches of edges."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        stars = [(x, find(x)) for x in list(parent)]
        moved = [x for x in stars if x[0] != x[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in moved], pa.int64()) for i in (0, 1)], ["u", "v"]
        )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(lowest, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()

"""Judges, failure classes and agreement."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from utterlab.operators import judging as j
from utterlab.plans import judges
from utterlab.sources import derived

EXPECTED = {"city": ["Bandra,Mumbai", "Bandra"], "tags": ["red", "blue"]}
CASES = [  # called, arguments, error -> exact, list-aware, class
    ("f", {"city": "bandra, mumbai", "tags": ["blue", "RED"]}, "", False, True, "value_mismatch"),
    ("f", {"city": "bandra", "tags": "red"}, "", True, False, "value_mismatch"),
    ("f", {"city": "Bandra", "tags": ["red"], "extra": 1}, "", False, False, "value_mismatch"),
    ("f", {"city": "Bandra", "tags": ["red", "blue", "x"]}, "", False, False, "value_mismatch"),
    ("f", {"city": "Bandra"}, "", False, False, "missing_argument"),
    ("g", {"city": "Bandra", "tags": []}, "", False, False, "wrong_function"),
    (None, None, "", False, False, "no_call"),
    (None, None, "tool_validation_failed", False, False, "provider_rejected"),
    ("f", {"city": "मुंबई", "tags": "red"}, "", False, False, "value_mismatch"),
]


@pytest.fixture(scope="module")
def calls(spark):
    rows = [
        (i, n, None if a is None else json.dumps(a, ensure_ascii=False), "f", EXPECTED, ["tags"], e)
        for i, (n, a, e, *_) in enumerate(CASES)
    ]
    df = spark.createDataFrame(
        rows,
        "i int, called_name string, arguments_json string, expected_name string, "
        "expected map<string,array<string>>, array_params array<string>, error_class string",
    )
    return j.prepare(df).orderBy("i")


def test_verdicts_and_classes(calls):
    got = calls.select(
        j.verdict(False).alias("e"), j.verdict(True).alias("l"), j.failure_class().alias("c")
    ).collect()
    assert [(r.e, r.l, r.c.category) for r in got] == [(c[3], c[4], c[5]) for c in CASES]
    assert got[8].c.devanagari and not got[8].c.list_valued
    assert got[2].c.list_valued and not got[2].c.other


def test_expected_call_and_array_params(spark):
    df = spark.createDataFrame(
        [
            ('[{"f": {"a": ["x", "y"], "n": [1, 2]}}]',), ('[{"f": {}}, {"g": {}}]',), ("[]",),
        ],
        "raw string",
    )
    got = [r[0] for r in df.select(j.expected_call(F.col("raw"))).collect()]
    assert got[0].name == "f" and got[0].arguments == {"a": ["x", "y"], "n": ["1", "2"]}
    assert got[1] is None and got[2] is None
    schema = json.dumps(
        [
            {"name": "f", "parameters": {"properties": {"t": {"type": "array"}, "u": {"type": "string"}, "v": "odd"}}},
            {"name": "g"},
        ]
    )
    fn = spark.createDataFrame([(schema,)], "s string")
    assert fn.select(j.array_params(F.col("s"), F.lit("f"))).first()[0] == ["t"]
    assert fn.select(j.array_params(F.col("s"), F.lit("g"))).first()[0] == []


def test_meaning_outcome_needs_every_verdict(spark, calls):
    cell = calls.withColumns(
        {
            "language": F.lit("english"), "example_id": F.col("i").cast("string"),
            "outcome": F.lit("fail"), "query": F.lit("q"), "ingest_pos": F.col("i"),
        }
    )
    population = j.judged_population(cell)
    yes = population.select("key", F.lit(True).alias("equivalent"))
    out = j.meaning_outcomes(cell, yes, ["language", "example_id"]).orderBy("i").collect()
    assert [r.meaning_ok for r in out] == [True] * 4 + [False] * 4 + [True]
    with pytest.raises(Exception, match="no equivalent for an item"):
        j.meaning_outcomes(cell, yes.limit(1), ["language", "example_id"]).collect()


@pytest.mark.parametrize(
    ("cells", "kappa"),
    [((5, 0, 0, 5), 1.0), ((4, 0, 0, 0), 1.0), ((0, 5, 5, 0), -1.0), ((20, 5, 10, 15), 0.4)],
)
def test_kappa(spark, cells, kappa):
    rows = [(True, True)] * cells[0] + [(True, False)] * cells[1]
    rows += [(False, True)] * cells[2] + [(False, False)] * cells[3]
    votes = spark.createDataFrame(rows, "judge boolean, owner boolean")
    r = judges.agreement(votes, resamples=500).first()
    assert round(r.kappa, 9) == kappa
    assert r.kappa_lo <= r.kappa <= r.kappa_hi + 1e-12
    assert r.raw_lo <= r.raw_agreement <= r.raw_hi + 1e-12


def test_calls_of_one_file_are_judged_by_many_tasks(spark, tmp_path):
    # one row group, so one task reads it; two columns more than the calls need
    spark.range(1, 400).selectExpr(
        "id AS p_partkey", "'almond azure' AS p_name", "'Brand#13' AS p_brand",
        "'SMALL' AS p_type", "CAST(id % 50 AS int) AS p_size", "'x' AS p_note",
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    calls = j.prepare(derived.tool_calls(spark, str(tmp_path)))
    spread = calls.select(F.spark_partition_id().alias("task")).distinct().count()
    assert spread >= spark.sparkContext.defaultParallelism


def test_arguments_are_parsed_once_for_the_mismatches(spark, tmp_path):
    spark.range(1, 40).selectExpr(
        "id AS p_partkey", "'almond azure' AS p_name", "'Brand#13' AS p_brand",
        "'SMALL' AS p_type", "CAST(id % 50 AS int) AS p_size",
    ).write.parquet(f"{tmp_path}/part.parquet")
    items = j.mismatch_items(j.prepare(derived.tool_calls(spark, str(tmp_path))))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries(") == 1
    assert items.count() > 0

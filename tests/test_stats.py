"""Statistics, bootstrap, noise floor and partition invariance."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlab.functions.stats import cohens_kappa, mcnemar_p, wilson
from utterlab.operators import bootstrap, percentiles, sampling, scan
from utterlab.plans import noise_floor as nf
from utterlab.plans import timing


def exact_p(a, b):
    n, k = a + b, min(a, b)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def test_mcnemar(spark):
    pairs = [(10, 0), (8, 2), (5, 5), (0, 0), (1, 0), (0, 1), (400, 350), (3000, 2800), (0, 900)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in df.select(mcnemar_p(F.col("a"), F.col("b"))).collect()]
    for (a, b), p in zip(pairs, got, strict=True):
        assert math.isclose(p, exact_p(a, b), rel_tol=1e-9), (a, b)


def test_mcnemar_far_beyond_exact_terms(spark):
    n = 4_000_000_000
    k = n // 2 - int(1.5 * math.sqrt(n) / 2)
    df = spark.createDataFrame([(n - k, k)], "a long, b long")
    want = math.erfc(((n / 2 - k - 0.5) / (math.sqrt(n) / 2)) / math.sqrt(2))
    assert math.isclose(df.select(mcnemar_p(F.col("a"), F.col("b"))).first()[0], want, abs_tol=1e-6)


def test_wilson_and_kappa(spark):
    row = spark.range(1).select(
        wilson(F.lit(8), F.lit(10)).alias("w"), wilson(F.lit(0), F.lit(0)).alias("z"),
        wilson(F.lit(0), F.lit(5)).alias("y"),
        cohens_kappa(F.lit(20), F.lit(5), F.lit(10), F.lit(15)).alias("k"),
    ).first()
    assert (round(row.w.lo, 4), round(row.w.hi, 4)) == (0.4902, 0.9433)
    assert (row.z.lo, row.z.hi) == (0.0, 0.0) and row.y.lo == 0.0
    assert math.isclose(row.k, 0.4)


def test_bootstrap_covers_the_classic_interval(spark):
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 4), rng.randint(4, 12)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, e long, w long")
    out = bootstrap.ratio_ci(df.repartition(8), ["g"], "e", "w", resamples=4000).collect()
    assert len(out) == 1
    assert out == bootstrap.ratio_ci(df.coalesce(1), ["g"], "e", "w", resamples=4000).collect()
    e, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    gen = np.random.default_rng(0)
    pick = gen.integers(0, 400, (4000, 400))
    lo, hi = np.quantile(e[pick].sum(1) / w[pick].sum(1), [0.025, 0.975])
    assert abs(out[0].lo - lo) < 0.006 and abs(out[0].hi - hi) < 0.006


def test_bootstrap_tells_long_keys_apart_and_keeps_empty_groups(spark):
    rows = [(f"model-large-v{k}", float(i), 1.0) for k in (2, 3) for i in range(30)]
    df = spark.createDataFrame([*rows, ("none", 0.0, 0.0)], "g string, e double, w double")
    got = {r.g: (r.lo, r.hi) for r in bootstrap.ratio_ci(df, ["g"], "e", "w", resamples=500).collect()}
    assert got["model-large-v2"] != got["model-large-v3"] and got["none"] == (0.0, 0.0)


def outcome_log(spark, lost, flips):
    rows = []
    for cond in ("gt", "whisper", "sarvam"):
        for i in range(100):
            for run in (1, 2, 3):
                ok = not (cond == "whisper" and i < lost)
                if cond == "sarvam" and flips and (i * 7 + run) % 13 == 0:
                    ok = False
                if cond == "gt" and flips and (i * 5 + run) % 13 == 0:
                    ok = False
                rows.append((str(i), "english", i, cond, run, "pass" if ok else "fail", run))
    return spark.createDataFrame(
        rows,
        "example_id string, language string, index int, condition string, run int, "
        "outcome string, ingest_pos long",
    )


def test_a_real_loss_and_pure_noise(spark):
    log = nf.latest_outcomes(outcome_log(spark, 40, True))
    got = {r.condition: r for r in nf.verdicts(nf.complete_examples(log), resamples=2000).collect()}
    assert got["whisper"].verdict == nf.COSTS and got["sarvam"].verdict == nf.NOISE
    exact = nf.latest_outcomes(outcome_log(spark, 40, False))
    block = nf.verdicts(nf.complete_examples(exact), resamples=500).where("condition = 'whisper'").first()
    assert round(block.mean_loss_pp, 9) == 40 and block.base_pass_real_fail == 40


def test_an_incomplete_run_drops_the_example(spark):
    log = outcome_log(spark, 0, False).withColumn(
        "outcome",
        F.when(
            (F.col("condition") == "gt") & (F.col("example_id") == "7") & (F.col("run") == 2),
            "incomplete",
        ).otherwise(F.col("outcome")),
    )
    complete = nf.complete_examples(nf.latest_outcomes(log))
    assert complete.where("condition = 'gt'").count() == 99
    assert nf.paired_losses(complete).where("condition = 'whisper'").count() == 99


def test_the_later_line_wins(spark):
    log = outcome_log(spark, 0, False).where("example_id = '1' and condition = 'gt' and run = 1")
    redo = log.withColumn("outcome", F.lit("fail")).withColumn("ingest_pos", F.lit(99).cast("long"))
    assert nf.latest_outcomes(log.unionByName(redo)).first().outcome == "fail"


def test_percentiles_match_linear_interpolation(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 50)) for _ in range(701)] + [("b", 3.0)] * 5 + [("c", -1.0), ("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in percentiles.percentiles(df, ["g"], "v", {"p50": 50, "p90": 90, "p99": 99}).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g]
        for name, p in (("p50", 50), ("p90", 90), ("p99", 99)):
            assert math.isclose(got[g][name], np.percentile(values, p), rel_tol=1e-12)
        assert got[g].n == len(values) and got[g]["max"] == max(values)


def test_one_hot_group_is_ranked_like_any_other(spark):
    rows = [("hot" if i % 3 else f"g{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long")
    ordered = df.withColumn("h", scan.hash_order(1, "id"))
    ranks = scan.ranked(ordered, ["g"], scan.hash_bucket(F.col("h")), ["h", "id"]).collect()
    hot = sorted((r for r in ranks if r.g == "hot"), key=lambda r: (r.h, r.id))
    assert [r["rank"] for r in hot] == list(range(1, len(hot) + 1))
    head = scan.first_k(ordered, ["g"], ["h", "id"], 10).where("g = 'hot'").collect()
    assert {r.id for r in head} == {r.id for r in hot[:10]}


@pytest.mark.parametrize("parts", [1, 8])
def test_samples_do_not_depend_on_partitioning(spark, parts):
    df = spark.range(2000).withColumn("s", F.col("id") % 7).repartition(parts)
    got = sorted(r.id for r in sampling.uniform(df, ["id"], 20, seed=4).collect())
    want = sorted(
        r.id for r in df.orderBy(F.md5(F.concat(F.lit("4|"), F.col("id").cast("string")))).limit(20).collect()
    )
    assert got == want
    split = sampling.row_split(df, "s", ["id"])
    counts = {r.s: r["count"] for r in split.where("split = 'dev'").groupBy("s").count().collect()}
    sizes = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert counts == {s: round(n * 0.3) for s, n in sizes.items()}


def test_speaker_split_equals_the_big_integer(spark):
    import hashlib

    names = [f"speaker {i}" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = {r.s: r.d for r in df.select("s", sampling.is_dev_speaker(F.col("s")).alias("d")).collect()}
    assert got == {n: int(hashlib.sha256(n.encode()).hexdigest(), 16) % 100 < 30 for n in names}


def test_pareto_and_threshold(spark):
    points = [("a", 0.1, 5.0), ("b", 0.2, 3.0), ("c", 0.2, 6.0), ("d", 0.1, 5.0), ("e", 0.3, 3.0)]
    df = spark.createDataFrame(points, "n string, wer double, stt_p50_ms double")
    assert sorted(r.n for r in timing.pareto_front(df).collect()) == ["a", "b", "d"]
    costs = spark.createDataFrame(
        [(0.7, 0.2, 0.2), (0.8, 0.1, 0.1), (0.9, 0.15, 0.05)],
        "threshold double, canonical_miss double, corruption_rate double",
    )
    assert timing.choose_threshold(costs).first().threshold == 0.9


@pytest.mark.parametrize("mean", [1, 3, 40, 5000, 10**9])
def test_weights_follow_the_poisson_law(mean):
    drawn = bootstrap.weights(mean, 12345, 20_000)
    assert abs(drawn.mean() - mean) < 5 * math.sqrt(mean / 20_000)
    assert 0.9 < drawn.var() / mean < 1.1
    first, steps = bootstrap.poisson_steps(mean)
    assert (np.diff(steps.astype(np.int64)) >= 0).all() and steps[-1] >= 2**32 - 1
    if mean <= 40:
        shares = [math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(mean + 20)]
        for k, share in enumerate(shares):
            assert abs((drawn == k).mean() - share) < 0.02


def test_weights_of_different_rows_are_independent():
    a, b = (bootstrap.weights(9, s, 20_000) for s in (1, 2))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.03
    assert abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.03
    assert not bootstrap.weights(0, 1, 5).any()


def test_blocks_have_exact_ends(spark):
    losses = nf.paired_losses(nf.complete_examples(nf.latest_outcomes(outcome_log(spark, 40, False))))
    got = {(r.language, r.condition): r for r in nf.loss_blocks(losses, resamples=800).collect()}
    assert set(got) == {(g, c) for g in ("english", None) for c in ("whisper", "sarvam")}
    for language in ("english", None):
        lost, same = got[language, "whisper"], got[language, "sarvam"]
        assert lost.loss_lo_pp < 40 < lost.loss_hi_pp and lost.ci_excludes_zero
        assert (same.loss_lo_pp, same.loss_hi_pp, same.ci_excludes_zero) == (0.0, 0.0, False)
    head = nf.first_n_blocks(losses, 20, resamples=200).where("condition = 'whisper'").first()
    assert (head.n, head.loss_lo_pp, head.loss_hi_pp) == (20, 100.0, 100.0)

"""Task-success loss against the model's own run-to-run noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlab.functions.stats import mcnemar_p
from utterlab.operators.bootstrap import RESAMPLES, ratio_ci
from utterlab.operators.logs import latest

CELL = ["language", "example_id", "condition", "run"]
COSTS = "ASR costs task success"
NOISE = "not distinguishable from LLM sampling noise"


def latest_outcomes(log: DataFrame) -> DataFrame:
    return latest(log, CELL)


def complete_examples(outcomes: DataFrame, k: int = 3) -> DataFrame:
    """One row per (language, condition, example) with all of runs 1..k scored;
    later runs are ignored. r1..rk hold whether each run passed."""
    scored = outcomes.where((F.col("outcome") != "incomplete") & (F.col("run").between(1, k)))
    runs = [
        F.max(F.when(F.col("run") == j, F.col("outcome") == "pass")).alias(f"r{j}")
        for j in range(1, k + 1)
    ]
    wide = scored.groupBy("language", "condition", "example_id").agg(
        *runs, F.max("index").alias("index")
    )
    for j in range(1, k + 1):
        wide = wide.where(F.col(f"r{j}").isNotNull())
    return wide


def _hits(prefix: str, k: int) -> Column:
    total = F.col(f"{prefix}1").cast("int")
    for j in range(2, k + 1):
        total = total + F.col(f"{prefix}{j}").cast("int")
    return total


def run_rates(complete: DataFrame, k: int = 3) -> DataFrame:
    """Pass rate of every run, in percent."""
    wide = complete.groupBy("language", "condition").agg(
        F.count(F.lit(1)).alias("n"),
        *[(100 * F.avg(F.col(f"r{j}").cast("int"))).alias(f"r{j}") for j in range(1, k + 1)],
    )
    entries = [
        F.struct(F.lit(j).alias("run"), F.col(f"r{j}").alias("pass_pct")) for j in range(1, k + 1)
    ]
    return wide.select("language", "condition", "n", F.inline(F.array(*entries)))


def run_pairs(complete: DataFrame, k: int = 3) -> DataFrame:
    """Every pair of runs of a cell: rate difference and flip rate.

    The runs already sit side by side in a row, so no self-join is needed.
    """
    aggs, entries = [], []
    for i in range(1, k + 1):
        for j in range(i + 1, k + 1):
            a, b = F.col(f"r{i}"), F.col(f"r{j}")
            aggs += [
                (100 * (F.sum(a.cast("int")) - F.sum(b.cast("int"))) / F.count(F.lit(1))).alias(
                    f"d{i}_{j}"
                ),
                (F.count_if(a != b) / F.count(F.lit(1))).alias(f"f{i}_{j}"),
            ]
            entries.append(
                F.struct(
                    F.lit(i).alias("run_a"),
                    F.lit(j).alias("run_b"),
                    F.col(f"d{i}_{j}").alias("diff_pp"),
                    F.col(f"f{i}_{j}").alias("flip_rate"),
                )
            )
    wide = complete.groupBy("language", "condition").agg(*aggs)
    return wide.select("language", "condition", F.inline(F.array(*entries)))


def noise_floor(complete: DataFrame, k: int = 3, baseline: str = "gt") -> DataFrame:
    """Largest absolute difference between two runs of the baseline, per language."""
    pairs = run_pairs(complete.where(F.col("condition") == baseline), k)
    return pairs.groupBy("language").agg(F.max(F.abs("diff_pp")).alias("noise_floor_pp"))


def paired_losses(complete: DataFrame, k: int = 3, baseline: str = "gt") -> DataFrame:
    """Per example complete under both: its loss, as runs of all and as a share, and the two
    majority votes."""
    base = complete.where(F.col("condition") == baseline).select(
        "language", "example_id", "index", *[F.col(f"r{j}").alias(f"g{j}") for j in range(1, k + 1)]
    )
    real = complete.where(F.col("condition") != baseline).drop("index")
    both = real.join(base, ["language", "example_id"])
    return both.select(
        "language",
        "condition",
        "example_id",
        "index",
        (_hits("g", k) - _hits("r", k)).alias("runs_lost"),
        F.lit(k).alias("runs"),
        ((_hits("g", k) - _hits("r", k)) / F.lit(k)).alias("loss"),
        (2 * _hits("g", k) > k).alias("base_ok"),
        (2 * _hits("r", k) > k).alias("real_ok"),
    )


def _block() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg("loss")).alias("mean_loss_pp"),
        F.count_if(F.col("base_ok") & ~F.col("real_ok")).alias("base_pass_real_fail"),
        F.count_if(~F.col("base_ok") & F.col("real_ok")).alias("base_fail_real_pass"),
    ]


def _with_p(block: DataFrame) -> DataFrame:
    return block.withColumn(
        "mcnemar_p", mcnemar_p(F.col("base_pass_real_fail"), F.col("base_fail_real_pass"))
    )


def _with_interval(losses: DataFrame, block: DataFrame, keys: list[str], resamples: int, seed: int) -> DataFrame:
    """The block with both ends of its mean loss; counts of whole runs keep the ends exact."""
    ci = ratio_ci(losses, keys, "runs_lost", "runs", resamples=resamples, seed=seed)
    ends = ci.select(
        *keys, (100 * F.col("lo")).alias("loss_lo_pp"), (100 * F.col("hi")).alias("loss_hi_pp")
    )
    return block.join(ends, keys).withColumn(
        "ci_excludes_zero", (F.col("loss_lo_pp") > 0) | (F.col("loss_hi_pp") < 0)
    )


def _blocks(losses: DataFrame, keys: list[str], resamples: int, seed: int) -> DataFrame:
    return _with_interval(losses, _with_p(losses.groupBy(*keys).agg(*_block())), keys, resamples, seed)


def loss_blocks(losses: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Per (language, condition), and pooled over languages (language null), each with the
    interval of its loss."""
    each = _blocks(losses, ["language", "condition"], resamples, seed)
    pooled = _blocks(losses, ["condition"], resamples, seed)
    return each.unionByName(pooled, allowMissingColumns=True)


def first_n_blocks(
    losses: DataFrame, first_n: int = 40, resamples: int = RESAMPLES, seed: int = 0
) -> DataFrame:
    """The same on the first n examples of each language's manifest."""
    return _blocks(losses.where(F.col("index") < first_n), ["language", "condition"], resamples, seed)


def verdicts(complete: DataFrame, k: int = 3, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Decision per (language, condition): interval, paired test and noise floor."""
    losses = paired_losses(complete, k)
    rules = (
        _blocks(losses, ["language", "condition"], resamples, seed)
        .join(noise_floor(complete, k), "language", "left")
        .withColumn("p_below_05", F.col("mcnemar_p") < 0.05)
        .withColumn(
            "loss_exceeds_noise",
            F.col("mean_loss_pp") > F.coalesce("noise_floor_pp", F.lit(0.0)),
        )
    )
    all_three = F.col("ci_excludes_zero") & F.col("p_below_05") & F.col("loss_exceeds_noise")
    return rules.withColumn("verdict", F.when(all_three, COSTS).otherwise(NOISE))


def incomplete_cells(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.where(F.col("outcome") == "incomplete")
        .groupBy("language", "condition")
        .agg(F.count(F.lit(1)).alias("n_incomplete"))
    )


def ablation(
    outcomes: DataFrame, baseline: str = "gt", real: str = "real", corrected: str = "corrected"
) -> DataFrame:
    """Success rate per condition, the loss, and the share of it a correction wins
    back (only where there is a loss)."""

    def rate(condition: str) -> Column:
        hit = F.when(F.col("condition") == condition, (F.col("outcome") == "pass").cast("int"))
        return F.avg(hit)

    rates = outcomes.groupBy("language").agg(
        F.count_if(F.col("condition") == baseline).alias("n"),
        rate(baseline).alias("ground_truth"),
        rate(real).alias("real_asr"),
        rate(corrected).alias("corrected_asr"),
    )
    loss = F.col("ground_truth") - F.col("real_asr")
    return rates.withColumn("loss", loss).withColumn(
        "recovered_share", F.when(loss > 0, (F.col("corrected_asr") - F.col("real_asr")) / loss)
    )

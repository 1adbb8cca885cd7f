"""Word error rate reports over transcript logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlab.functions.align import utterance_wer, word_align, word_edits
from utterlab.functions.text import canonical_text


def score(
    df: DataFrame, reference: Column, hypothesis: Column, prefix: str = "", kinds: bool = True
) -> DataFrame:
    """Add edits, word counts, the utterance rate and, with ``kinds``, the s/d/i counts in ops.

    ``reference`` and ``hypothesis`` must already be canonical texts.
    """
    p = prefix
    scored = df.withColumn(f"{p}ops", (word_align if kinds else word_edits)(reference, hypothesis))
    ops = {c: F.col(f"{p}ops.{c}") for c in ("ref_words", "hyp_words")}
    edits = F.col(f"{p}ops.s") + F.col(f"{p}ops.d") + F.col(f"{p}ops.i") if kinds else F.col(f"{p}ops.edits")
    scored = scored.withColumns({f"{p}edits": edits} | {p + c: n for c, n in ops.items()}).withColumn(
        f"{p}utt_wer",
        utterance_wer(F.col(f"{p}edits"), F.col(f"{p}ref_words"), F.col(f"{p}hyp_words")),
    )
    return scored if kinds else scored.drop(f"{p}ops")


def scored_transcripts(log: DataFrame) -> DataFrame:
    """Score ``raw_text`` against ``ground_truth_text``, both made canonical first."""
    return score(
        log, canonical_text(F.col("ground_truth_text")), canonical_text(F.col("raw_text"))
    )


def corpus_rate(edits: Column, ref_words: Column) -> Column:
    """Sum of edits over sum of words, never a mean of rates; 0 without words."""
    return F.coalesce(F.try_divide(F.sum(edits), F.sum(ref_words)), F.lit(0.0))


def corpus_wer(scored: DataFrame, *keys: str) -> DataFrame:
    """Per group: rows, edits (and their kinds, where they were scored), words and the rate."""
    kinds = {"substitutions": "s", "deletions": "d", "insertions": "i"} if "ops" in scored.columns else {}
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(f"ops.{k}").alias(name) for name, k in kinds.items()],
        F.sum("edits").alias("edits"),
        F.sum("ref_words").alias("reference_words"),
        F.sum("hyp_words").alias("hypothesis_words"),
        corpus_rate(F.col("edits"), F.col("ref_words")).alias("wer"),
    )


def wer_slices(scored: DataFrame, is_test: Column, is_entity: Column, *keys: str) -> DataFrame:
    """all / test / test with an entity / test without, in one pass."""
    slices = {
        "all": F.lit(True),
        "test": is_test,
        "test_entity": is_test & is_entity,
        "test_clean": is_test & ~is_entity,
    }
    aggs = []
    for name, keep in slices.items():
        edits, words_ = F.when(keep, F.col("edits")), F.when(keep, F.col("ref_words"))
        aggs += [
            F.count_if(keep).alias(f"{name}_rows"),
            F.coalesce(F.sum(words_), F.lit(0)).alias(f"{name}_words"),
            corpus_rate(edits, words_).alias(f"{name}_wer"),
        ]
    return scored.groupBy(*keys).agg(*aggs)

"""Alignment counts against a plain dynamic programme with backtrace."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlab.functions.align import edit_counts, edit_distances
from utterlab.plans import wer


def by_backtrace(ref, hyp):
    n, m = len(ref), len(hyp)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = ref[i - 1] == hyp[j - 1]
            cost[i][j] = (
                cost[i - 1][j - 1]
                if same
                else 1 + min(cost[i - 1][j - 1], cost[i - 1][j], cost[i][j - 1])
            )
    out, i, j = [0, 0, 0], n, m
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            out[0] += 1
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            out[1] += 1
            i -= 1
        else:
            out[2] += 1
            j -= 1
    return out


def packed(lists):
    values = np.array([x for one in lists for x in one], np.int64)
    return values, np.concatenate([[0], np.cumsum([len(one) for one in lists])]).astype(np.int64)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_counts_equal_the_backtrace(seed):
    rng = random.Random(seed)
    refs, hyps = [], []
    for k in range(1200):
        size = rng.choice([0, 1, 3, 8, 20, 60]) if k % 50 else 150
        ref = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randint(0, size))]
        hyp = [x for x in ref if rng.random() > 0.3] if k % 3 else [rng.randrange(5) for _ in range(size)]
        hyp += [rng.randrange(5) for _ in range(rng.randint(0, 3))]
        refs.append(ref)
        hyps.append(hyp)
    got = edit_counts(packed(refs), packed(hyps))
    assert got.tolist() == [by_backtrace(r, h) for r, h in zip(refs, hyps, strict=True)]


def test_utterance_and_corpus_rates(spark):
    pairs = [
        ("a b c", "a b c"), ("a b c", "a c"), ("a b c", "a x c"), ("a b", "a b c"), ("", ""), ("", "x"),
    ]
    df = spark.createDataFrame(pairs, "ground_truth_text string, raw_text string")
    scored = wer.scored_transcripts(df).coalesce(1)
    assert [round(r.utt_wer, 6) for r in scored.collect()] == [0, 0.333333, 0.333333, 0.5, 0, 1]
    total = wer.corpus_wer(scored).first()
    assert (total.substitutions, total.deletions, total.insertions) == (1, 1, 2)
    assert (total.reference_words, round(total.wer, 6)) == (11, round(4 / 11, 6))
    empty = wer.corpus_wer(scored.where(F.lit(False))).first()
    assert empty.wer == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_number_of_edits_equals_the_table(seed):
    rng = random.Random(seed)
    refs, hyps = [], []
    for k in range(800):
        size, letters = rng.choice([0, 1, 8, 20, 63, 64, 65, 130]), rng.choice([2, 5, 50])
        pair = [rng.randrange(letters) for _ in range(size)], [rng.randrange(letters) for _ in range(rng.randint(0, size))]
        kept = [x for x in pair[0] if rng.random() > 0.3]
        pair = (pair[0], kept) if k % 3 else pair
        refs.append(pair[k % 2])
        hyps.append(pair[1 - k % 2])
    want = edit_counts(packed(refs), packed(hyps)).sum(axis=1)
    assert edit_distances(packed(refs), packed(hyps)).tolist() == want.tolist()


def test_edits_alone_equal_the_counted_kinds(spark):
    texts = ["", None, "a", "a b c", "b  c", "é a a b", "word " * 130, " ".join(f"w{i}" for i in range(140))]
    rows = [(r, h) for r in texts for h in texts]
    df = spark.createDataFrame(rows, "r string, h string").repartition(3)
    both = wer.score(wer.score(df, F.col("r"), F.col("h")), F.col("r"), F.col("h"), "n_", kinds=False)
    for c in ("edits", "ref_words", "hyp_words", "utt_wer"):
        assert both.where(~F.col(c).eqNullSafe(F.col(f"n_{c}"))).count() == 0
    assert both.where("r IS NULL AND ref_words IS NOT NULL").count() == 0
    assert {r.ref_words for r in both.where("r = 'b  c'").collect()} == {2}

"""Source divergence audit against brute force with unbounded integers."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm.conftest import prose
from utterlab.llm import divergence as dv

SCHEMA = "text string, lang string, source string, term string, n int, total string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows: list[tuple], top: int = 200) -> set[tuple]:
    docs = [
        (lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")])
        for text, lang, source in rows
    ]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = [t for t in {t for d in mine for t in d[2]} if sum(t in d[2] for d in mine) >= 3]
        groups = sorted({d[1] for d in mine})

        def rates(texts, kept=kept):
            words = [t for ts in texts for t in ts]
            count = {t: words.count(t) for t in kept}
            over = sum(count.values()) + len(kept)
            return count, {t: 1 + 10**9 * (count[t] + 1) // over for t in kept}

        _, q = rates([d[2] for d in mine])
        made = {s: rates([d[2] for d in mine if d[1] == s]) for s in groups}
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            count, p = made[s]
            pair = [(sum(f(p[t], made[o][1][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(p[t], q[t]), t) for t in kept if count[t] and p[t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                limit = len(found) if part == "pair" else top
                out |= {(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(found[:limit])}
    return out


def corpus(seed: int, n: int) -> list[tuple]:
    rng, words = random.Random(seed), [*prose(seed, 60), "Élan", "ÉLAN", "señor", "x1y", "Z", "日本", "ab-CD", "\U0001f600"]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "de"]), f"s{min(rng.randrange(9), 5)}"
        k = rng.choice([0, 3, 40])
        out.append((" ".join(rng.choice(words[int(source[1]) :]) for _ in range(k)), lang, source))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return [tuple(r) for r in dv.audit(df, **options).collect()]


@pytest.mark.parametrize(("top", "side"), [(200, 64), (7, 2)])
def test_against_brute_force(spark, top, side, monkeypatch):
    rows = corpus(top, 150)
    monkeypatch.setattr(dv, "_PIECE", 300)
    monkeypatch.setattr(dv, "_BLOCK_ROWS", 40)
    got = run(spark, rows, top=top, side=side)
    assert len(got) == len(set(got)) and set(got) == brute(rows, top)


def test_edge_cases(spark):
    rows = [
        (None, None, None), ("", "en", "empty"), ("One two two", "en", "a"), ("one TWO", "en", "b"),
        ("one two", "en", "b"), ("only here", "fr", "a"), (None, "fr", "b"), ("1 2 3 ---", "xx", "a"),
        ("alone alone", "zz", "single"), ("alone", "zz", "single"), ("alone", "zz", "single"),
        ("one " * 300_000, "en", None), ("one two", "en", "b"),
    ]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert run(spark, []) == []


def test_equal_values_expand_in_byte_order(spark):
    rows = [("é z a B ~ ü", "en", "a")] * 3 + [("q", "en", "b")] * 3
    got = run(spark, rows, top=3)
    term = sorted((r[5], r[3]) for r in got if r[1] == "a" and r[2] == "term")
    assert term == [(1, "a"), (2, "b"), (3, "z")]
    assert set(got) == brute(rows, 3)


def test_sums_beyond_64_bits_of_weight():
    task = dv._PairTask("en", True)
    task.source("a", 1, 2, 0)
    task.source("b", 10**14, 2, 0)
    place, term = np.array([0, 1]), np.array([0, 1])
    task.add(place, term, np.array([1, 10**14]))
    p, q = dv.rates(np.array([1, 0]), 1, 2), dv.rates(np.array([0, 10**14]), 10**14, 2)
    assert task.sums[0, 1] == sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(p, q, strict=True))

"""Conversation prefix trie against brute force, over shards and chunks of every size."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from utterlab.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, ids string, `key` int, depth string"


def brute(rows: list[tuple], plain: bool = False) -> set[tuple]:
    talks: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in talks.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = turns if plain else own.get(c - c % 20, [])[:h] + turns[h:]
    members: dict[tuple, list[int]] = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, int] = {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in members}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(who) - 1) * words[node]
    out = set()
    for n, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(made[c]) == len(n))
        up = min(members[n[:-1]]) if n else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(who), len(n), up, len(who), kids.get(n, 0), leaves[n], saved[n], digest))
    return out


def talks(seed: int, n: int, longest: int = 7) -> list[tuple]:
    rng, out = random.Random(seed), []
    for c in rng.sample(range(4 * n), n):
        copied = rng.random() < 0.3
        for t in range(rng.randint(1, longest)):
            text = "same words here" if copied else f"w{rng.randrange(3)}  x\ty"
            out.append((c, None if t == 0 and rng.random() < 0.2 else t, "ua"[t % 2], text))
    rng.shuffle(out)
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return [tuple(r) for r in pt.prefix_trie(df, **options).collect()]


@pytest.mark.parametrize(("seed", "cells"), [(1, 1 << 20), (2, 8), (3, 40), (4, 1)])
def test_against_brute_force(spark, seed, cells):
    rows = talks(seed, 120)
    got = run(spark, rows, cells=cells)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_every_cut_into_shards(spark, shards):
    """Copies of one conversation, prefixes of it and extensions, over few and many shards."""
    texts = ["a b", "c", "d e f", "g"]
    rows = [(20 * c, t, "u", texts[t]) for c in range(60) for t in range(1 + c % 4)]
    rows += [(20 * c + 10_000, t, "u", f"{c}") for c in range(20) for t in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, rows, cells=20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edge_cases(spark):
    rows = [
        (1, None, None, None), (1, 3, "user", "x y"), (1, 3, "user", "x y"), (None, 1, "user", "lost"),
        (2, 0, "", ""), (2, 1, "user", "x y"), (40, 0, "u", "long " * 70_000), (41, 0, "u", "only turn"),
        (63, 1, "u", "base is absent"), (7, 0, "", ""),
    ]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert run(spark, []) == []
    turnless = [(43, 0, "u", "a"), (3, 0, "u", "b"), (23, 0, "u", "c")]
    assert set(run(spark, turnless)) == brute(turnless)


def test_a_long_conversation(spark):
    rows = [(c, t, "u", f"turn {t}") for c in (100, 105) for t in range(1_500)]
    got = run(spark, rows, cells=2_000)
    assert len(got) == len(set(got)) and set(got) == brute(rows)

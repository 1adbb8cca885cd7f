"""SimHash near-dedup against brute force: fingerprints, the trie walk, groups, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import prose
from tests.llm.test_text_dedup import lower
from utterlab.llm import simhash as sh


def brute_fingerprint(text: str | None) -> int:
    w = lower(text)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows: list[tuple[int, int]], budget: int) -> dict[int, int]:
    parent = {i: i for i, _ in rows}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def texts() -> list[str | None]:
    rng, out = random.Random(3), []
    for seed in range(30):
        base = prose(seed, rng.choice([2, 4, 5, 60, 300, 900]))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"Edit{rng.randrange(9)}"
            out.append("\n ".join(copy) if rng.random() < 0.3 else " ".join(copy))
    return [*out, None, "", " \t\n", "One", "one", "ONE two", "É é  x y z w v", "a b c d", "a b c d"]


def test_fingerprints_and_groups(make):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in sh.simhash_groups(make(rows)).collect()}
    want = [(i, brute_fingerprint(t)) for i, t in rows]
    assert {i: got[i].fingerprint for i in got} == {i: f"{fp:016x}" for i, fp in want}
    assert {i: got[i].component_id for i in got} == brute_groups(want, 4)
    assert len({got[i].component_id for i in got}) < len(rows)


def test_long_text_is_read_whole(make, monkeypatch):
    text = " ".join(prose(4, 4000))
    monkeypatch.setattr(sh, "_SHINGLES", 300)
    import pyarrow as pa

    got = sh.fingerprint_column(pa.array(["x y", text, None, text[:-5]]))
    assert [int(v) for v in got] == [brute_fingerprint(t) for t in ("x y", text, None, text[:-5])]


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_trie_walk(budget, monkeypatch):
    monkeypatch.setattr(sh, "_FRONTIER", 50)
    monkeypatch.setattr(sh, "_LINKS", 20)
    rng = random.Random(budget)
    groups = []
    for _ in range(12):
        centre = [rng.getrandbits(64) for _ in range(3)]
        values = {rng.choice(centre) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(40)}
        groups.append(sorted(values | {0, 2**64 - 1}))
    starts = np.cumsum([0, *map(len, groups)])[:-1]
    flat = np.array([v for g in groups for v in g], np.uint64)
    label = sh.near_labels(flat, starts, budget)
    for start, values in zip(starts, groups, strict=True):
        rows = [(start + i, v) for i, v in enumerate(values)]
        assert {i: label[i] for i, _ in rows} == brute_groups(rows, budget)


def test_dense_family_is_split_and_joined_whole(make, spark):
    """More relatives in one key than a part holds, at every distance up to the budget."""
    rng = random.Random(8)
    centre, values = rng.getrandbits(64), set()
    while len(values) < 400:
        values.add(centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 9))))
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    edges = sh.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), cap=50).collect()
    parent = {v: v for v in signed}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 20 for a, b in edges)
    want = brute_groups([(v, v % 2**64) for v in signed], 4)
    assert {v: find(v) for v in signed} == want


def test_two_linked_values_agree_on_two_blocks():
    blocks = sh._blocks(6)
    assert sum(w for _, w in blocks) == 64 and sorted(s for s, _ in blocks)[0] == 0
    rng = random.Random(1)
    for _ in range(200):
        bits = rng.sample(range(64), 4)
        assert sum(all(not s <= b < s + w for b in bits) for s, w in blocks) >= 2


def test_edge_cases(make):
    rows = [(1, "a b c d e"), (1, " ".join(prose(1, 80))), (2, "A  B C D E"), (None, "a b c d e"), (3, None), (9, "")]
    rows += [(5, " ".join(prose(1, 80))), (5, " ".join(prose(1, 80)))]
    docs = make(rows).withColumnRenamed("n", "fp").withColumnRenamed("id", "trie")
    got = [(r.doc_id, r.component_id) for r in sh.simhash_groups(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1), (1, 1), (2, 1), (None, None), (3, 3), (9, 3), (5, 1), (5, 1)], key=str
    )
    assert sh.simhash_groups(docs.where("false")).collect() == []

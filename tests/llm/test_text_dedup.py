"""Substring dedup, Jaccard join and line dedup against brute force on small inputs."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from utterlab.llm import jaccard_join as jj
from utterlab.llm import line_dedup as ld
from utterlab.llm import substring_dedup as sd
from utterlab.llm.components import components
from utterlab.llm.words import shingle_sets, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def shingles(text: str) -> set[tuple[str, ...]]:
    w = lower(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies() -> list[str]:
    rng, out = random.Random(5), []
    for seed in range(12):
        base = prose(seed, rng.randint(3, 160))
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = "edit%d" % rng.randrange(9)
            out.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
    return [*out, "", None, "  \t\n", "One", "one", "ONE", "é é   x y z", "a b c d", "a b c d", "a b c d e"]


def brute_components(texts: list[str]) -> dict[int, int]:
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_word_hashes_tell_words_apart():
    texts = ["A b\x0bc  d", None, "", "a B c d", "é x", "a" * 3_000_000 + " b"]
    w = words(pa.array(texts))
    assert w.counts.tolist() == [4, 0, 0, 4, 1, 2]
    assert w.hashes[:4].tolist() == w.hashes[4:8].tolist()
    assert len(set(w.hashes.tolist())) == 4 + 1 + 1
    assert [len(s) for s in shingle_sets(w)] == [1, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("parts", [1, 7])
def test_jaccard_join_equals_brute_force(make, parts):
    texts = near_copies()
    rows = jj.near_duplicates(make(texts).repartition(parts)).collect()
    want = brute_components(texts)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(shingles(t)) for i, t in enumerate(texts)}


def test_jaccard_trees_find_every_link_alone(make, monkeypatch):
    """Without the first round all links have to come from the signature trees."""
    monkeypatch.setattr(jj, "_BLOCK", 3)
    verify, calls = jj._verify, []

    def later_only(texts, pairs):
        calls.append(1)
        return verify(texts, pairs.where("false") if len(calls) == 1 else pairs)

    monkeypatch.setattr(jj, "_verify", later_only)
    texts = near_copies()
    rows = jj.near_duplicates(make(texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(texts)


def test_jaccard_null_and_repeated_ids(make):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (9, "q r s t u v"), (12, "Q r s t u v")]
    got = sorted(((r.doc_id, r.component_id) for r in jj.near_duplicates(make(rows)).collect()), key=str)
    assert got == sorted([(None, None), (3, 3), (9, 3), (9, 3), (12, 3)], key=str)


def test_tree_bound_never_drops_a_link():
    rng = random.Random(3)
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(rng.randint(5, 300))]
        leaves, sets = [], []
        for name in range(9):
            keep = {x for x in base if rng.random() < 0.97} | {rng.getrandbits(64) for _ in range(rng.randint(0, 20))}
            import numpy as np

            s = np.array(sorted(keep), np.uint64)
            sets.append(keep)
            leaves.append(jj.leaf(name, len(s), name, 0, jj._bitmap(s)))
        found = set(jj.candidates(jj.tree(leaves), False))
        for i in range(9):
            for j in range(i + 1, 9):
                if jj.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                    assert (i, j) in found


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}


@pytest.mark.parametrize("call", [jj.near_duplicates, sd.repeated_passages, ld.dedup_lines])
def test_empty_tables(make, call):
    assert call(make([]).where("false")).count() == 0


def test_passages_repeat_across_documents(make):
    shared, rng = prose(99, 70), random.Random(1)
    edited = list(shared)
    edited[35] = "changed"
    texts = []
    for i in range(24):
        middle = {0: shared, 1: edited, 2: shared[:40], 3: []}[i % 4]
        texts.append(" ".join([*prose(1000 + i, rng.randint(0, 90)), *middle, *prose(2000 + i, rng.randint(0, 90))]))
    texts += [None, "", " ".join(shared), "x " * 5000]
    rows = sd.repeated_passages(make(texts).repartition(5)).collect()
    grams = defaultdict(set)
    for d, t in enumerate(texts):
        w = lower(t)
        for i in range(len(w) - 49):
            grams[tuple(w[i : i + 50])].add(d)
    want = {d for ds in grams.values() if len(ds) > 1 for d in ds}
    touched = {r.a for r in rows} | {r.b for r in rows}
    assert want <= touched
    clean = {i for i in range(24) if i % 4 >= 2} | {24, 25, 27}
    assert not touched & clean
    for r in rows:
        x = lower(texts[r.a])[r.start_a : r.start_a + r.words_a]
        y = lower(texts[r.b])[r.start_b : r.start_b + r.words_b]
        p, q = shingles(" ".join(x)), shingles(" ".join(y))
        assert min(len(x), len(y)) >= 50 and len(p & q) / len(p | q) >= 0.8
        assert abs(len(p & q) / len(p | q) - r.similarity) < 1e-9


def test_exact_repeats_among_variants_of_a_frame(make):
    rng, frame = random.Random(2), prose(77, 33)
    variants = [prose(3000 + v, 17) for v in range(40)]
    order = [v for _ in range(3) for v in rng.sample(range(40), 40)]
    texts = [" ".join([*prose(4000 + i, 9), *frame, *variants[v], *prose(5000 + i, 9)]) for i, v in enumerate(order)]
    texts += ["same " * 900, " ".join(prose(1, 20) * 40)]
    rows = sd.repeated_passages(make(texts).repartition(4)).collect()
    assert {r.a for r in rows if r.a < 120 and order[r.a] == order[r.b]} == set(range(40, 120))


@pytest.mark.parametrize("around", [0, 60])
def test_near_copies_among_many_variants_of_a_frame(make, around):
    rng, frame, held = random.Random(5), prose(77, 38), []
    for copy in range(2):
        for v in rng.sample(range(600), 600):
            w = [*frame, *prose(3000 + v, 22)]
            if copy:
                w[rng.randrange(60)] = "changed"
            i = len(held)
            held.append((v, w, " ".join([*prose(90000 + i, rng.randint(0, around)), *w, *prose(80000 + i, rng.randint(0, around))])))
    by = defaultdict(list)
    for v, w, _ in held:
        by[v].append(shingles(" ".join(w)))
    want = {v for v, (p, q) in by.items() if len(p & q) >= 0.8 * len(p | q)}
    rows = sd.repeated_passages(make([t for *_, t in held]).repartition(4)).collect()
    found = {held[r.a][0] for r in rows if held[r.a][0] == held[r.b][0]}
    assert len(want) > 500 and len(found & want) >= 0.9 * len(want)


def test_hot_groups_are_split_and_keep_exact_repeats(make, monkeypatch):
    monkeypatch.setattr(sd, "_GROUP", 20)
    test_exact_repeats_among_variants_of_a_frame(make)


def test_large_groups_keep_links_between_unlike_surroundings(monkeypatch):
    import numpy as np

    # one key, and surroundings that all differ: each window meets the three before it
    rng, rows = random.Random(6), []
    for i in range(200):
        rows.append((7, rng.randrange(-(2**62), 2**62), i, 0, 5 << 32 | 5, None))
    rows.sort(key=lambda r: r[1])
    names = ["key", "near", "doc", "place", "span", "prev"]
    kinds = [*[pa.int64()] * 5, pa.binary()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    batch = pa.RecordBatch.from_arrays(columns, names)
    want = {frozenset((rows[i][2], rows[j][2])) for i in range(200) for j in range(max(0, i - 3), i)}
    for size in (2, 20, 10_000):
        monkeypatch.setattr(sd, "_GROUP", size)
        out = [r for b in sd._chain(46)(iter([batch])) for r in b.to_pylist()]
        assert {frozenset((r["a"], r["b"])) for r in out} == want and len(out) == len(want)
    assert np.all([r["a"] > r["b"] for r in out])


@pytest.mark.parametrize("around", [0, 60])
def test_large_groups_keep_near_copies(make, monkeypatch, around):
    monkeypatch.setattr(sd, "_GROUP", 20)
    test_near_copies_among_many_variants_of_a_frame(make, around)


def test_null_and_repeated_ids(make):
    text, other = " ".join(prose(5, 70)), " ".join(prose(6, 70))
    docs = make([(None, text), (1, text), (1, text), (2, other), (3, text)])
    assert {(r.a, r.b) for r in sd.repeated_passages(docs).collect()} == {(3, 1)}


def test_range_minima_match_slices():
    import numpy as np

    rng = np.random.default_rng(9)
    for n in (1, 3, 40, 200):
        values = rng.integers(0, 2**63, n).astype(np.uint64)
        low = rng.integers(0, n, 50)
        high = np.minimum(n, low + rng.integers(0, 62, 50))
        want = [min(values[a:b].tolist(), default=2**64 - 1) for a, b in zip(low, high, strict=True)]
        assert sd._range_minima(values, low, high).tolist() == want


def test_edited_passages_are_found_like_brute_force():
    import numpy as np

    rng = np.random.default_rng(6)
    fresh = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    grams = lambda w: {tuple(w[i : i + 5].tolist()) for i in range(len(w) - 4)}
    similar = 0
    for size in range(50, 121):
        for edits in ([size // 2], [], *(rng.choice(size, k, replace=False) for k in (1, 2, 3))):
            core = fresh(size)
            edited = core.copy()
            edited[edits] = fresh(len(edits))
            x, y = (np.concatenate([fresh(rng.integers(60)), w, fresh(rng.integers(60))]) for w in (core, edited))
            p, q = grams(core), grams(edited)
            rows = sd.passages(x, y, 50, 0.8)
            if len(p & q) >= 0.8 * len(p | q):
                similar += 1
                assert rows, (size, edits)
            for a, n, b, m, share in rows:
                p, q = grams(x[a : a + n]), grams(y[b : b + m])
                assert min(n, m) >= 50 and share >= 0.8 and abs(share - len(p & q) / len(p | q)) < 1e-9
    assert similar > 200


def test_compact_windows_are_the_cartesian_tree():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes = rng.integers(0, 60, 3)
        first = np.concatenate(([0], np.cumsum(sizes)))
        values = rng.integers(0, 2**63, first[-1]).astype(np.uint64)
        doc = np.repeat(np.arange(3), sizes)
        got = set(zip(*(x.tolist() for x in sd.compact_windows(values, doc, first, 8)), strict=True))
        want = set()

        def split(low: int, high: int) -> None:
            if high - low + 1 >= 8:
                c = low + int(np.argmin(values[low : high + 1]))
                want.add((low, c, high))
                split(low, c - 1)
                split(c + 1, high)

        for a, b in zip(first[:-1], first[1:], strict=True):
            split(int(a), int(b) - 1)
        assert got == want


def test_runs_of_one_word_are_given_up_at_once(monkeypatch):
    import numpy as np

    # the run is in both texts, in one of them too short to be a passage, or not at all
    rng, calls, partner = np.random.default_rng(2), [], sd._partner
    monkeypatch.setattr(sd, "_partner", lambda *a: calls.append(1) or partner(*a))
    word, other, third = rng.integers(1, 2**63, 3).astype(np.uint64)
    x = np.repeat([word, third], [400, 30])
    assert sd.passages(x, np.repeat([word, other], [37, 90]), 50, 0.8) == []
    assert len(calls) <= 6
    assert [r[1] for r in sd.passages(x, np.repeat([word, other], [60, 90]), 50, 0.8)] == [400]


def test_regions_of_pairs_cut_by_batches():
    far = 5 << 32 | 60
    rows = [(2, 1, 10, far, 10, far), (2, 1, 30, far, 31, far), (3, 1, 5, far, 5, far), (3, 2, 9, -1 - far, 9, far)]
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, ["a", "b", "at_a", "span_a", "at_b", "span_b"])
    want = [(2, 1, 5, 90, 5, 91), (3, 2, 4, 69, 4, 69)]
    for size in (1, 2, 3, 4):
        cut = [batch.slice(at, size) for at in range(0, 4, size)]
        assert [tuple(r.values()) for b in sd._regions(2)(iter(cut)) for r in b.to_pylist()] == want


def test_wanted_windows_equal_those_of_all():
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(40):
        sizes = rng.integers(0, 90, 4)
        first = np.concatenate(([0], np.cumsum(sizes)))
        values, doc = rng.integers(0, 2**62, first[-1]).astype(np.uint64), np.repeat(np.arange(4), sizes)
        odd = lambda v: v % np.uint64(2) == 1
        every = np.stack(sd.compact_windows(values, doc, first, 8))
        some = np.stack(sd.compact_windows(values, doc, first, 8, odd))
        assert some.tolist() == every[:, odd(values[every[1]])].tolist()


def brute_lines(rows: list[tuple]) -> dict:
    seen, out = {}, {}
    for id_, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for place, n, chunk in ld.chunks(text) if text is not None else []:
            if n < 2 or seen.setdefault(chunk, (id_, place)) == (id_, place):
                kept.append(chunk)
        out[id_] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_line_dedup_equals_brute_force(make, parts):
    rng = random.Random(8)
    pool = [" ".join(prose(i, 4)) for i in range(40)]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(2, 25))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [x for _ in range(rng.randint(0, 3)) for x in rng.choice(blocks)] + [str(i)] * rng.randint(0, 2)
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n\n"), (63, "same\n" * 5000), (None, rows[3][1])]
    got = {r.doc_id: r.text for r in ld.dedup_lines(make(rows).repartition(parts)).collect()}
    assert got == brute_lines(rows)


def test_line_chunks_resist_shifts():
    lines = [" ".join(prose(i, 5)) for i in range(200)]
    before = {c for _, _, c in ld.chunks("\n".join(lines))}
    after = {c for _, _, c in ld.chunks("\n".join([*lines[:20], "new", *lines[20:]]))}
    assert len(before - after) <= 4


def test_line_dedup_repeated_rows_share_a_decision(make):
    text = "\n".join(" ".join(prose(i, 5)) for i in range(30))
    got = ld.dedup_lines(make([(1, text), (1, text), (2, text)])).select("doc_id", "text", "id").collect()
    assert sorted((r.doc_id, r.text == text, r.id) for r in got)[:2] == [(1, True, 7), (1, True, 7)]
    rest = next(r.text for r in got if r.doc_id == 2)
    assert len(rest) < len(text) / 2


def test_line_dedup_keeps_other_columns(make):
    out = ld.dedup_lines(make(["a\nb"]))
    assert out.select(F.col("class"), "n", "score", "version").first() == ("x", 1, "y", 2)

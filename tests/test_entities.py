"""Mentions, correction and entity reports on the civic lexicon."""

from __future__ import annotations

import dataclasses
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from utterlab.functions.text import rows_of
from utterlab.operators import correction as co
from utterlab.operators import mentions as m
from utterlab.plans import entities as plan
from utterlab.sources.lexicon import Lexicon, civic_lexicon, is_word_char


@pytest.fixture(scope="module")
def lexicon(spark):
    return Lexicon.of(civic_lexicon(spark))


def loop_mentions(text, spellings):
    folded = text.casefold() if len(text.casefold()) == len(text) else text.lower()
    found = []
    for s in spellings:
        at = folded.find(s.needle)
        while at != -1:
            end = at + len(s.needle)
            left = at == 0 or not is_word_char(folded[at - 1])
            right = end == len(folded) or not is_word_char(folded[end])
            if left and right:
                found.append((s.canonical, at, end))
            at = folded.find(s.needle, at + 1)
    found.sort(key=lambda f: (f[1] - f[2], f[1]))
    kept = []
    for f in found:
        if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[1])


def texts():
    rng = random.Random(5)
    bits = [
        "aadhaar", "card", "pan", "number", "gst", "GST.", "पैन कार्ड", "पैनी", "epfo", "ifsc", "code",
        "co-win", "provident fund", "pf", "कोविन", "voter  id", "voter id", "company", "upi_", "ß", "!",
    ]
    made = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return ["", "(GST)", "i work in a software company", *made]


def test_both_forms_equal_the_loop(spark, lexicon):
    assert lexicon.small
    df = spark.createDataFrame(list(enumerate(texts())), "id int, text string").repartition(5)
    want = {i: loop_mentions(t, lexicon.spellings) for i, t in enumerate(texts())}
    for form in (lexicon, dataclasses.replace(lexicon, small=False)):
        got = m.add_mentions(df, ["id"], {"f": "text"}, form).collect()
        assert {r.id: [(x.canonical, x.start, x.end) for x in r.f] for r in got} == want


def test_overlapping_lexicon_takes_the_join(spark):
    frame = spark.createDataFrame(
        [("AB", "latin", "a b", 0), ("BCD", "latin", "b c d", 1)],
        "canonical string, script string, variant string, ord int",
    )
    lexicon = Lexicon.of(frame)
    assert not lexicon.small
    df = spark.createDataFrame([(0, "a b c d"), (1, "a b a b c d")], "id int, text string")
    got = m.add_mentions(df, ["id"], {"f": "text"}, lexicon).orderBy("id").collect()
    assert [[x.canonical for x in r.f] for r in got] == [["BCD"], ["AB", "BCD"]]


def test_rewrite_is_idempotent(spark, lexicon):
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    found = m.mentions_in_row(F.col("t"), lexicon)
    once = df.withColumn("a", m.canonicalise(F.col("t"), found))
    twice = once.withColumn("b", m.canonicalise(F.col("a"), m.mentions_in_row(F.col("a"), lexicon)))
    assert twice.where("a <> b").count() == 0


FUZZY = [
    ("please update my adhar card details", "please update Aadhaar details"),
    ("the weather is nice today", "the weather is nice today"),
    ("check my upi balance", "check my UPI balance"),
    ("hello please check my adhar right now thanks", "hello please check my Aadhaar right now thanks"),
    ("", ""),
]


def test_fuzzy_and_exact_modes(spark, lexicon):
    df = spark.createDataFrame(list(enumerate(t for t, _ in FUZZY)), "id int, text string")
    got = co.correct(df, ["id"], "text", lexicon, "fuzzy").orderBy("id").collect()
    assert [r.corrected_text for r in got] == [w for _, w in FUZZY]
    fuzzy = got[0].corrections[0]  # its span refers to the text after the exact pass
    assert (fuzzy.original, fuzzy.stage) == ("my adhar card", "fuzzy")
    assert FUZZY[0][0][fuzzy.start : fuzzy.end] == "my adhar card"
    exact = co.correct(df, ["id"], "text", lexicon).orderBy("id").collect()
    assert exact[0].corrected_text == FUZZY[0][0]
    with pytest.raises(ValueError, match="unknown mode"):
        co.correct(df, ["id"], "text", lexicon, "bogus")


def test_piece_filter_loses_no_pair(spark, lexicon):
    """Brute force over all (window, key) pairs gives the same best matches."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    source = [s.variant for s in lexicon.spellings if s.script == "latin"]
    noisy = []
    for _ in range(150):
        word = list(rng.choice(source))
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word))] = rng.choice("abcdexyz ")
        noisy.append("".join(word).strip())
    df = spark.createDataFrame(list(enumerate(noisy)), "id int, text string")
    got = {
        (r.id, r.window): (r.canonical, round(r.score, 9))
        for r in co.scored_windows(df, ["id"], "text", lexicon, 0.7).collect()
    }
    keyed = {
        r.text: r.k
        for r in df.select("text", co.sound_key(F.col("text")).alias("k")).collect()
    }
    lex = lexicon.frame.orderBy("ord").select("canonical", co.sound_key(F.col("variant")).alias("k"))
    keys = [(r.canonical, r.k) for r in lex.collect()]
    for i, text in enumerate(noisy):
        if len(text.split()) > lexicon.longest_words or not keyed[text] or not text:
            continue
        best = (None, 0.0)
        for canonical, k in keys:
            score = 2 * lcs(keyed[text], k) / (len(k) + len(keyed[text]))
            if score > best[1]:
                best = (canonical, score)
        want = (best[0], round(best[1], 9)) if best[1] >= 0.7 else None
        assert got.get((i, text)) == want, text


def test_window_keys_by_text_and_by_window(spark, lexicon):
    """One pass over a text gives the keys that each window has on its own."""
    values = [
        "Check  my aadhaar card, Zick quicka!", " - आधार कार्ड  and ---  gst ", "a\tb c\nck d", "", "   ", "Éa aa bb-b\u00a0b cc",
        "foob\tbar foob bar", None,
    ]
    df = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    for row in df.select("text", *[co._windows(F.col("text"), w).alias(f"w{w}") for w in (1, 3)]).collect():
        for widest in (1, 3):
            windows = [w.window for w in row[f"w{widest}"] or []]
            keyed = spark.createDataFrame([(w,) for w in windows] or [("",)], "w string")
            want = [r.k for r in keyed.select(co.sound_key(F.col("w")).alias("k")).collect()] if windows else []
            if row.text is None or any(c in row.text for c in "\t\n"):
                continue
            got = df.limit(1).select(co._runs(co.word_keys(F.lit(unicodedata.normalize("NFC", row.text))), widest).alias("k")).first().k
            assert got == want, row.text
    glued = dataclasses.replace(lexicon, longest_words=2)
    found = co.scored_windows(df, ["id"], "text", glued, 0.7).where("id IN (2, 6)").collect()
    assert all(w.window in values[w.id] for w in found)


def test_error_report(spark, lexicon):
    rows = [
        (1, "check my aadhaar card", "check my आधार कार्ड"),
        (2, "gst and upi", "gst and you pi"),
        (3, "nothing here", "nothing here"),
        (4, "plain words", "plain gst words"),
    ]
    log = spark.createDataFrame(rows, "id int, ground_truth_text string, raw_text string")
    scored = plan.with_exact(log.withColumn("arm", F.lit("x")), ["id"], lexicon)
    r = plan.error_report(scored, ["arm"]).first()
    assert (r.n_entity_mentions, r.n_clean_rows, r.n_corrupted) == (3, 2, 1)
    assert round(r.recognition_error_before, 6) == round(1 / 3, 6)
    assert round(r.canonical_miss_before, 6) == round(2 / 3, 6)
    assert (r.canonical_fixed, r.canonical_broken) == (1, 0)
    assert r.corruption_rate == 0.5


def test_both_substring_forms_count_like_a_loop(spark, lexicon):
    values = [*texts(), "upiupi upi", "GSTgst youngsters", "pfpf"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    for form in (lexicon, dataclasses.replace(lexicon, spellings=None)):
        got = m.with_substring_hits(df, "text", form, "h").collect()
        for r in got:
            want = [
                (s.canonical, s.variant.lower(), r.text.lower().count(s.variant.lower()))
                for s in lexicon.spellings
            ]
            assert [tuple(h) for h in r.h] == [w for w in want if w[2]], r.text


def test_unchanged_texts_keep_their_mentions(spark, lexicon):
    """Mentions that the log brings are kept, and an unchanged text is not searched again."""
    log = spark.createDataFrame(
        [(1, "my upi is here", "my upi is here"), (2, "nothing", "nothing"), (3, "gst", "Gst.")],
        "example_id int, ground_truth_text string, raw_text string",
    )
    once = log.withColumn("gt_mentions", m.mentions_in_row(F.col("ground_truth_text"), lexicon))
    want = ["raw_mentions", "exact_text", "exact_mentions"]
    assert lexicon.small
    got = plan.with_exact(once, ["example_id"], lexicon).orderBy("example_id")
    full = m.add_mentions(
        plan.with_exact(log, ["example_id"], lexicon), ["example_id"], {"again": "exact_text"}, lexicon
    ).orderBy("example_id")
    assert got.select("gt_mentions", *want).collect() == full.select("gt_mentions", *want).collect()
    assert [r.exact_mentions for r in full.collect()] == [r.again for r in full.collect()]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (exact_text" in text


def test_overlapping_spellings_agree_in_the_row_and_by_join(spark):
    spellings = ["de la", "la mer", "de", "de la mer", "l'\\mer", "la-mer", "mer", "é la", "mer de la mer"]
    rows = [(f"C{i}", "latin", v, i) for i, v in enumerate(spellings)]
    frame = spark.createDataFrame(rows, "canonical string, script string, variant string, ord int")
    rng = random.Random(4)
    pieces = ["de", "LA", "mer", "é", "dela", " ", "-", "\n", "  ", "x", "Mer de la mer"]
    texts = [None, "", "de", "de la mer de la mer", "mer"]
    texts += [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    few, many = Lexicon.of(frame), Lexicon.of(frame, in_row_limit=0)
    assert few.spellings and not few.small and many.spellings is None
    found = [m.add_mentions(df, ["k"], {"x": "t"}, lex) for lex in (few, many)]
    assert "Join" not in found[0]._jdf.queryExecution().optimizedPlan().toString()
    one, other = ({r.k: r.x for r in f.collect()} for f in found)
    assert one == other and sum(map(len, one.values())) > 300
    hits = [{r.k: r.hits for r in m.with_substring_hits(df, "t", lex).collect()} for lex in (few, many)]
    assert hits[0] == hits[1]


def test_mentions_are_worked_out_once(spark):
    frame = spark.createDataFrame([("A", "latin", "ab", 1), ("B", "latin", "cd", 2)], "canonical string, script string, variant string, ord int")
    df = spark.createDataFrame([(1, "ab cd"), (2, "x"), (3, None)], "k int, t string")
    found = m.add_mentions(df, ["k"], {"mentions": "t"}, Lexicon.of(frame))
    hits = plan.variant_hits(found)
    assert {(r.canonical, r.hits) for r in hits.collect()} == {("A", 1), ("B", 1)}
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    log = co.correct(df, ["k"], "t", Lexicon.of(frame), "fuzzy").select("k", rows_of(F.col("corrections"))).where("stage = 'exact'")
    assert log.count() == 2
    assert log._jdf.queryExecution().optimizedPlan().toString().count("match(") == 1

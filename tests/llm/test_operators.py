"""The other operators: brute force, round trips and held-out accuracy on small inputs."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tests.llm.test_text_dedup import lower
from utterlab.functions.stats import binomial_cdf
from utterlab.llm import chat_format, decontamination, packing, pii, quality, toxicity, warc
from utterlab.llm.shared import scratch, written

SF = "/root/testdata/sf0.001"


# --- toxicity ------------------------------------------------------------------------------


def toxic_texts(n: int) -> list[tuple[int, str, int]]:
    rng, out = random.Random(2), []
    for i in range(n):
        text, bad = prose(i, rng.randint(20, 60)), int(rng.random() < 0.3)
        if bad:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["zzqwx", "kkvqz", "wwxzk"])
        out.append((i, " ".join(text), bad))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_texts(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic")
    again = toxicity.fit(docs.repartition(5), labels, "toxic")
    assert np.allclose(model.weight, again.weight) and math.isclose(model.bias, again.bias)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = sum((got[i] >= 0.3) == bool(bad) for i, _, bad in rows if i >= 300)
    assert right >= 97


def test_toxicity_keeps_the_whole_feature_budget(spark):
    rows = [(i, " ".join(prose(i, 60)), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, "toxic", min_docs=1).index) == 8_192


def test_toxicity_edge_cases(make, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    docs = make(["bad bad", "good", None, "", "x " * 700_000])
    model = toxicity.fit(docs.select("doc_id", "text"), labels, "toxic", min_docs=1)
    rows = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 5
    assert rows[2].score == rows[3].score
    one_class = toxicity.fit(docs.select("doc_id", "text"), labels.where("toxic = 1"), "toxic")
    assert 0.5 < 1 / (1 + math.exp(-one_class.bias)) < 1
    assert toxicity.fit(docs.select("doc_id", "text"), labels.where("false"), "toxic").bias == 0
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_features_do_not_depend_on_the_piece(monkeypatch):
    text, every = " ".join(prose(1, 400)), np.ones(1 << toxicity.BITS, bool)
    whole = toxicity.features(text, every)
    monkeypatch.setattr(toxicity, "_PIECE", 64)
    assert np.array_equal(whole, toxicity.features(text, every))


# --- decontamination -----------------------------------------------------------------------


def test_decontamination_tolerates_substitutions(make, spark):
    rng = random.Random(4)
    items = [prose(i, n) for i, n in enumerate([40, 25, 14, 5, 3])]
    tests = spark.createDataFrame(
        [(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "  ")], "item_id long, text string"
    )
    texts, want = [], set()
    for d in range(60):
        body = prose(500 + d, rng.randint(5, 80))
        if d % 2:
            i = d % len(items)
            passage = [w.upper() for w in items[i]]
            for _ in range(len(passage) // 10 if d % 4 == 1 else 0):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = passage
            want.add((d, i))
        texts.append(" ".join(body))
    texts += [None, "", " ".join(items[0][:9])]
    docs = make(texts)
    for size in (4 << 20, 300):  # one block, or several
        rows = decontamination.find_overlaps(docs, tests, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
        for r in rows:
            got = lower(texts[r.doc_id])[r.start_word : r.start_word + r.n_words]
            item = items[r.item_id]
            assert r.equal_words >= 0.8 * min(13, len(item)) and r.equal_words <= len(got)
        clean = decontamination.decontaminate(docs, tests, block_bytes=size)
        assert clean.columns == docs.columns
        assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_overlaps(docs, none).count() == 0
    assert decontamination.decontaminate(docs, none).count() == len(texts)
    assert decontamination.find_overlaps(docs.where("false"), tests).count() == 0


def test_decontamination_holds_one_block_at_a_time(make, spark, monkeypatch):
    tests = spark.createDataFrame([(i, " ".join(prose(i, 20))) for i in range(12)], "item_id long, text string")
    docs, events = make([" ".join(prose(i, 20)) for i in range(6, 30)]), []
    pack, write = decontamination._packed, decontamination.written
    monkeypatch.setattr(decontamination, "_packed", lambda t: events.append("collected") or pack(t))
    monkeypatch.setattr(decontamination, "written", lambda d, n: events.append("written") or write(d, n))
    rows = decontamination.find_overlaps(docs, tests, block_bytes=400).collect()
    assert {r.doc_id + 6 for r in rows} == {r.item_id for r in rows} == set(range(6, 12))
    assert len(events) > 2 and events == (["collected", "written"] * len(events))[: len(events)]


def test_overlaps_take_any_stretch_of_enough_equal_words():
    import itertools

    import pyarrow as pa

    from utterlab.llm.words import words

    def brute(item: list[str], text: list[str]) -> bool:
        least = min(13, len(item))
        for shift in range(-len(item), len(text)):
            same = [0 <= i + shift < len(text) and item[i] == text[i + shift] for i in range(len(item))]
            low, high = max(0, -shift), min(len(item), len(text) - shift)
            for a, b in itertools.combinations(range(low, high + 1), 2):
                if b - a >= least and 10 * sum(same[a:b]) >= 8 * (b - a):
                    return True
        return False

    rng, found, wanted = random.Random(21), 0, 0
    for n, k in [(13, 1), (13, 2), (16, 2), (16, 3), (20, 3), (20, 5), (39, 7), (9, 1)] * 12:
        item = prose(rng.randrange(10**6), n)
        passage = list(item)
        for i in rng.sample(range(n), k):
            passage[i] = "changed"
        text = [*prose(rng.randrange(10**6), rng.randint(0, 30)), *passage, *prose(rng.randrange(10**6), rng.randint(0, 30))]
        index = decontamination.SeedIndex(pa.array([" ".join(item)]))
        said = words(pa.array([" ".join(text)]))
        rows = list(index.overlaps(said, 13, 0.8))
        if len(index.diagonals(said)):  # the seeds only propose
            wanted += brute(item, text)
            assert bool(rows) == brute(item, text), (n, k)
            found += len(rows)
        for _, _, first, size, equal in rows:
            assert size >= min(13, n) and equal >= 0.8 * size and first + size <= len(text)
    assert found == wanted >= 60


# --- packing -------------------------------------------------------------------------------


def test_packing_places_every_id_once(make, spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(6)
    texts = [" ".join(prose(i, int(rng.lognormvariate(4, 1.2)))) for i in range(80)]
    texts += [None, "", "<|endoftext|> A, b!! it's", "ÉTÉ İ Σας 123", "word " * 9000, "x" * 70_000, texts[0], texts[0]]
    rows = packing.pack_documents(make(texts)).collect()
    ids = {i: [*coder.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    spans, windows = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in ids.items():
        assert sum(n for _, n in spans[i]) == len(t) and len(set(spans[i])) == len(spans[i])
    for places in windows.values():
        places.sort()
        assert [p[0] for p in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert sorted(windows) == list(range(len(windows)))
    assert len(windows) <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_minimum_bin_slack_is_closest():
    rng = random.Random(1)
    for _ in range(200):
        stock = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        room = rng.randint(1, 60)
        reach = {0}
        for k, n in stock.items():
            for _ in range(n):
                reach |= {x + k for x in reach}
        fill = packing._closest(dict(stock), room)
        assert all(n <= stock[k] for k, n in fill.items())
        assert sum(k * n for k, n in fill.items()) == max(x for x in reach if x <= room)
        plan = packing.minimum_bin_slack(stock, 60)
        used = Counter()
        for pattern, times in plan:
            assert sum(k * n for k, n in pattern.items()) <= 60
            used.update({k: n * times for k, n in pattern.items()})
        assert used == Counter(stock)


def test_packing_empty_table(make):
    assert packing.pack_documents(make([]).where("false")).count() == 0


# --- quality -------------------------------------------------------------------------------


def brute_counts(text: str) -> dict:
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_quality_counts_equal_brute_force(make):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "é", "c\n", "###", "\t|"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " ", "a\x0bb\x0cc\rd", "x y z " * 40_000, "l\nl\n \n \nm", "日本 語"]
    rows = quality.count_features(make(texts), "text", ("doc_id", "class")).collect()
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
    assert len(rows) == len(texts)


def test_quality_cutoffs_control_risk(spark):
    rng = random.Random(9)
    rows = [("en", 0.1 + 0.01 * rng.random(), 1) for _ in range(400)] + [("en", 5.0, 0)] * 50
    rows += [("de", 2.9, 1)] * 200 + [("de", 9.0, 0)] * 10 + [("fr", 0.1, 1)] * 5 + [(None, 0.1, 1)] * 300 + [("en", 1.0, None)]
    df = spark.createDataFrame(rows, "lang string, risk double, quality int")
    got = {r.lang: r.cutoff for r in quality.choose_cutoffs(df.repartition(4), "lang", "risk", "quality").collect()}
    # de: below 3 all clean documents would go; fr: too few labels; the others stop where junk does
    assert got == {"en": 4.0, "de": 4.0, "fr": None, None: 4.0}
    assert quality.choose_cutoffs(df.where("false"), "lang", "risk", "quality").count() == 0


def test_binomial_cdf_is_exact():
    for n, p in ((1, 0.5), (30, 0.05), (200, 0.3), (900, 0.02)):
        for k in range(0, n + 1, max(1, n // 7)):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(binomial_cdf(k, n, p), want, rel_tol=1e-9)


def test_quality_query_keeps_clean_documents(spark):
    rows = quality.quality_rules(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    clean = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(clean) >= 0.95 * len(clean)


# --- personal data -------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum((2 * int(c) - 9 * (c > "4") if i % 2 else int(c)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_spans(text: str) -> list[tuple]:
    out = [
        (m.start(), k, m.end(), kind)
        for k, (kind, p) in enumerate(BASE.items())
        for m in re.finditer(p, text or "")
        if holds(kind, m[0])
    ]
    return sorted(out)


def pii_texts() -> list[str]:
    rng = random.Random(11)
    bits = ["a@b.c", "x.y%+@q-r.de", "@", "é", " ", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "001.0255.3.4", "+", "(", ")", "-",
            "4111111111111111", "4111-1111 1111 1111", "4111111111111112", "+1 (234) 555-1234", "12", "7", ".", "🙂", "\n", "٤"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    return [*texts, None, "", "a" * 200_000, "1 " * 50_000, "a@b.c " * 300, "+1 (234) 555-1234 4111111111111111"]


def test_pii_base_equals_brute_force(make):
    texts = pii_texts()
    rows = pii.redactions(pii.spans_of(make(texts)), [], {}).select("doc_id", pii.written_spans(F.col("base")).alias("b")).collect()
    for r in rows:
        want = ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in brute_spans(texts[r.doc_id]))
        assert r.b == want, texts[r.doc_id]
    assert len(rows) == len(texts)


def test_pii_base_finds_numbers_in_short_groups(make):
    rng, texts = random.Random(12), ["+33 6 12 34 56 78", "378 282 246 310 005", "call (123) 456-7890 now"]
    digits = ["4111111111111111", "378282246310005", "4111111111111112", "33612345678"]
    for i in range(200):
        number, said = rng.choice(digits), ""
        while number:
            size = rng.randint(1, 3)
            said, number = said + number[:size] + rng.choice([" ", "-", ""]) * bool(number[size:]), number[size:]
        texts.append("word " * (i % 3) + "+" * rng.randint(0, 1) + said + " end" * (i % 2))
    found = pii.spans_of(make(texts)).select("doc_id", "candidates", pii.written_spans(F.col("base")).alias("b"))
    rows = {r.doc_id: r for r in found.collect()}
    for i, text in enumerate(texts):
        assert rows[i].b == ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in brute_spans(text)), text
    assert rows[0].b == "phone:0:17" and rows[1].b == "card:0:19"
    assert [(c.start, c.end) for c in rows[2].candidates] == [(5, 19)]


def test_pii_model_adds_what_the_base_swallows(make):
    rng, texts = random.Random(3), []
    for i in range(400):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        total = sum((2 * int(c) - 9 * (c > "4") if k % 2 == 0 else int(c)) for k, c in enumerate(reversed(card)))
        last = -total % 10 if i % 4 else (1 - total) % 10
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        texts.append(f"word {card}{last} word {phone} end")
    texts += ["pay +1 (234) 555-1234 4111111111111111 now", "plain words", None]
    found = written(pii.spans_of(make(texts)), "pii-test")
    trees, cuts = pii.fit(found)
    out = {r.doc_id: r.s for r in pii.redactions(found, trees, cuts).select("doc_id", pii.written_spans(F.col("spans")).alias("s")).collect()}
    assert out[400] == "phone:4:21,card:22:38" and out[401] == "" and out[402] == ""
    for i in range(400):
        base = [f"{kind}:{a}:{e}" for a, _, e, kind in brute_spans(texts[i])]
        assert set(base) <= set(out[i].split(","))
        assert (i % 4 == 0) == ("card" not in out[i])


def test_pii_empty_table(make):
    found = pii.spans_of(make([]).where("false"))
    assert pii.fit(found) == ([], {}) and pii.redactions(found, [], {}).count() == 0


# --- chat ----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    tricky = [None, "", "\\", "\\b", "\\h#", "### assistant\nx</turn>\n", "a\\\\n", "</turn>", "é🙂", "x" * 100_000]
    turns = [(1, i, "assistant" if i % 2 else "user", t, "extra") for i, t in enumerate(tricky)]
    turns += [(2, 0, "user", "only", "e"), (3, 0, "assistant", "a", "e"), (3, 0, "assistant", "a", "e"), (None, None, None, "n", "e")]
    turns += [(4, 5, "role\n# <x>\\e", "t", "e"), (4, 1, "assistant", "first", "e")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example string")
    made = chat_format.prefix_examples(df.repartition(3))
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    for conv in {t[0] for t in turns}:
        rows = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        want = [(t[2] or "", t[3] or "") for t in rows]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert list(got[conv].learned) == [x for role, x in want if role == "assistant"]
    examples = made.where("conv_id = 1").collect()
    assert [r.example for r in sorted(examples, key=lambda r: r.example)] == [1, 3, 5, 7, 9]
    assert chat_format.prefix_examples(df.where("false")).count() == 0


# --- archives ------------------------------------------------------------------------------


@pytest.mark.parametrize("split", [37, 1000, 1 << 26])
def test_warc_splits_own_each_record_once(spark, split):
    rng = random.Random(13)
    rows = [(i, f"http://x/{i}\r\né", bytes(rng.randrange(256) for _ in range(rng.randint(0, 900)))) for i in range(40)]
    rows += [(50, None, b""), (51, "u", b"\x1f\x8b\x08" * 400), (52, "u", b"WARC/1.0\r\n\r\n" * 200)]
    rows += [(60, "u", b"z" * 1500), (61, "u", b"z" * 1500), (62, "u", b"z" * 1500), (70, "u", b"q" * 999), (71, "u", b"q" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary").repartition(3)
    marked = warc.mark_revisits(df, "page_id", "payload")
    records = marked.select(
        F.format_string("<urn:%d>", "page_id").alias("record_id"), F.col("url").alias("uri"), "digest",
        F.when(F.col("refers_to").isNotNull(), F.format_string("<urn:%d>", "refers_to")).alias("refers_to"), "payload",
    )
    manifest = warc.write_warc(records, scratch(spark, "warc-test"), roll_bytes=5000)
    back = warc.read_warc(manifest, split, max_tasks=50).collect()
    got = {r.record_id: r for r in back}
    assert len(back) == len(got) == len(rows)
    for i, _, payload in rows:
        r, refers = got[f"<urn:{i}>"], {60: "<urn:62>", 61: "<urn:62>"}.get(i)
        assert (r.type, r.refers_to) == ("revisit" if refers else "response", refers)
        assert r.payload_bytes == len(payload) and r.digest == hashlib.sha1(payload).hexdigest()
        assert r.payload == (None if refers else bytearray(payload))
    files = [r.path for r in manifest.collect()]
    assert warc.archives(spark, *files).count() == len(files)


def test_warc_ignores_what_is_no_record(spark, tmp_path):
    good = warc._member({"payload": b"hi", "digest": "0" * 40, "record_id": "<urn:1>", "uri": None, "refers_to": None}, "d")
    (tmp_path / "a.warc.gz").write_bytes(b"junk\x1f\x8b\x08junk" + gzip.compress(b"not a record") + good + good[:30])
    files = warc.archives(spark, str(tmp_path / "a.warc.gz"))
    rows = warc.read_warc(files, 7).collect()
    assert [r.record_id for r in rows] == ["<urn:1>"]


def test_warc_headers_of_other_writers_are_rejected_alone(spark, tmp_path):
    def member(digest, length, http="Content-Length: 2"):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: {length}"
        return gzip.compress(f"{head}\r\n\r\nHTTP/1.1 200 OK\r\n{http}\r\n\r\nhi".encode())

    size = len("HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")
    sha = hashlib.sha1(b"hi").hexdigest()
    cases = [
        (member(f"sha1:{sha}", size), sha, None),
        (member("sha256:" + "0" * 64, size), None, "warc-payload-digest"),
        (member("md5:" + "0" * 32, size), None, "warc-payload-digest"),
        (member("sha1:zz", size), None, "warc-payload-digest"),
        (member(f"sha1:{sha}", ""), sha, "content-length"),
        (member(f"sha1:{sha}", "x", "Content-Length: ²"), sha, "content-length, http content-length"),
        (member("", size), None, None),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(c[0] for c in cases))
    rows = warc.read_warc(warc.archives(spark, str(tmp_path / "a.warc.gz"))).collect()
    got = [(r.digest, r.reject, bytes(r.payload), r.payload_bytes) for r in sorted(rows, key=lambda r: r.offset)]
    assert got == [(digest, reject, b"hi", 2) for _, digest, reject in cases]


def test_warc_of_nothing(spark):
    none = spark.createDataFrame([], "record_id string, uri string, digest string, refers_to string, payload binary")
    assert warc.read_warc(warc.write_warc(none, scratch(spark, "warc-test"))).count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from tests.llm.test_text_dedup import brute_components, brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    tests = [lower(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in now.collect()}
        out = written(stage(spark, now, SF), f"test-{name}")
        kept = {r.doc_id: r for r in out.collect()} if name != "packing" else {}
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            known = {r.doc_id: r.toxic for r in labels.collect()}
            wrong = [i for i, t in known.items() if (i in kept) == bool(t)]
            assert len(wrong) <= 0.1 * len(known)
        elif name == "line_dedup":
            want = brute_lines([(i, r.text) for i, r in rows.items()])
            gone = {i for i in rows if rows[i].text != want[i] and not lower(want[i])}
            assert {i: r.text for i, r in kept.items()} == {i: t for i, t in want.items() if i not in gone}
            assert all(r.n_chars == len(r.text) for i, r in kept.items() if r.text != rows[i].text)
        elif name == "ngram_jaccard_join":
            order = sorted(rows)
            groups = brute_components([rows[i].text for i in order])
            assert set(kept) == {order[k] for k, c in groups.items() if k == c}
        elif name == "decontamination":
            hit = set()
            for i, r in rows.items():
                said = f" {' '.join(lower(r.text))} "
                if any(t and f" {' '.join(t)} " in said for t in tests):
                    hit.add(i)
            assert set(kept) == set(rows) - hit
        else:
            assert {r.doc_id for r in out.collect()} == set(rows)
        now = out
    assert corpus_pipeline.run(spark, SF).count() == now.count()

"""Personal data: candidates proposed by patterns, judged by gradient-boosted trees.

Built-in functions only. Four base patterns find certain spans, which always stay. High
recall generators propose further spans, overlapping ones too. Candidates that the base
confirms or refutes are labels: a candidate equal to a base span is positive, one of a
base match that failed its check (and holds no valid part) is negative. All features are
binned, so the labelled candidates of the whole corpus collapse to counts per feature
vector, at most ``MAX_VECTORS`` of them; trees are boosted on these counts. Half of the
labels (by hash of the document id) calibrate: per kind, the lowest score whose precision
on them stays above ``precision`` by an exact binomial bound is the threshold, and a kind
too rare for any bound takes the pooled one. The model is a CASE expression. As labels follow
the kind's check, which is a feature and demanded of an addition too, the check alone selects.

Defined cases: a null text is empty; matches that fail their check are dropped without a
retry; positions count code points, end exclusive; a null id is kept; without labels of
both signs nothing is added; of overlapping additions the first, then longest, stays, and
none overlaps a base span; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from utterlab.functions.stats import binomial_cdf
from utterlab.functions.text import let
from utterlab.llm.registry import query
from utterlab.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"

#: The base patterns, with run starts spelled out so that no text is scanned twice. Cards
#: of other lengths, and their parts, can never match, so the length is in the pattern.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: (kind, pattern) of each generator.
GENERATORS = (
    ("email", rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"),
    ("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
KEYWORDS = r"(?i)mail|contact|phone|call|tel|mobil|card|visa|pay|host|addr|server"
FEATURES = ("gen", "valid", "size", "before", "after", "word", "first", "varied")
MAX_VECTORS = len(GENERATORS) * 2 * 8 * 5 * 5 * 2 * 10 * 3
_BLOCK = 64


# --- spans -------------------------------------------------------------------------------


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda x: F.try_to_number(x, F.lit("9")).cast("int"))
    total = F.aggregate(
        F.transform(F.filter(each, lambda d: d.isNotNull()), doubled), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def _octets(c: Column) -> Column:
    short = F.transform(F.split(c, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def _between(c: Column, low: int, high: int) -> Column:
    return F.length(_digits(c)).between(low, high)


#: Whether a match of a kind holds.
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: m.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$") | m.rlike(r"(?i)[(\[]at[)\]]"),
    "ip": _octets,
    "card": lambda m: _between(m, 14, 19) & luhn(_digits(m)),
    "phone": lambda m: _between(m, 10, 15),
}
#: Implied by every base pattern and generator of a kind.
_TRIGGER = {"email": r"@|(?i)[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]|\([0-9]{3}\)"}


def _before(lengths: Column, i: Column) -> Column:
    """Sum of the first i lengths, by blocks: a text of many matches stays cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    whole = F.floor(i / _BLOCK).cast("int")
    return total(F.slice(lengths["blocks"], F.lit(1), whole)) + total(
        F.slice(lengths["each"], whole * _BLOCK + 1, i % _BLOCK)
    )


def find(text: Column, pattern: str, trigger: str) -> Column:
    """array<struct<start, end, match, before, after>> of all matches, in code points."""
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )

    def place(p: Column) -> Column:
        each = F.transform(p["hits"], lambda h, i: F.length(F.get(p["gaps"], i)) + F.length(h))
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        lengths = let(
            each,
            lambda e: F.struct(
                e.alias("each"),
                F.transform(
                    F.sequence(F.lit(0), F.floor(F.size(e) / _BLOCK).cast("int")),
                    lambda b: total(F.slice(e, b * _BLOCK + 1, F.lit(_BLOCK))),
                ).alias("blocks"),
            ),
        )
        return let(lengths, lambda l: F.transform(p["hits"], lambda h, i: one(p, l, h, i)))

    def one(p: Column, lengths: Column, hit: Column, i: Column) -> Column:
        start = _before(lengths, i) + F.length(F.get(p["gaps"], i))
        return F.struct(
            start.alias("start"),
            (start + F.length(hit)).alias("end"),
            hit.alias("match"),
            F.right(F.get(p["gaps"], i), F.lit(24)).alias("before"),
            F.left(F.get(p["gaps"], i + 1), F.lit(1)).alias("after"),
        )

    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    none = F.array().cast(kind)
    return F.when(text.rlike(trigger), let(parts, place).cast(kind)).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (0-based), end>> sorted by start, then kind."""


    def of(k: int, kind: str) -> Column:
        found = find(text, BASE[kind], _TRIGGER[kind])
        held = F.filter(found, lambda s: VALID[kind](s["match"]))
        return F.transform(
            held,
            lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")),
        )

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _class(c: Column) -> Column:
    return (
        F.when(c == "", 0).when(c.rlike(r"[\x20\x09-\x0D]"), 1).when(c.rlike("[0-9]"), 2)
        .when(c.rlike(r"\p{L}"), 3).otherwise(4)
    )


def candidate_spans(text: Column) -> Column:
    """array<struct<start, kind, end, features...>> of every generator."""

    def of(g: int, kind: str, pattern: str) -> Column:
        def one(s: Column) -> Column:
            digits = _digits(s["match"])
            size = F.length(digits) if kind != "email" else F.length(s["match"]) / 4
            return F.struct(
                s["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                s["end"].alias("end"),
                F.lit(g).alias("gen"),
                VALID[kind](s["match"]).cast("int").alias("valid"),
                F.least(F.lit(7), F.floor(size / 3)).cast("int").alias("size"),
                _class(F.right(s["before"], F.lit(1))).alias("before"),
                _class(s["after"]).alias("after"),
                s["before"].rlike(KEYWORDS).cast("int").alias("word"),
                F.coalesce(F.try_to_number(F.left(digits, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)).alias("first"),
                F.least(F.lit(2), F.floor(F.size(F.array_distinct(F.split(digits, ""))) / 4)).cast("int").alias("varied"),
            )

        return F.transform(find(text, pattern, _TRIGGER[kind]), one)

    return F.concat(*[of(g, kind, pattern) for g, (kind, pattern) in enumerate(GENERATORS)])


# --- boosting ----------------------------------------------------------------------------

Leaf = float
Tree = tuple  # (feature, cut, low side, high side); a side is a Tree or a Leaf


def _best(rows: list[tuple], depth: int, ridge: float = 1.0) -> Tree | Leaf:
    """Regression tree by second-order gain on (features, gradient, curvature) rows."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    value = -g / (h + ridge)
    if depth == 0:
        return value
    best = (1e-6, None)
    for f in range(len(FEATURES)):
        for cut in sorted({r[0][f] for r in rows})[1:]:
            gl = sum(r[1] for r in rows if r[0][f] < cut)
            hl = sum(r[2] for r in rows if r[0][f] < cut)
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            if gain > best[0]:
                best = (gain, (f, cut))
    if best[1] is None:
        return value
    f, cut = best[1]
    return (
        f, cut,
        _best([r for r in rows if r[0][f] < cut], depth - 1, ridge),
        _best([r for r in rows if r[0][f] >= cut], depth - 1, ridge),
    )


def _walk(tree: Tree | Leaf, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def boost(counts: list[tuple], rounds: int = 20, depth: int = 2, rate: float = 0.5) -> list[Tree]:
    """Trees for (features, positives, negatives) counts, by logistic loss."""
    trees: list[Tree] = []
    scores = [0.0] * len(counts)
    for _ in range(rounds):
        rows = []
        for (x, pos, neg), s in zip(counts, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            rows.append((x, (pos + neg) * p - pos, (pos + neg) * p * (1 - p)))
        tree = _best(rows, depth)
        trees.append(tree)
        scores = [s + rate * _walk(tree, x) for s, (x, _, _) in zip(scores, counts, strict=True)]
    return trees


def score_of(trees: list[Tree], x: tuple, rate: float = 0.5) -> float:
    return sum(rate * _walk(t, x) for t in trees)


def score_column(trees: list[Tree], span: Column, rate: float = 0.5) -> Column:
    """The model as an expression over a candidate struct."""

    def side(tree: Tree | Leaf) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, cut, low, high = tree
        return F.when(span[FEATURES[f]] < cut, side(low)).otherwise(side(high))

    total = F.lit(0.0)
    for t in trees:
        total = total + F.lit(rate) * side(t)
    return total


def thresholds(
    trees: list[Tree], counts: list[tuple], precision: float, level: float = 0.05
) -> dict[int, float]:
    """Per kind, the lowest score above which precision holds at the level."""

    def lowest(rows: list[tuple]) -> float | None:
        pos = neg = 0
        out = None
        ranked = sorted(((score_of(trees, x), p, n) for x, p, n in rows), reverse=True)
        for i, (s, p, n) in enumerate(ranked):
            pos, neg = pos + p, neg + n
            whole = i + 1 == len(ranked) or ranked[i + 1][0] != s
            # exact test of "wrong in more than 1 - precision of the cases"
            if whole and binomial_cdf(neg, pos + neg, 1 - precision) <= level:
                out = s
        return out

    pooled = lowest(counts)
    kind_of = lambda x: KINDS.index(GENERATORS[x[0]][0])
    out = {}
    for k in range(len(KINDS)):
        own = lowest([r for r in counts if kind_of(r[0]) == k])
        chosen = own if own is not None else pooled
        if chosen is not None:
            out[k] = max(chosen, 0.0) - 1e-6  # sums may differ in their last digits
    return out


# --- the operator ------------------------------------------------------------------------


def spans_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """(id, base, candidates) of every text, in one scan."""
    value = F.coalesce(F.col(text), F.lit(""))
    some = value.rlike(r"[0-9@]|(?i)[(\[]at[)\]]")
    return docs.select(
        F.col(id_col),
        *keep,
        F.when(some, base_spans(value)).alias("base"),
        F.when(some, candidate_spans(value)).alias("candidates"),
    )


def _labelled(found: DataFrame, id_col: str) -> DataFrame:
    """Candidates with ``positive`` where the base decides: equal to a base span, or invalid
    and apart from all of them."""
    meets = lambda c: F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    equal = lambda c: F.exists(
        "base", lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"]) & (b["kind"] == c["kind"])
    )
    rows = found.select(id_col, "base", F.explode("candidates").alias("c"))
    sure = F.when(equal(F.col("c")), True).when(~meets(F.col("c")) & (F.col("c.valid") == 0), False)
    return rows.select(id_col, "c.*", sure.alias("positive")).where("positive IS NOT NULL")


def fit(found: DataFrame, id_col: str = "doc_id", precision: float = 0.95) -> tuple[list[Tree], dict[int, float]]:
    """Trees and thresholds from the counts of all labelled candidates."""
    holdout = F.pmod(F.xxhash64(id_col), F.lit(2)) == 1
    counts = (
        _labelled(found, id_col)
        .groupBy(*FEATURES)
        .agg(
            *[
                F.count_if(side & (F.col("positive") == sign)).alias(name)
                for side, sign, name in (
                    (~holdout, True, "p0"), (~holdout, False, "n0"),
                    (holdout, True, "p1"), (holdout, False, "n1"),
                )
            ]
        )
        .collect()  # at most MAX_VECTORS rows
    )
    vector: Callable[[Row], tuple] = lambda r: tuple(r[f] for f in FEATURES)
    train = [(vector(r), r["p0"], r["n0"]) for r in counts if r["p0"] + r["n0"]]
    held = [(vector(r), r["p1"], r["n1"]) for r in counts if r["p1"] + r["n1"]]
    if not any(r[1] for r in train) or not any(r[2] for r in train):
        return [], {}
    trees = boost(train)
    return trees, thresholds(trees, held, precision)


def redactions(found: DataFrame, trees: list[Tree], cuts: dict[int, float]) -> DataFrame:
    """``found`` with ``spans``: the base and the chosen candidates, sorted."""
    if not trees or not cuts:
        return found.withColumn("spans", F.col("base"))
    enough = F.lit(False)
    chosen = lambda c: _any(
        [(c["kind"] == k) & (score_column(trees, c) >= F.lit(t)) for k, t in cuts.items()], enough
    )
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    order = lambda c: F.struct(c["start"], (-c["end"]).alias("last"), c["kind"], c["end"])
    added = F.array_sort(
        F.transform(F.filter("candidates", lambda c: (c["valid"] == 1) & free(c) & chosen(c)), order)
    )
    kind = "array<struct<start:int,kind:int,end:int>>"
    start = F.struct(F.lit(-1).alias("upto"), F.array().cast(kind).alias("kept"))
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    fold = lambda a, c: F.when(
        c["start"] >= a["upto"],
        F.struct(c["end"].alias("upto"), F.array_append(a["kept"], span(c)).alias("kept")),
    ).otherwise(a)
    kept = F.aggregate(added, start, fold, lambda a: a["kept"])
    return found.withColumn(
        "spans", F.when(F.size("candidates") > 0, F.array_sort(F.concat("base", kept))).otherwise(F.col("base"))
    )


def _any(conditions: list[Column], none: Column) -> Column:
    for c in conditions:
        none = none | c
    return none


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(F.coalesce(spans, F.array().cast("array<struct<start:int,kind:int,end:int>>")), said), ",")


@query("op8_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which personal data does every document hold?"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = written(spans_of(docs), "pii")
    trees, cuts = fit(found)
    out = redactions(found, trees, cuts)
    count = lambda k: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)), F.lit(0))
    return out.select(
        "doc_id",
        *[count(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"),
        written_spans(F.col("spans")).alias("spans"),
    )

"""Entity mentions: word-bounded, case-folded, longest spelling first.

Three physical forms give the same array. A small lexicon whose spellings cannot
overlap is one regular expression evaluated in the row. One whose spellings overlap
is tried at every word of the row, followed by a claim per text. A large lexicon is a
broadcast hash join of word n-grams, followed by the same claim.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlab.functions.text import WORD, fold, let, prefix_pattern, quoted, rows_of
from utterlab.sources.lexicon import Lexicon, is_word_char
from utterlab.sources.tables import small_side

MENTION = "array<struct<canonical:string,variant:string,start:int,end:int>>"
CANDIDATE = "array<struct<neg_len:int,at:int,to:int,canonical:string,variant:string>>"
_BEFORE, _AFTER = f"(?<![{WORD}])", f"(?![{WORD}])"


def _hits(needles: Iterable[str], ahead: bool = False) -> tuple[str, str]:
    """Patterns over a text with a blank before it. A place is tried after a character that parts
    words only, and then by the first letter: all up to the end of each needle, and the needle
    (group 1) at the end of that. With ``ahead`` the needle is not taken, so another may begin
    within it: all up to it, and the needle (group 1) at each word. Neither goes through
    ``split``, which compiles its pattern for each row.
    """
    letters = "".join(quoted(c) for c in sorted({needle[0] for needle in needles}))
    needle = f"(?=[{letters}]){prefix_pattern(needles)}{_AFTER}"
    if ahead:
        return f"(?s)\\G(.*?[^{WORD}])(?={needle})", f"[^{WORD}](?=({needle}))"
    return f"(?s)\\G(.*?[^{WORD}]){needle}", f"[^{WORD}]({needle})\\z"


def _no_mentions() -> Column:
    return F.array().cast(MENTION)


def mentions_in_row(text: Column, lexicon: Lexicon) -> Column:
    """Mention array of a text, for a small lexicon."""
    first: dict[str, tuple[str, str]] = {}
    spellings = lexicon.spellings or ()
    # as it is written (a text with a letter that folds into two is only lower-cased), then folded
    for s in spellings:
        first.setdefault(s.lowered, (s.canonical, s.variant))
    for s in spellings:
        first.setdefault(s.needle, (s.canonical, s.variant))
    if not first:
        return _no_mentions()
    part, hit = _hits(first)
    # a map is searched from its first key on, so there is one by first letter and one for each
    letters: dict[str, list[str]] = {}
    for needle, (canonical, variant) in first.items():
        named = f"named_struct('canonical', {_sql(canonical)}, 'variant', {_sql(variant)})"
        letters.setdefault(needle[0], []).append(f"{_sql(needle)}, {named}")
    known = F.expr("map(" + ", ".join(f"{_sql(k)}, map({', '.join(v)})" for k, v in letters.items()) + ")")

    def locate(padded: Column, parts: Column) -> Column:
        steps = F.transform(
            parts, lambda p: F.struct(F.length(p).alias("length"), F.regexp_extract(p, hit, 1).alias("hit"))
        )

        def add(state: Column, step: Column) -> Column:
            end = state["at"] + step["length"]
            start = end - F.length(step["hit"])
            found = known[F.left(step["hit"], F.lit(1))][step["hit"]]
            mention = F.struct(
                found["canonical"].alias("canonical"),
                found["variant"].alias("variant"),
                start.alias("start"),
                end.alias("end"),
            )
            return F.struct(
                end.alias("at"), F.concat(state["out"], F.array(mention)).alias("out")
            )

        start_state = F.struct(F.lit(-1).alias("at"), _no_mentions().alias("out"))
        return F.aggregate(steps, start_state, add, lambda s: s["out"])

    return _located(text, part, 0, locate, _no_mentions())


def _located(
    text: Column, pattern: str, group: int, locate: Callable[[Column, Column], Column], none: Column
) -> Column:
    """``locate`` of the padded folded text and what ``pattern`` finds in it; else ``none``."""
    return let(
        F.concat(F.lit(" "), fold(text)),
        lambda padded: let(
            F.regexp_extract_all(padded, F.lit(pattern), F.lit(group)),
            lambda found: F.when(F.size(found) > 0, locate(padded, found)).otherwise(none),
        ),
    )


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _known(rows: dict[str, list[str]]) -> Column:
    """A literal map of SQL structs: hundreds of them, made by one call."""
    return F.expr("map(" + ", ".join(f"{_sql(k)}, array({', '.join(v)})" for k, v in rows.items()) + ")")


def _overlapping_in_row(text: Column, needles: dict[str, tuple[str, str]]) -> Column:
    """Mention array of a text, for few needles that may overlap each other.

    The longest needle at each word is found by looking ahead; the others that begin there
    are the needles that it begins with, which are known beforehand.
    """
    if not needles:
        return _no_mentions()
    gap, hit = _hits(needles, ahead=True)

    def begun(needle: str) -> list[str]:
        cuts = range(1, len(needle) + 1)
        ends = (n for n in cuts if n == len(needle) or not is_word_char(needle[n]))
        return [needle[:n] for n in ends if needle[:n] in needles]

    known = _known(
        {
            needle: [
                f"named_struct('len', {len(n)}, 'canonical', {_sql(needles[n][0])}, 'variant', {_sql(needles[n][1])})"
                for n in begun(needle)
            ]
            for needle in needles
        }
    )

    def locate(padded: Column, hits: Column) -> Column:
        steps = F.zip_with(
            F.regexp_extract_all(padded, F.lit(gap), F.lit(1)),
            hits,
            lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")),
        )

        def add(state: Column, step: Column) -> Column:
            start = state["at"] + step["gap"]
            found = F.transform(
                known[step["hit"]],
                lambda s: F.struct(
                    (-s["len"]).alias("neg_len"), start.alias("at"), (start + s["len"] - 1).alias("to"),
                    s["canonical"].alias("canonical"), s["variant"].alias("variant"),
                ),
            )
            return F.struct(start.alias("at"), F.concat(state["out"], found).alias("out"))

        start_state = F.struct(F.lit(-1).alias("at"), F.array().cast(CANDIDATE).alias("out"))
        return F.aggregate(steps, start_state, add, lambda s: s["out"])

    placed = F.transform(
        _claim(_located(text, hit, 1, locate, F.array().cast(CANDIDATE))),
        lambda c: F.struct(
            c["canonical"].alias("canonical"), c["variant"].alias("variant"),
            c["at"].alias("start"), (c["at"] + c["len"]).alias("end"),
        ),
    )
    return F.coalesce(placed, _no_mentions())


def _word_grams(folded: Column, widest: int) -> Column:
    """Every run of 1..widest neighbouring words with the exact text between them."""

    def grams(pieces: Column) -> Column:
        n = F.size(pieces)
        first = F.when(F.get(pieces, F.lit(0)).rlike(f"^[{WORD}]"), 1).otherwise(2)
        starts = F.when(first <= n, F.sequence(first, n, F.lit(2))).otherwise(
            F.array().cast("array<int>")
        )
        return F.flatten(
            F.transform(
                starts,
                lambda i: F.transform(
                    F.filter(
                        F.sequence(F.lit(1), F.lit(widest)), lambda w: i + 2 * w - 2 <= n
                    ),
                    lambda w: F.struct(
                        i.alias("at"),
                        (i + 2 * w - 2).alias("to"),
                        F.array_join(F.slice(pieces, i, 2 * w - 1), "").alias("gram"),
                    ),
                ),
            )
        )

    return let(_pieces(folded), grams)


def _pieces(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(f"[{WORD}]+|[^{WORD}]+"), F.lit(0))


def _claim(candidates: Column) -> Column:
    """Greedy claim over (neg_len, at, to, canonical, variant), kept in text order."""

    def step(claimed: Column, c: Column) -> Column:
        clash = F.exists(claimed, lambda k: (c["at"] <= k["to"]) & (c["to"] >= k["at"]))
        return F.when(clash, claimed).otherwise(F.concat(claimed, F.array(c)))

    claimed = F.aggregate(F.array_sort(candidates), F.array().cast(CANDIDATE), step)
    return F.array_sort(
        F.transform(
            claimed,
            lambda c: F.struct(
                c["at"].alias("at"),
                (-c["neg_len"]).alias("len"),
                c["canonical"].alias("canonical"),
                c["variant"].alias("variant"),
            ),
        )
    )


def _placed(text: Column, claimed: Column) -> Column:
    """Claimed piece positions turned into code-point offsets of the text."""

    def locate(pieces: Column) -> Column:
        def one(c: Column) -> Column:
            return let(
                F.length(F.array_join(F.slice(pieces, F.lit(1), c["at"] - 1), "")),
                lambda start: F.struct(
                    c["canonical"].alias("canonical"),
                    c["variant"].alias("variant"),
                    start.alias("start"),
                    (start + c["len"]).alias("end"),
                ),
            )

        return F.transform(claimed, one)

    return F.when(claimed.isNotNull(), let(_pieces(fold(text)), locate)).otherwise(_no_mentions())


def _needles(lexicon: Lexicon) -> DataFrame:
    return (
        lexicon.frame.withColumn("gram", fold(F.col("variant")))
        .groupBy("gram")
        .agg(F.min_by(F.struct("canonical", "variant"), "ord").alias("found"))
    )


def _mentions_by_join(
    df: DataFrame, keys: list[str], texts: dict[str, str], lexicon: Lexicon
) -> DataFrame:
    """Mention arrays of several text columns through one join and one grouping."""
    needles = _needles(lexicon)
    stacked = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(out).alias("which"), fold(F.col(src)).alias("folded"))
                    for out, src in texts.items()
                ]
            )
        ).alias("t"),
    )
    candidates = (
        stacked.select(
            *keys, "t.which", rows_of(_word_grams(F.col("t.folded"), lexicon.widest))
        )
        .join(small_side(needles), "gram")
        .select(
            *keys,
            "which",
            F.struct(
                (-F.length("gram")).alias("neg_len"),
                "at",
                "to",
                "found.canonical",
                "found.variant",
            ).alias("c"),
        )
    )
    claimed = (
        candidates.groupBy(*keys, "which")
        .agg(_claim(F.collect_list("c")).alias("claimed"))
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("which") == out, F.col("claimed"))).alias(f"__{out}")
                for out in texts
            ]
        )
    )
    joined = df.join(claimed, keys, "left")
    for out, src in texts.items():
        placed = _placed(F.col(src), F.col(f"__{out}"))
        joined = joined.withColumn(out, placed).drop(f"__{out}")
    return joined


def add_mentions(
    df: DataFrame, keys: list[str], texts: dict[str, str], lexicon: Lexicon
) -> DataFrame:
    """Add a mention array per entry of ``texts`` (output column -> text column).

    ``keys`` must identify a row; they are only used when the lexicon needs the join.
    """
    if lexicon.small:
        return df.withColumns(
            {out: mentions_in_row(F.col(src), lexicon) for out, src in texts.items()}
        )
    if lexicon.spellings is not None:
        found = {r["gram"]: tuple(r["found"]) for r in _needles(lexicon).collect()}
        return df.withColumns({out: _overlapping_in_row(F.col(src), found) for out, src in texts.items()})
    return _mentions_by_join(df, keys, texts, lexicon)


def entities(mentions: Column) -> Column:
    """Distinct canonical names, sorted."""
    return F.array_sort(F.array_distinct(F.transform(mentions, lambda m: m["canonical"])))


def contains_variant(text: Column, spelling: str) -> Column:
    """Whether one spelling occurs word-bounded; nothing is claimed."""
    return fold(text).rlike(f"{_BEFORE}{quoted(spelling.casefold())}{_AFTER}")


def contains_spelling(text: Column, spelling: Column) -> Column:
    """Same with the spelling in a column. A pattern that differs by row is compiled for each
    row, so only texts that hold the spelling, and not between blanks, get one."""

    def search(pair: Column) -> Column:
        folded, needle, blank = pair["folded"], pair["needle"], F.lit(" ")
        quoted = F.concat(F.lit(_BEFORE + r"\Q"), needle, F.lit(r"\E" + _AFTER))
        alone = F.contains(F.concat(blank, folded, blank), F.concat(blank, needle, blank))
        return (
            F.when(alone, F.lit(True))
            .when(F.contains(folded, needle), F.regexp(folded, quoted))
            .when(folded.isNotNull() & needle.isNotNull(), F.lit(False))
        )

    return let(F.struct(fold(text).alias("folded"), fold(spelling).alias("needle")), search)


HIT = "array<struct<canonical:string,v:string,n:bigint>>"


def _occurrences(low: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle`` in ``low``."""
    gone = F.length(low) - F.length(F.replace(low, needle))
    return (gone / F.length(needle)).cast("bigint")


def with_substring_hits(df: DataFrame, text: str, lexicon: Lexicon, out: str = "hits") -> DataFrame:
    """Adds array<struct<canonical, v, n>> in declared order: every spelling found anywhere,
    even inside a word, with its non-overlapping count (audit only).

    A lexicon that fits the row is a literal array. Any other is joined by character grams:
    the first letters of each spelling, as many as the shortest has, meet the distinct grams
    of each distinct text, and what meets is searched.
    """
    if lexicon.spellings is not None:
        return df.withColumn(out, _literal_hits(F.col(text), lexicon))
    spellings = lexicon.frame.select("canonical", "ord", F.lower("variant").alias("v"))
    size = spellings.agg(F.min(F.length("v"))).first()[0] or 1
    chars = F.split("low", "")
    grams = F.transform(
        F.sequence(F.lit(1), F.length("low") - size + 1),
        lambda i: F.array_join(F.slice(F.col("chars"), i, F.lit(size)), ""),
    )
    lows = df.select(F.lower(text).alias("low")).where("low IS NOT NULL").distinct()
    met = (
        lows.where(F.length("low") >= size)
        .withColumn("chars", chars)
        .select("low", F.explode(F.array_distinct(grams)).alias("gram"))
        .join(spellings.withColumn("gram", F.left("v", F.lit(size))), "gram")
        .where(F.contains("low", "v"))
        .groupBy("low")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("ord", "canonical", "v", _occurrences(F.col("low"), F.col("v")).alias("n")))
            ).alias("found")
        )
        .select(
            F.col("low").alias("__low"),
            F.transform("found", lambda s: F.struct(s["canonical"].alias("canonical"), s["v"].alias("v"), s["n"].alias("n"))).alias("__found"),
        )
    )
    none = F.when(F.col(text).isNotNull(), F.array().cast(HIT))
    return (
        df.join(met, F.lower(text) == F.col("__low"), "left")
        .withColumn(out, F.coalesce("__found", none))
        .drop("__low", "__found")
    )


def _literal_hits(text: Column, lexicon: Lexicon) -> Column:
    """One look at each place finds the longest spelling there; the others that occur are
    those that some found one begins with."""
    if not lexicon.spellings:
        return F.when(text.isNotNull(), F.array().cast(HIT))
    declared: dict[str, list[tuple[int, str]]] = {}
    for i, s in enumerate(lexicon.spellings):
        declared.setdefault(s.variant.lower(), []).append((i, s.canonical))
    begun = _known(
        {
            v: [
                f"named_struct('ord', {i}, 'canonical', {_sql(name)}, 'v', {_sql(v[:n])})"
                for n in range(1, len(v) + 1)
                for i, name in declared.get(v[:n], ())
            ]
            for v in declared
        }
    )
    pattern = F.lit(f"(?=({prefix_pattern(declared)}))")

    def counted(low: Column) -> Column:
        longest = F.array_distinct(F.regexp_extract_all(low, pattern, F.lit(1)))
        found = F.array_sort(F.array_distinct(F.flatten(F.transform(longest, lambda v: begun[v]))))
        return F.transform(
            found,
            lambda s: F.struct(
                s["canonical"].alias("canonical"), s["v"].alias("v"), _occurrences(low, s["v"]).alias("n")
            ),
        )

    return let(F.lower(text), counted)


def substring_entities(hits: Column) -> Column:
    """Distinct entities of the substring hits, sorted."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda s: s["canonical"])))


def substring_context(text: Column, entity: Column, hits: Column, width: int = 30) -> Column:
    """struct<variant, context> of the first spelling of ``entity`` among the hits."""
    first = F.get(F.filter(hits, lambda s: s["canonical"] == entity), F.lit(0))["v"]

    def cut(hit: Column) -> Column:
        def around(at: Column) -> Column:
            begin = F.greatest(at - 1 - width, F.lit(0))
            return F.struct(
                hit.alias("variant"),
                F.substring(text, begin + 1, at - 1 + F.length(hit) + width - begin).alias("context"),
            )

        return let(F.position(hit, F.lower(text)), around)

    return let(first, cut)


def canonicalise(text: Column, mentions: Column) -> Column:
    """Text with every mention replaced by its canonical form."""
    parts = F.transform(
        mentions,
        lambda m, i: F.concat(
            let(
                F.coalesce(F.get(mentions, i - 1)["end"], F.lit(0)),
                lambda last: F.substring(text, last + 1, m["start"] - last),
            ),
            m["canonical"],
        ),
    )
    last = F.coalesce(F.get(mentions, F.size(mentions) - 1)["end"], F.lit(0))
    return F.when(
        F.size(mentions) > 0,
        F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text))),
    ).otherwise(text)


def exact_corrections(text: Column, mentions: Column) -> Column:
    """Rewrite log of the exact pass; spans refer to the input text."""
    return F.transform(
        mentions,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.substring(text, m["start"] + 1, m["end"] - m["start"]).alias("original"),
            m["canonical"].alias("canonical"),
            F.lit("exact").alias("stage"),
        ),
    )

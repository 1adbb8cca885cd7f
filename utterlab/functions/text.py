"""Text column expressions. Everything here runs in the JVM except ``nfc`` and
``speakable``."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from utterlab.functions.markdown import spoken

# White space as the scorer sees it (a superset of the regex class \s).
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
# Letters, marks and numbers of any script, plus the joiners that glue words.
WORD = r"\p{L}\p{M}\p{N}_\x{200C}\x{200D}"


@arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()],
        pa.string(),
    )


def quoted(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|&~#-])", r"\\\1", text)


def prefix_pattern(needles: Iterable[str]) -> str:
    """The needles as one pattern that shares prefixes and tries longer ones first,
    so a position costs one walk down the tree however many needles there are."""
    tree: dict = {}
    for needle in needles:
        node = tree
        for char in needle:
            node = node.setdefault(char, {})
        node[""] = {}

    def write(node: dict) -> str:
        branches = [quoted(c) + write(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        body = f"(?:{'|'.join(branches)})" if len(branches) > 1 or "" in node else branches[0]
        return body + ("?" if "" in node else "")

    return write(tree)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(items: Column) -> Column:
    """``inline`` of an array that is worked out in the row, for the caller to drop null rows.
    From the inner form Spark infers a filter on the array's size, and works it out twice."""
    return F.inline_outer(items)


def nfc(text: Column) -> Column:
    """Unicode NFC. Code points below U+0300 are always composed already, so a
    text made only of those (all ASCII, all Latin-1) never reaches Python."""
    needs = text.rlike(r"[^\u0000-\u02ff]")
    return F.coalesce(_nfc(F.when(needs, text)), text)


def canonical_text(text: Column) -> Column:
    """NFC, lower case, letters/marks/numbers only, single spaces."""
    kept = F.regexp_replace(F.lower(nfc(text)), rf"[^\p{{L}}\p{{M}}\p{{N}}{SPACE}]+", "")
    return F.trim(F.regexp_replace(kept, rf"[{SPACE}]+", " "))


def words(canonical: Column) -> Column:
    """Tokens of a canonical text; an empty text has none."""
    return F.filter(F.split(canonical, " "), lambda w: w != "")


def _fold_rules() -> tuple[str, str, str]:
    """Where case folding differs from lower-casing: (expanding, from, to)."""
    expanding, source, target = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        folded = c.casefold()
        if len(folded) != 1:
            expanding.append(c)
        elif folded != c.lower():
            # lower() runs first, so the rule is keyed on its result
            source.append(c.lower())
            target.append(folded)
    return "".join(expanding), "".join(source), "".join(target)


_EXPANDING, _FOLD_FROM, _FOLD_TO = _fold_rules()


# No code point outside these ranges folds differently from its lower case, and the
# range test is far cheaper than the full list.
_MAY_FOLD = r"[\x{00B5}\x{017F}\x{0345}-\x{10FFFF}]"


def fold(text: Column) -> Column:
    """Case folding that never changes length: a text holding a character whose
    folding expands is lower-cased instead, so offsets stay valid. The dotted capital I is the
    one letter whose lower case expands, too; it becomes a plain i."""
    one = F.lit("\u0130")

    def folded(pair: Column) -> Column:
        plain, lowered = pair["text"], pair["lowered"]
        return F.when(
            (F.octet_length(lowered) > F.char_length(lowered))  # ASCII is settled by its length
            & lowered.rlike(_MAY_FOLD)
            & lowered.rlike(f"[{_FOLD_FROM}]")
            & ~plain.rlike(f"[{_EXPANDING}]"),
            F.translate(lowered, _FOLD_FROM, _FOLD_TO),
        ).otherwise(lowered)

    def lower(t: Column) -> Column:
        undotted = F.when(F.contains(t, one), F.replace(t, one, F.lit("i"))).otherwise(t)
        return let(F.struct(t.alias("text"), F.lower(undotted).alias("lowered")), folded)

    # the text is bound once: it may be a long expression, which would be repeated at each use
    return let(text, lower)


def fold_literal(spelling: str) -> str:
    return spelling.casefold()


def argument_form(value: Column) -> Column:
    """Comparison form of an argument: spaces collapsed, lower, ", " at commas."""
    collapsed = F.lower(F.trim(F.regexp_replace(value, rf"[{SPACE}]+", " ")))
    commas = rf"[{SPACE}]*,[{SPACE}]*"
    return let(
        collapsed,
        lambda c: F.when(F.contains(c, F.lit(",")), F.regexp_replace(c, commas, ", ")).otherwise(c),
    )


def script_by_block(text: Column) -> Column:
    """devanagari / tamil / latin by code-point block; devanagari wins a tie."""
    deva = F.regexp_count(text, F.lit(r"[\u0900-\u097f]"))
    tamil = F.regexp_count(text, F.lit(r"[\u0b80-\u0bff]"))
    return (
        F.when((deva > 0) & (deva >= tamil), "devanagari")
        .when(tamil > 0, "tamil")
        .otherwise("latin")
    )


SCRIPTS = (
    "latin", "devanagari", "tamil", "bengali", "telugu", "kannada", "malayalam", "gujarati",
    "gurmukhi", "oriya", "arabic", "cyrillic", "greek", "hebrew", "thai", "hangul",
)
_SCRIPT_CLASS = {s: rf"[\p{{L}}&&\p{{Is{s.capitalize()}}}]" for s in SCRIPTS} | {
    "hiragana": r"\p{IsHiragana}",
    "katakana": r"\p{IsKatakana}",
    "cjk": r"\p{IsHan}",
}


def dominant_script(text: Column) -> Column:
    """Script of most letters; the first to appear wins a tie; "none" without
    letters. Letters of a script outside the list count as "other"."""

    def counted(rare: Column) -> Column:
        ascii_letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
        return F.array(
            *[
                F.struct(
                    (F.regexp_count(rare, F.lit(cls)) + (ascii_letters if name == "latin" else 0)).alias("n"),
                    F.lit(name).alias("name"),
                )
                for name, cls in _SCRIPT_CLASS.items()
            ]
        )

    def first(name: Column) -> Column:
        """Where a script begins: looked up only for scripts that tie."""
        place = F.lit(None).cast("int")
        for script, cls in _SCRIPT_CLASS.items():
            before = F.length(F.regexp_extract(text, rf"(?s)^(.*?){cls}", 1))
            place = F.when(name == script, before).otherwise(place)
        return place

    def leading(counts: Column) -> Column:
        most = F.filter(counts, lambda s: (s["n"] > 0) & (s["n"] == F.array_max(counts)["n"]))
        return let(
            most,
            lambda top: F.when(F.size(top) == 1, F.get(top, F.lit(0))["name"]).when(
                F.size(top) > 1,
                F.array_min(
                    F.transform(top, lambda s: F.struct(first(s["name"]).alias("first"), s["name"].alias("name")))
                )["name"],
            ),
        )

    # ASCII letters are Latin; only the other characters are told apart by script
    best = let(let(F.regexp_replace(text, r"[\x00-\x7F]+", ""), counted), leading)
    return F.coalesce(best, F.when(text.rlike(r"\p{L}"), F.lit("other")).otherwise("none"))


@arrow_udf(T.StringType())
def _spoken(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else spoken(t) for t in texts.to_pylist()], pa.string())


# A text without any of these holds no mark, no second line and no run of blanks.
_MAY_BE_MARKED = r"[\[`*_#\n\t]|  |^ ?[-+\p{Nd}]"


def speakable(text: Column) -> Column:
    """Markdown reduced to what a voice can say: labels of links, no marks of lines, emphasis
    or code, no repeated blanks or empty lines. Texts that may hold a mark are scanned in
    Python, the others are trimmed in the JVM."""
    trimmed = F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    return F.coalesce(_spoken(F.when(text.rlike(_MAY_BE_MARKED), text)), trimmed)


def sentences(text: Column) -> Column:
    """Complete sentences in order, then what is left if it is not blank."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?।]*[.!?।]|[^.!?।]+\z"), F.lit(0))
    trimmed = F.transform(
        found, lambda s: F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    )
    return F.filter(trimmed, lambda s: s != "")


def parse_verdict(answer: Column) -> Column:
    """First flat JSON object whose ``equivalent`` is a boolean, else null."""
    chunks = F.regexp_extract_all(answer, F.lit(r"\{[^{}]*\}"), F.lit(0))
    flags = F.transform(
        chunks,
        lambda c: F.struct(F.try_variant_get(F.try_parse_json(c), "$.equivalent", "variant").alias("v")),
    )
    booleans = F.filter(flags, lambda s: F.schema_of_variant(s["v"]) == "BOOLEAN")
    return F.when(
        F.size(booleans) > 0, F.try_variant_get(F.get(booleans, F.lit(0))["v"], "$", "boolean")
    )


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]+", "") == ""


def blank_outcome(text: Column) -> Column:
    """(outcome, error_class) before any call: a blank text fails, any other is to be judged."""
    blank = F.coalesce(is_blank(text), F.lit(True))
    return F.struct(
        F.when(blank, "fail").otherwise("judge").alias("outcome"),
        F.when(blank, "empty_text").otherwise("").alias("error_class"),
    )


def has_devanagari(text: Column) -> Column:
    return text.rlike(r"[\u0900-\u097f]")


def row_id(*parts: Column, sep: str = "#") -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def channel_label(narrowband_hz: Column, mulaw: Column, loss: Column, jitter_ms: Column) -> Column:
    """Short name of a channel condition; a zero impairment is left out.

    Percentages and milliseconds are shown whole, rounded half to even.
    """
    return F.concat_ws(
        "-",
        F.concat(F.floor(narrowband_hz / 1000).cast("string"), F.lit("k")),
        F.when(mulaw, "ulaw"),
        F.when(
            loss != 0, F.concat(F.lit("loss"), F.bround(loss * 100, 0).cast("int").cast("string"), F.lit("%"))
        ),
        F.when(
            jitter_ms != 0,
            F.concat(F.lit("jit"), F.bround(jitter_ms, 0).cast("int").cast("string"), F.lit("ms")),
        ),
    )


def model_label(stt: Column, labels: dict[str, Column], otherwise: Column) -> Column:
    """Label of a speech-to-text arm from a table of labels by arm."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, label in labels.items():
        out = out.when(stt == name, label)
    return out.otherwise(otherwise)


def run_label(script: Column, dataset: Column, at: Column) -> Column:
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat_ws("-", script, dataset, stamp)


def attempt_outcome(
    status: Column, message: Column, connection_error: Column, judged_ok: Column
) -> Column:
    """Outcome class of one model attempt: (outcome, error_class).

    A null status without a connection error and without a message is a
    completed answer; a message without a status is an error in mid-stream.
    A status that must never be scored gives outcome "fatal".
    """
    def row(outcome: Column | str, error: Column | str) -> Column:
        o = F.lit(outcome) if isinstance(outcome, str) else outcome
        e = F.lit(error) if isinstance(error, str) else error
        return F.struct(o.alias("outcome"), e.alias("error_class"))

    http = F.concat(F.lit("http_"), status.cast("string"))
    return (
        F.when(connection_error, row("incomplete", "connection"))
        .when(status == 400, row("fail", "http_400"))
        .when(status.isin(408, 429) | (status >= 500), row("incomplete", http))
        .when(status.isNotNull(), row("fatal", http))
        .when(
            F.lower(message).contains("tool call validation failed"),
            row("fail", "tool_validation_failed"),
        )
        .when(message.isNotNull(), row("incomplete", "api_error"))
        .otherwise(row(F.when(judged_ok, "pass").otherwise("fail"), ""))
    )


def judge_messages(
    rubric: str,
    query: Column,
    function: Column,
    parameter: Column,
    accepted: Column,
    returned: Column,
) -> Column:
    """Prompt of the meaning judge as an array of (role, content): the caller's
    rubric, then the five labelled fields."""
    # fixed values: the labels of the fields
    user = F.concat(
        F.lit("User request: "), query,
        F.lit("\nFunction: "), function,
        F.lit("\nParameter: "), parameter,
        F.lit("\nACCEPTED value(s): "), accepted,
        F.lit("\nRETURNED value: "), returned,
    )
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(rubric).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


# Schema type names to repair: written form -> JSON Schema form.
SCHEMA_TYPE_FIXES = {"dict": "object", "float": "number"}


def repair_schema(schema_json: Column) -> Column:
    """Every ``"type"`` written in Python style renamed, at any depth.

    The text is re-serialised first, so spacing cannot hide a match, and a
    quoted value can never contain the bare pattern. Text that is not JSON gives null.
    """
    text = F.to_json(F.try_parse_json(schema_json))
    for written, wanted in SCHEMA_TYPE_FIXES.items():
        text = F.regexp_replace(text, f'(?<!\\\\)"type":"{written}"', f'"type":"{wanted}"')
    return text


def as_tools(functions_json: Column) -> Column:
    """The repaired functions, each wrapped as {"type": "function", "function": ..}."""
    fns = F.from_json(repair_schema(functions_json), "array<variant>")
    return F.transform(
        fns, lambda f: F.concat(F.lit('{"type":"function","function":'), F.to_json(f), F.lit("}"))
    )

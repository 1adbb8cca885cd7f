"""Number words and numerals reduced to digit strings, as column expressions.

The text is cut at runs of number words; the few runs found are read and put
back, so the work is linear in the text and nothing leaves the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterlab.functions.text import canonical_text, let, nfc, prefix_pattern

# The words that count as numbers.
DIGIT_WORDS = {
    0: "शून्य ज़ीरो जीरो जिरो ज़ेरो जेरो zero",
    1: "एक वन one",
    2: "दो टू two",
    3: "तीन थ्री three",
    4: "चार फोर फ़ोर four",
    5: "पाँच पांच फाइव फाइफ फाईव फ़ाइव five",
    6: "छह छः छै छे सिक्स six",
    7: "सात सेवन सेवेन सेवान seven",
    8: "आठ एट ऐट एइट eight",
    9: "नौ नो नाइन नाईन nine",
}
TENS_WORDS = {
    10: "दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस",
    20: "बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस",
    30: "तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस",
    40: "चालीस इकतालीस बयालीस तैंतालीस चौवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास",
    50: "पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ",
    60: "साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर",
    70: "सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उनासी",
    80: "अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी",
    90: "नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे",
}
OTHER_TENS = {"पन्द्रह": 15, "अठाईस": 28}
MULTIPLIERS = {"सौ": 100, "हज़ार": 1000, "हजार": 1000, "लाख": 100_000, "करोड़": 10_000_000}
REPEATS = {"डबल": 2, "double": 2, "ट्रिपल": 3, "triple": 3}


def _composed(word: str) -> str:
    return unicodedata.normalize("NFC", word)


_DIGITS = {_composed(w): d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
_TENS = {
    _composed(w): base + i for base, ws in TENS_WORDS.items() for i, w in enumerate(ws.split())
} | {_composed(w): v for w, v in OTHER_TENS.items()}
_MULTIPLIERS = {_composed(w): v for w, v in MULTIPLIERS.items()}
_REPEATS = {_composed(w): v for w, v in REPEATS.items()}


def _any(words: dict[str, int]) -> str:
    """The words as one pattern that shares prefixes, so a place costs one walk."""
    return f"(?:{prefix_pattern(words)})"


def _repeat(times: int) -> str:
    """A repeat word, with the digit word that follows it captured but not consumed."""
    words = {w: t for w, t in _REPEATS.items() if t == times}
    return f"(?<!\\S){_any(words)} (?=({_any(_DIGITS)})(?!\\S))"


_FIRST = "".join(sorted({w[0] for w in _DIGITS | _TENS | _MULTIPLIERS}))
_ONE = f"(?=[{_FIRST}]){_any(_DIGITS | _TENS | _MULTIPLIERS)}(?!\\S)"
_WORD = f"(?<!\\S){_ONE}"
_RUN = f"{_WORD}(?: {_WORD})*"
_GROUP = r"(?<!\S)[0-9]+(?: [0-9]+)+(?!\S)"
_NUMERAL = "[\\u0966-\\u096f]"
# a test steps over white space, which costs far less than to look back from every place
_SPELLED = f"(?:^|\\s){_ONE}"
_WIDE = "decimal(38,0)"


def _values(words: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for w, v in words.items() for x in (w, v)])


def _concat_digits(tokens: Column) -> Column:
    digits = _values(_DIGITS)
    return F.array_join(F.transform(tokens, lambda t: digits[t].cast("string")), "")


def _positional(tokens: Column) -> Column:
    """Read a run by place value: hundreds scale what is pending, larger units
    bank it. Null when the value needs more than 38 digits."""
    digits, tens, units = _values(_DIGITS), _values(_TENS), _values(_MULTIPLIERS)

    def wide(c: Column) -> Column:
        return c.cast(_WIDE)

    def step(state: Column, token: Column) -> Column:
        unit = F.try_element_at(units, token)
        pending = F.when(state["now"] == 0, wide(F.lit(1))).otherwise(state["now"])
        scaled = wide(F.try_multiply(pending, F.coalesce(unit, F.lit(1)).cast("decimal(10,0)")))
        plain = F.coalesce(F.try_element_at(digits, token), F.try_element_at(tens, token), F.lit(0))
        return F.struct(
            F.when(unit > 100, wide(F.try_add(state["sum"], scaled)))
            .otherwise(state["sum"])
            .alias("sum"),
            F.when(unit > 100, wide(F.lit(0)))
            .when(unit == 100, scaled)
            .otherwise(wide(F.try_add(state["now"], wide(plain))))
            .alias("now"),
        )

    start = F.struct(wide(F.lit(0)).alias("sum"), wide(F.lit(0)).alias("now"))
    end = F.aggregate(tokens, start, step)
    return F.try_add(end["sum"], end["now"]).cast("string")


def _read_run(run: Column) -> Column:
    tokens = F.split(run, " ")
    spelled = (F.size(tokens) >= 2) & ~F.exists(tokens, lambda t: ~t.isin(*_DIGITS))
    return F.when(spelled, _concat_digits(tokens)).otherwise(F.coalesce(_positional(tokens), run))


def _rewrite(text: Column, pattern: str, read) -> Column:
    """Replace every match of ``pattern`` by ``read(match)``."""
    return let(
        text,
        lambda t: F.array_join(
            F.zip_with(
                F.split(t, pattern),
                F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), read),
                lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))),
            ),
            "",
        ),
    )


def digit_text(canonical: Column) -> Column:
    """Canonical text with number words and numerals as digit strings.

    Devanagari numerals become ASCII; "double"/"triple" repeat the digit word
    after them; a run of two or more digit words is read digit by digit, any
    other run by place value; neighbouring digit tokens merge when none is
    longer than four digits.
    """

    def spelled(canonical: Column) -> Column:
        text = F.translate(canonical, "०१२३४५६७८९", "0123456789")
        # one pass, so a repeat word can only see the token that was written after it
        text = F.regexp_replace(text, f"{_repeat(2)}|{_repeat(3)}", "$1 $2 $2 ")
        return _rewrite(_single_blanks(text), _RUN, _read_run)

    def merged(text: Column) -> Column:
        groups = _rewrite(
            text,
            _GROUP,
            lambda g: F.when(g.rlike("[0-9]{5}"), g).otherwise(F.replace(g, F.lit(" "))),
        )
        return F.when(text.rlike("[0-9] [0-9]"), groups).otherwise(text)

    def rewrite(canonical: Column) -> Column:
        # most texts have no number word, and most of those no digit
        plain = F.when(canonical.rlike("[0-9]"), _single_blanks(canonical)).otherwise(canonical)
        return let(F.when(canonical.rlike(_SPELLED) | canonical.rlike(_NUMERAL), spelled(canonical)).otherwise(plain), merged)

    return let(canonical, rewrite)


def _single_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def to_digit_text(text: Column) -> Column:
    """Same from a raw text."""
    return digit_text(nfc(canonical_text(text)))


def digit_strings(digit_form: Column, min_digits: int = 4) -> Column:
    """Maximal digit runs of at least ``min_digits`` in a ``digit_text``."""
    return F.regexp_extract_all(digit_form, F.lit(f"[0-9]{{{min_digits},}}"), F.lit(0))

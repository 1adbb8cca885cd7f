"""Entity lexicons: a table of (canonical, script, variant, ord), one row per spelling."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.functions.text import WORD, fold_literal
from utterlab.session import BROADCAST_LIMIT_ROWS

# The default civic lexicon, canonical -> script -> spellings.
CIVIC_ENTITIES: dict[str, dict[str, list[str]]] = {
    "Aadhaar": {
        "devanagari": ["आधार कार्ड", "आधार नंबर", "आधार नम्बर"],
        "latin": ["aadhaar", "aadhar", "adhaar", "aadhar card", "aadhaar card"],
    },
    "PAN card": {
        "devanagari": ["पैन कार्ड", "पैन नंबर", "पैन नम्बर"],
        "latin": ["pan card", "pan number"],
    },
    "EPFO": {"devanagari": ["ईपीएफओ"], "latin": ["epfo"]},
    "Ayushman Bharat": {
        "devanagari": ["आयुष्मान भारत"],
        "latin": ["ayushman bharat", "ayushman"],
    },
    "Pradhan Mantri Awas Yojana": {
        "devanagari": ["प्रधानमंत्री आवास योजना"],
        "latin": ["pradhan mantri awas yojana", "pmay"],
    },
    "UPI": {"devanagari": ["यूपीआई"], "latin": ["upi"]},
    "IFSC code": {"devanagari": ["आईएफएससी", "आईएफएससी कोड"], "latin": ["ifsc", "ifsc code"]},
    "Ration card": {"devanagari": ["राशन कार्ड"], "latin": ["ration card"]},
    "Voter ID": {"devanagari": ["वोटर आईडी", "मतदाता पहचान पत्र"], "latin": ["voter id", "epic"]},
    "GST": {"devanagari": ["जीएसटी"], "latin": ["gst"]},
    "Kisan Credit Card": {
        "devanagari": ["किसान क्रेडिट कार्ड"],
        "latin": ["kisan credit card", "kcc"],
    },
    "Jan Dhan Yojana": {"devanagari": ["जन धन योजना"], "latin": ["jan dhan yojana"]},
    "Mudra Yojana": {"devanagari": ["मुद्रा योजना"], "latin": ["mudra yojana"]},
    "Sukanya Samriddhi Yojana": {
        "devanagari": ["सुकन्या समृद्धि योजना"],
        "latin": ["sukanya samriddhi yojana"],
    },
    "Ujjwala Yojana": {"devanagari": ["उज्ज्वला योजना"], "latin": ["ujjwala yojana"]},
    "ESIC": {"devanagari": ["ईएसआईसी"], "latin": ["esic"]},
    "Passport Seva": {"devanagari": ["पासपोर्ट सेवा"], "latin": ["passport seva"]},
    "DigiLocker": {"devanagari": ["डिजिलॉकर"], "latin": ["digilocker", "digi locker"]},
    "CoWIN": {"devanagari": ["कोविन"], "latin": ["cowin", "co-win"]},
    "Provident Fund": {
        "devanagari": ["पीएफ", "प्रोविडेंट फंड"],
        "latin": ["pf", "provident fund"],
    },
}


def spelling_rows(entries: DataFrame) -> DataFrame:
    """(canonical, variants MAP<script, ARRAY<spelling>>, entry_ord) -> one row per
    spelling, ``ord`` following the declared order."""
    return (
        entries.select("entry_ord", "canonical", F.posexplode(F.map_entries("variants")))
        .withColumnsRenamed({"pos": "script_ord"})
        .select(
            "entry_ord",
            "canonical",
            "script_ord",
            F.col("col.key").alias("script"),
            F.posexplode("col.value").alias("variant_ord", "variant"),
        )
        .select(
            "canonical",
            "script",
            "variant",
            F.struct("entry_ord", "script_ord", "variant_ord").alias("ord"),
        )
    )


def find(spellings: DataFrame, names: DataFrame) -> DataFrame:
    """The spellings of the ``canonical`` names asked for."""
    return spellings.join(names.select("canonical").distinct(), "canonical", "left_semi")


def civic_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(i, c, v) for i, (c, v) in enumerate(CIVIC_ENTITIES.items())]
    entries = spark.createDataFrame(
        rows, "entry_ord int, canonical string, variants map<string,array<string>>"
    )
    return spelling_rows(entries)


@dataclass(frozen=True)
class Spelling:
    canonical: str
    script: str
    variant: str

    @property
    def needle(self) -> str:
        return fold_literal(self.variant)

    @property
    def lowered(self) -> str:
        """The form in a text that keeps a letter whose folding expands (a sharp s)."""
        return self.variant.replace("\u0130", "i").lower()


@dataclass(frozen=True)
class Lexicon:
    """A lexicon table, plus its rows on the driver while they are few enough."""

    frame: DataFrame
    spellings: tuple[Spelling, ...] | None
    widest: int
    longest_words: int
    small: bool = field(default=False)

    @staticmethod
    def of(frame: DataFrame, in_row_limit: int = 2000) -> Lexicon:
        runs = F.regexp_extract_all("variant", F.lit(f"[{WORD}]+"), F.lit(0))
        stats = frame.agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.size(runs)).alias("widest"),
            F.max(F.size(F.split(F.trim("variant"), r"\s+"))).alias("words"),
            F.count_if(~F.col("variant").rlike(f"^[{WORD}]([^\\n]*[{WORD}])?\\z")).alias("open"),
        ).first()
        if stats["open"]:
            raise ValueError("every spelling must start and end with a word character")
        if stats["n"] > BROADCAST_LIMIT_ROWS:
            raise ValueError(f"{stats['n']} spellings are too many to broadcast")
        rows = None
        if stats["n"] <= in_row_limit:
            rows = tuple(
                Spelling(r["canonical"], r["script"], r["variant"])
                for r in frame.orderBy("ord").collect()
            )
        small = rows is not None and not overlapping(rows)
        return Lexicon(frame, rows, stats["widest"] or 1, stats["words"] or 1, small)


def is_word_char(char: str) -> bool:
    return char in "_\u200c\u200d" or unicodedata.category(char)[0] in "LMN"


def overlapping(rows: tuple[Spelling, ...]) -> bool:
    """Whether a longer spelling can start inside an earlier, shorter one.

    Only then can scanning left to right differ from claiming longest first.
    """
    needles = {r.needle for r in rows} | {r.lowered for r in rows}
    longest: dict[str, int] = {}  # every proper prefix -> its longest needle
    for b in needles:
        for cut in range(1, len(b)):
            longest[b[:cut]] = max(longest.get(b[:cut], 0), len(b))
    return any(
        longest.get(a[cut:], 0) > len(a)
        for a in needles
        for cut in range(1, len(a))
        if not is_word_char(a[cut - 1])
    )

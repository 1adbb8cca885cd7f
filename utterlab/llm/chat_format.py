"""Chat formatting by prefix-target expansion, in built-in functions only.

Every assistant turn becomes one example: all turns before it are context, its own
text is the only trainable part. Examples of one conversation share their prefix, so
the output of the method grows with the square of the turns of a conversation (not of
the table). A conversation is one row at a time, as its digest needs it in one piece.

Template, per turn: ``### role`` newline, text, ``</turn>`` newline. Within texts and
roles a backslash is written ``\\b``, ``#`` ``\\h``, ``<`` ``\\l`` (and a newline in a
role ``\\e``), so no text can hold a control string and the way back is unique.

Defined cases: null text or role counts as empty; turns of equal number are ordered by
role, then text; repeated rows stay; null ``turn`` sorts first; rows with a null
conversation id form one conversation; a conversation whose last turn is no target also
yields one example without a trainable part, so that no turn is lost; an empty table
yields an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.llm.registry import query

HEAD, END = "### ", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    for plain, coded in _ESCAPES:
        c = _swap(c, plain, coded)
    return c


def unescape(c: Column) -> Column:
    """Every backslash of an escaped text starts a code, so the backslash code comes last."""
    for plain, coded in reversed(_ESCAPES):
        c = _swap(c, coded, plain)
    return c


def _role_out(c: Column) -> Column:
    return _swap(escape(c), "\n", "\\e")


def _role_in(c: Column) -> Column:
    return unescape(_swap(c, "\\e", "\n"))


def prefix_examples(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """One row per target turn.

    Columns: the conversation id, ``example`` (0-based place of its last turn), ``text``
    (the formatted example), ``loss_start`` and ``loss_length`` (code points of ``text``
    that are trained on) and ``trainable``.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = lambda t: F.concat(F.lit(HEAD), _role_out(t["role"]), F.lit("\n"))
    parts = F.transform(
        F.array_sort(F.collect_list(one)),
        lambda t: F.struct(
            head(t).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == target).alias("target"),
        ),
    )
    grouped = turns.groupBy(F.col(conversation).alias(conversation)).agg(parts.alias("parts"))
    places = F.filter(
        F.sequence(F.lit(0), F.size("parts") - 1),
        lambda i: F.get("parts", i)["target"] | (i == F.size("parts") - 1),
    )
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(END))
    last = F.get("parts", F.col("example"))
    return (
        grouped.select(conversation, "parts", F.explode(places).alias("example"))
        .select(
            conversation,
            "example",
            F.array_join(
                F.transform(F.slice("parts", F.lit(1), F.col("example")), whole), ""
            ).alias("context"),
            last.alias("last"),
        )
        .select(
            conversation,
            "example",
            F.concat("context", whole(F.col("last"))).alias("text"),
            (F.length("context") + F.length("last.head")).alias("loss_start"),
            F.when(F.col("last.target"), F.length("last.body")).otherwise(0).alias("loss_length"),
            F.col("last.target").alias("trainable"),
        )
    )


def read_back(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Conversations rebuilt from formatted examples: ``turns`` (role, text) and the
    ``learned`` text of each trainable example, in order."""
    loss = unescape(F.expr("substring(text, loss_start + 1, loss_length)"))
    packed = examples.groupBy(conversation).agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(
            F.collect_list(F.when(F.col("trainable"), F.struct("example", loss.alias("text"))))
        ).alias("learned"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    pieces = F.split("whole", END)
    body = lambda p: F.substring(p, len(HEAD) + 1, 2**31 - 1)
    turn = lambda b: F.struct(
        _role_in(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(
            F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))
        ).alias("text"),
    )
    return packed.select(
        conversation,
        F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: turn(body(p))).alias(
            "turns"
        ),
        F.transform("learned", lambda x: x["text"]).alias("learned"),
        "formatted_chars",
    )


CONTROL_TEXT = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, txt) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n,
         4 + length(role) + 1 + length(txt)
           + length(regexp_replace(txt, '[^\\#<]', '', 'g'))
           + length(regexp_replace(role, '[^\\#<' || chr(10) || ']', '', 'g')) + 8 AS seg
  FROM t
), c AS (
  SELECT *, sum(seg) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(txt)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(txt, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op6_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back from the formatted examples of every conversation?"""
    columns = ["conv_id", "turn", "role", "text"]
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*columns)
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    back = read_back(prefix_examples(table.unionByName(control)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )

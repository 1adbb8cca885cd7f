"""Utterances from speech-score windows, and event-sequence helpers (batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlab.operators.scan import running_before

WINDOW_SAMPLES = 512
SAMPLE_RATE = 16_000
SLICE = 100_000


def silent_windows(min_silence_ms: float, sample_rate: int = SAMPLE_RATE) -> int:
    """Silent windows that end an utterance (rounded half to even, at least one)."""
    return max(round(min_silence_ms / (WINDOW_SAMPLES / sample_rate * 1000)), 1)


def utterances(
    windows: DataFrame, threshold: float = 0.5, min_silence_ms: float = 500.0
) -> DataFrame:
    """(stream_id, seq, prob), seq without gaps -> one row per utterance.

    start_seq is its first speech window; end_seq the window whose silence ended it,
    null while the stream stops before that. A dip shorter than the limit does not
    end it: two speech windows belong together while at most that far apart.
    """
    n = silent_windows(min_silence_ms)
    last = windows.groupBy("stream_id").agg(F.max("seq").alias("last_seq"))
    speech = windows.where(F.col("prob") >= threshold).select("stream_id", "seq")
    bucket = F.floor(F.col("seq") / SLICE)
    before = running_before(speech, ["stream_id"], bucket, ["seq"], F.col("seq"), "max", "prev")
    fresh = (F.col("prev").isNull() | (F.col("seq") - F.col("prev") > n)).cast("int")
    numbered = running_before(
        before.withColumn("fresh", fresh), ["stream_id"], bucket, ["seq"], F.col("fresh"), "sum", "k"
    )
    return (
        numbered.groupBy("stream_id", (F.coalesce("k", F.lit(0)) + F.col("fresh")).alias("utt"))
        .agg(F.min("seq").alias("start_seq"), F.max("seq").alias("last_speech_seq"))
        .join(last, "stream_id")
        .withColumn(
            "end_seq",
            F.when(
                F.col("last_speech_seq") + n <= F.col("last_seq"), F.col("last_speech_seq") + n
            ),
        )
        .drop("last_seq")
    )


def speech_end_seconds(windows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """End of the last speech window of each stream; 0 without speech."""
    last = F.max(F.when(F.col("prob") >= threshold, F.col("seq")))
    return windows.groupBy("stream_id").agg(
        ((F.coalesce(last, F.lit(-1)) + 1) * WINDOW_SAMPLES / SAMPLE_RATE).alias("speech_end_s")
    )


def collapse_repeats(
    events: DataFrame, keys: list[str], order: str, name: str, bucket: Column
) -> DataFrame:
    """Events that differ from the one before them in their group.

    ``bucket`` cuts the order into slices; the last event of earlier slices is
    carried in, so a long sequence is not one task.
    """
    tagged = events.withColumn("__b", bucket)
    tails = tagged.groupBy(*keys, "__b").agg(F.max_by(name, order).alias("__tail"))
    earlier = Window.partitionBy(*keys).orderBy("__b")
    carried = tails.withColumn("__before", F.lag("__tail").over(earlier)).drop("__tail")
    inside = Window.partitionBy(*keys, "__b").orderBy(order)
    return (
        tagged.withColumn("__prev", F.lag(name).over(inside))
        .join(carried, [*keys, "__b"])
        .withColumn("__prev", F.coalesce("__prev", "__before"))
        .where(~F.col(name).eqNullSafe(F.col("__prev")))
        .drop("__b", "__prev", "__before")
    )


def assemble_text(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each turn from its (seq, text) deltas, in order.

    Two levels: slices of the order are joined first, so a very long turn arrives
    as few pieces.
    """

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(parts), lambda p: p["t"]), "")

    sliced = deltas.groupBy(*keys, F.floor(F.col("seq") / 4096).alias("__s")).agg(
        joined(F.collect_list(F.struct("seq", F.col("text").alias("t")))).alias("t")
    )
    return sliced.groupBy(*keys).agg(
        joined(F.collect_list(F.struct("__s", "t"))).alias("text")
    )


def assemble_tool_calls(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Tool calls from fragments (keys, index, seq, id, name, arguments).

    Last non-empty id and name, arguments concatenated in order; arguments that are
    not a JSON object become empty; a missing id is call_<index>.
    """
    call = [*keys, "index"]

    def last(column: str) -> Column:
        filled = F.when(F.col(column) != "", F.col(column))
        return F.max_by(filled, F.when(filled.isNotNull(), F.col("seq"))).alias(column)

    heads = fragments.groupBy(*call).agg(last("id"), last("name"))
    text = assemble_text(
        fragments.select(*call, "seq", F.coalesce("arguments", F.lit("")).alias("text")), call
    )
    tree = F.try_parse_json("text")
    ok = tree.isNotNull() & F.schema_of_variant(tree).startswith("OBJECT")
    return heads.join(text, call).select(
        *call,
        F.coalesce("id", F.concat(F.lit("call_"), F.col("index").cast("string"))).alias("id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.when(ok, F.col("text")).otherwise("{}").alias("arguments"),
    )


def final_tool_call(calls: DataFrame, keys: list[str]) -> DataFrame:
    """The call a scorer keeps: the last one of the turn."""
    return calls.groupBy(*keys).agg(
        F.max_by(F.struct("id", "name", "arguments"), "index").alias("c")
    ).select(*keys, "c.*")

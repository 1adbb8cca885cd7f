"""Call-stream messages: one wide typed row per text frame, or a reject reason.

The same expressions serve a batch table and a text stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = (
    "event string, streamSid string, protocol string, version string, "
    "start struct<streamSid:string,accountSid:string,callSid:string,tracks:array<string>,"
    "mediaFormat:struct<encoding:string,sampleRate:int,channels:int>,"
    "customParameters:map<string,string>>, "
    "media struct<payload:string,track:string,chunk:string,timestamp:string>, "
    "stop struct<accountSid:string,callSid:string>, "
    "mark struct<name:string>, dtmf struct<track:string,digit:string>"
)
# What each event must carry.
REQUIRED = {
    "connected": ("protocol", "version"),
    "start": (
        "start.streamSid", "start.accountSid", "start.callSid", "start.tracks",
        "start.mediaFormat.encoding", "start.mediaFormat.sampleRate", "start.mediaFormat.channels",
    ),
    "media": ("streamSid", "media.payload"),
    "stop": ("streamSid", "stop.accountSid", "stop.callSid"),
    "mark": ("streamSid", "mark.name"),
    "dtmf": ("streamSid", "dtmf.track", "dtmf.digit"),
    "clear": ("streamSid",),
}


def _missing(raw: Column, event: str) -> Column:
    """Whether a required field is absent (a null value counts as present)."""
    absent = F.lit(False)
    for path in REQUIRED[event]:
        absent = absent | F.try_variant_get(raw, f"$.{path}", "variant").isNull()
    return absent


def parse_messages(frames: DataFrame, column: str = "raw") -> DataFrame:
    """Add the typed fields under ``m`` and ``reject``: bad_json, unknown_event,
    missing_field, or null for a good message."""
    tree = F.try_parse_json(F.col(column))
    parsed = frames.withColumn("__v", tree).withColumn("m", F.from_json(column, MESSAGE))
    event = F.try_variant_get(F.col("__v"), "$.event", "string")
    reject = F.when(F.col("__v").isNull(), "bad_json").when(
        event.isNull() | ~event.isin(*REQUIRED), "unknown_event"
    )
    for name in REQUIRED:
        reject = reject.when((event == name) & _missing(F.col("__v"), name), "missing_field")
    return parsed.withColumn("reject", reject).drop("__v")


def frame_loss(messages: DataFrame) -> DataFrame:
    """Per stream: media frames expected from the chunk numbers, the share lost, and how
    many media frames carry no number, which say nothing about loss."""
    media = messages.where(
        F.col("reject").isNull() & (F.col("m.event") == "media")
    ).select(
        F.col("m.streamSid").alias("stream_sid"),
        F.col("m.media.chunk").try_cast("bigint").alias("c"),
    )
    # one row per (stream, chunk) first, so a long call is counted in parallel
    once = media.groupBy("stream_sid", "c").agg(F.count(F.lit(1)).alias("frames"))
    numbered = F.col("c").isNotNull()
    return (
        once.groupBy("stream_sid")
        .agg(
            (F.max("c") - F.min("c") + 1).alias("frames_in"),
            F.count_if(numbered).alias("seen"),
            F.coalesce(F.sum(F.when(~numbered, F.col("frames"))), F.lit(0)).alias(
                "frames_unnumbered"
            ),
        )
        .withColumn("frames_lost", F.col("frames_in") - F.col("seen"))
        .withColumn("loss_rate", F.try_divide("frames_lost", "frames_in"))
        .drop("seen")
    )

"""What raw messages hold: envelope checks, entries by channel and kind, normalised events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.normalise import CHANNELS, KINDS


def entries(messages: DataFrame) -> DataFrame:
    """messages with channel, kind, pos and entry (VARIANT) for each element of each list; invalid JSON has none."""
    body = F.try_parse_json("raw_text")
    parsed = messages.withColumn("__v", body).where("__v is not null")
    lists = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(k).alias("kind"), F.try_variant_get("__v", f"$['{c}'].{k}", "array<variant>").alias("list")) for c in CHANNELS for k in KINDS])
    each = parsed.select(*messages.columns, F.explode(lists).alias("__l")).where("__l.list is not null")
    return each.select(*messages.columns, F.col("__l.channel").alias("channel"), F.col("__l.kind").alias("kind"), F.posexplode("__l.list").alias("pos", "entry"))


def sequence_steps(messages: DataFrame, channel: str, order: tuple[str, ...] = ("kafka_partition", "kafka_offset")) -> DataFrame:
    """session_id, sequence, step from the sequence before it in the connection; null for the first."""
    value = F.try_variant_get(F.try_parse_json("raw_text"), f"$['{channel}'].sequence", "bigint")
    rows = messages.select("session_id", *order, value.alias("sequence")).where("sequence is not null")
    return rows.withColumn("step", F.col("sequence") - F.lag("sequence").over(Window.partitionBy("session_id").orderBy(*order)))

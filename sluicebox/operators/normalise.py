"""Raw messages to normalised lifecycle events, without guessing at shapes the provider doesn't document.

A message passes envelope checks (the first group that fails ends it), then its payload is parsed once, into VARIANT,
and every list of every channel is unfolded by generators: no Python, and no schema that one odd entry would void.

Strict JSON: NaN and cut-off text are invalid, and so is an object that repeats a key (stricter than parsers that keep
the last one). Numbers count as integers only if written as such. Entries that can't be read become events with a null
txid and an issue; their payload stays with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import iso_instant
from ..functions.once import once

#: Channels and kinds in the provider's order. Fixed values.
CHANNELS = ("mempool-transactions", "mempool-txids")
KINDS = ("added", "removed", "mined", "replaced")
ENVELOPE = ("run_id", "session_id", "message_id", "received_at")
TXID = r"^[0-9a-fA-F]{64}\z"


def kind_of(v: Column) -> Column:
    """object, list, string, integer or other; null for no value, null_value for a JSON null."""
    return kind_from(F.schema_of_variant(v))


def kind_from(s: Column) -> Column:
    """The same from the schema of a variant as text, for places that have it as a column."""
    return (
        F.when(s == "VOID", F.lit("null_value"))
        .when(s.startswith("OBJECT"), F.lit("object"))
        .when(s.startswith("ARRAY"), F.lit("list"))
        .when(s == "STRING", F.lit("string"))
        .when(s == "BIGINT", F.lit("integer"))
        .when(s.isNotNull(), F.lit("other"))
    )


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_of(v: Column) -> Column:
    """The string of a variant that is one."""
    return F.when(kind_of(v) == "string", F.try_variant_get(v, "$", "string"))


def txid_of(c: Column) -> Column:
    return F.when(c.rlike(TXID), F.lower(c))


def event_id(message_id: Column, channel: Column, kind: Column, pos: Column) -> Column:
    """SHA-256 of the compact JSON list of the four: the same on every replay."""
    head = F.to_json(F.array(message_id, channel, kind))
    return F.sha2(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), pos.cast("string"), F.lit("]")), 256)


def envelope_issues(messages: DataFrame) -> Column:
    """ARRAY<STRING>: empty for a message whose envelope can be read."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"no {c} in the envelope")) for c in ENVELOPE]))
    one = lambda s: F.array(F.lit(s))
    return (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), one("envelope version is not supported"))
        .when(F.size(missing) > 0, missing)
        .when(iso_instant(F.col("received_at")).isNull(), one("received_at is no ISO time with a zone"))
        .when(F.coalesce("message_type", F.lit("text")) != "text", one("binary message"))
        .when(F.col("__v").isNull(), one("raw_text is no valid JSON"))
        .when(kind_of(F.col("__v")) != "object", one("raw_text is no JSON object"))
        .otherwise(F.array().cast("array<string>"))
    )


def parse(messages: DataFrame) -> DataFrame:
    """messages with __v (the payload, null where the envelope or the JSON is unusable) and __issues."""
    parsed = once(messages, __v=F.try_parse_json("raw_text"))
    parsed = once(parsed, __issues=envelope_issues(messages))
    return parsed.withColumn("__v", F.when(F.size("__issues") == 0, F.col("__v")))


def _bodies(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per channel that a message has: channel, body, sequence."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), member(F.col("__v"), f"$['{c}']").alias("body")) for c in CHANNELS])).alias("b")
    rows = parsed.where("__v is not null").select(*keep, each).where("b.body is not null").select(*keep, "b.channel", "b.body")
    seq = member(F.col("body"), "$.sequence")
    value = F.when(kind_of(seq) == "integer", F.try_variant_get(seq, "$", "bigint"))
    return rows.withColumns({"sequence": F.when(value >= 0, value), "__bad_sequence": seq.isNotNull() & (kind_of(seq) != "null_value") & ~F.coalesce(value >= 0, F.lit(False))})


KEEP = ["run_id", "session_id", "message_id", "received_at", "source_mode"]


def events(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """event_id, run_id, source_session_id, source_message_id, source_sequence, source_mode, event_type, txid,
    replacement_txid, event_time (of receipt), payload VARIANT, channel, pos; then the columns of `keep`."""
    extra = [c for c in keep or [] if c not in KEEP]
    rows = _bodies(parse(messages), KEEP + extra)
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.try_variant_get("body", f"$.{k}", "array<variant>").alias("list")) for k in KINDS])
    each = rows.select(*KEEP, *extra, "channel", "sequence", F.explode(lists).alias("l")).where("l.list is not null")
    each = each.select(*KEEP, *extra, "channel", "sequence", F.col("l.kind").alias("kind"), F.posexplode("l.list").alias("pos", "entry"))
    e = F.col("entry")
    swap = (F.col("kind") == "replaced") & member(e, "$.replaced").isNotNull()
    candidate = F.when(swap, text_of(member(e, "$.replaced"))).when(kind_of(e) == "object", text_of(member(e, "$.txid"))).otherwise(text_of(e))
    return each.select(
        event_id(F.col("message_id"), F.col("channel"), F.col("kind"), F.col("pos")).alias("event_id"),
        "run_id",
        F.col("session_id").alias("source_session_id"),
        F.col("message_id").alias("source_message_id"),
        F.col("sequence").alias("source_sequence"),
        F.coalesce("source_mode", F.lit("ws")).alias("source_mode"),
        F.col("kind").alias("event_type"),
        txid_of(candidate).alias("txid"),
        F.when(swap, txid_of(text_of(member(e, "$.by.txid")))).alias("replacement_txid"),
        swap.alias("is_swap"),
        iso_instant(F.col("received_at")).alias("event_time"),
        e.alias("payload"),
        "channel",
        "pos",
        *extra,
    )


def issues(messages: DataFrame, key: list[str]) -> DataFrame:
    """key, detail: one row per problem, of envelopes, channels, lists and entries."""
    parsed = parse(messages)
    envelope = parsed.select(*key, F.explode("__issues").alias("detail"))
    bodies = _bodies(parsed, list(dict.fromkeys(KEEP + key)))
    is_object = kind_of(F.col("body")) == "object"
    lists = [F.when(kind_of(member(F.col("body"), f"$.{k}")) != "list", F.concat(F.col("channel"), F.lit(f".{k} is no list"))) for k in KINDS]
    found = F.when(~is_object, F.array(F.concat(F.col("channel"), F.lit(" is no object")))).otherwise(F.array_compact(F.array(F.when(F.col("__bad_sequence"), F.concat(F.col("channel"), F.lit(".sequence is no whole number"))), *lists)))
    channel = bodies.select(*key, F.explode(found).alias("detail"))
    e = events(messages, key)
    place = F.concat("channel", F.lit("."), "event_type", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    # A key that an event carries under another name is read from there.
    names = {"message_id": "source_message_id", "session_id": "source_session_id"}
    own = [F.col(names.get(k, k)).alias(k) for k in key]
    bad = F.array_compact(F.array(F.when(F.col("is_swap") & F.col("replacement_txid").isNull(), F.concat(place, F.lit(" has no usable replacement"))), F.when(F.col("txid").isNull(), F.concat(place, F.lit(" has no usable txid")))))
    entry = e.select(*own, F.explode(bad).alias("detail"))
    return envelope.unionByName(channel).unionByName(entry)


def recognised(messages: DataFrame) -> DataFrame:
    """messages with is_recognised: whether any known channel is there."""
    parsed = parse(messages)
    any_ = None
    for c in CHANNELS:
        here = member(F.col("__v"), f"$['{c}']").isNotNull()
        any_ = here if any_ is None else any_ | here
    return parsed.withColumn("is_recognised", F.coalesce(any_, F.lit(False))).drop("__v", "__issues")


def process(messages: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, feature rows, summary) of the first delivery of each message; messages without an id are each their own.

    summary has one row: deliveries, duplicates and conflicts among them, events by kind, added events whose features
    could not be made, and feature rows written, repeated and in conflict.
    """
    from . import first_wins
    from .features import FEATURES, extract

    content = F.xxhash64("run_id", "session_id", "received_at", "message_type", "raw_text")
    verdicts = first_wins.classified(messages, ["message_id"], order, content)
    firsts = verdicts.where(F.col("verdict").isin("kept", "unkeyed"))
    all_events = events(firsts.drop("verdict"), order)
    added = extract(all_events.where("event_type = 'added'"), "payload")
    usable = added.where("features is not null and txid is not null")
    features = first_wins.classified(usable.select("txid", "event_id", "event_time", "source_mode", "source_message_id", *order, "channel", "pos", "features"), ["txid"], [*order, "channel", "pos"], F.xxhash64("features"))
    rows = features.where("verdict = 'kept'").select("txid", "event_id", F.col("event_time").alias("received_at"), "source_mode", *[F.col(f"features.{f}") for f in FEATURES])
    count = lambda df, **c: df.agg(*[e.alias(n) for n, e in c.items()])
    v = lambda name: F.count_if(F.col("verdict") == name)
    summary = count(verdicts, deliveries=F.count("*"), duplicate_messages=v("duplicate"), conflicting_messages=v("conflict"))
    summary = summary.crossJoin(count(all_events, **{f"events_{k}": F.count_if(F.col("event_type") == k) for k in KINDS}, unique_txids=F.count_distinct("txid")))
    summary = summary.crossJoin(count(added, incomplete_added=F.count_if(F.col("features").isNull() | F.col("txid").isNull())))
    summary = summary.crossJoin(count(features, features_written=v("kept"), duplicate_added=v("duplicate"), conflicting_features=v("conflict")))
    return all_events, rows, summary

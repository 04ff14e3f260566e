"""Raw captures: newline-delimited envelopes, plain or gzip; session summaries; streams of either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The envelope of a raw message. Fixed values.
ENVELOPE = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("schema_version", T.IntegerType()),
            ("run_id", T.StringType()),
            ("session_id", T.StringType()),
            ("message_id", T.StringType()),
            ("received_at", T.StringType()),
            ("source_mode", T.StringType()),
            ("message_type", T.StringType()),
            ("raw_text", T.StringType()),
        )
    ]
)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file: lines that aren't blank, of files or directories; .gz is unpacked (and read as one split each)."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.trim("line") != "")


def envelopes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, rejected lines). A message is a JSON object of version 1 with an id; its fields count only if strings."""
    from ..functions.once import once
    from ..operators.normalise import kind_of, member, text_of

    v = once(lines, __v=F.try_parse_json("line"))
    version = member(F.col("__v"), "$.schema_version")
    fields = [F.when(kind_of(version) == "integer", F.try_variant_get(version, "$", "int")).alias("schema_version")]
    fields += [text_of(member(F.col("__v"), f"$.{f.name}")).alias(f.name) for f in ENVELOPE.fields[1:]]
    parsed = once(v, __m=F.struct(*fields))
    fine = F.coalesce((F.col("__m.schema_version") == 1) & (F.col("__m.message_id") != ""), F.lit(False))
    rest = [c for c in lines.columns if c != "line"]
    return parsed.where(fine).select("__m.*", *rest), parsed.where(~fine).select("line", *rest)


def session_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Rows of capture_sessions from summary documents (one JSON document per file), with gaps summed up.

    A gap without two readable ends adds nothing to the seconds, but counts as a gap. The file's folder names the session.
    """
    from ..functions.ids import iso_instant

    gap = "array<struct<start:string,end:string>>"
    schema = (
        "run_id string, config struct<url:string>, started_at string, ended_at string, elapsed_seconds double, stop_reason string, messages_saved bigint, connection_errors bigint,"
        f" gaps {gap}, event_counts struct<added:bigint,removed:bigint,mined:bigint,replaced:bigint>"
    )
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    length = lambda g: (F.unix_micros(iso_instant(g["end"])) - F.unix_micros(iso_instant(g["start"]))) / 1e6
    seconds = F.aggregate(F.coalesce("gaps", F.array().cast(gap)), F.lit(0.0), lambda a, g: a + F.coalesce(length(g), F.lit(0.0)))
    return docs.select(
        F.element_at(F.split("file", "/"), -2).alias("session"),
        "run_id",
        F.col("config.url").alias("source_url"),
        iso_instant(F.col("started_at")).alias("started_at"),
        iso_instant(F.col("ended_at")).alias("ended_at"),
        "elapsed_seconds",
        "stop_reason",
        "messages_saved",
        "connection_errors",
        F.coalesce(F.size("gaps"), F.lit(0)).cast("bigint").alias("recorded_gaps"),
        F.round(seconds, 3).alias("recorded_gap_seconds"),
        *[F.coalesce(F.col(f"event_counts.{k}"), F.lit(0)).cast("bigint").alias(f"events_{k}") for k in ("added", "removed", "mined", "replaced")],
    )


def message_stream(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """A stream of envelopes: source "file" reads new Parquet files of them, "kafka" a topic (with the connector on the class path)."""
    if source == "file":
        path = options.pop("path")
        return spark.readStream.schema(ENVELOPE).options(**options).parquet(path)
    if source == "kafka":
        rows = spark.readStream.format("kafka").options(startingOffsets="earliest", **options).load()
        return decoded(rows)
    raise ValueError(f"no stream source {source!r}; there are file and kafka")


def _read_envelope(records: DataFrame) -> DataFrame:
    """records (value BINARY, partition, offset, timestamp) with m, the envelope, and reason, why there is none."""
    schema = T.StructType([*ENVELOPE.fields, T.StructField("__corrupt", T.StringType())])
    text = F.col("value").cast("string")
    read = records.withColumn("m", F.from_json(text, schema, {"columnNameOfCorruptRecord": "__corrupt"}))
    reason = (
        F.when(F.col("value").isNull(), F.lit("no value"))
        .when(~F.is_valid_utf8(text), F.lit("not UTF-8"))
        .when(F.col("m").isNull() | F.col("m.__corrupt").isNotNull(), F.lit("no JSON object of the envelope's types"))
    )
    return read.withColumn("reason", reason)


def decoded(records: DataFrame) -> DataFrame:
    """The envelopes of a topic's records, with kafka_partition, kafka_offset and timestamp; others are in `undecodable`."""
    good = _read_envelope(records).where("reason is null")
    return good.select(*[F.col(f"m.{n}") for n in ENVELOPE.names], F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), "timestamp")


def undecodable(records: DataFrame) -> DataFrame:
    """kafka_partition, kafka_offset, timestamp, reason, value_base64 of the records that hold no envelope: nothing of them is lost."""
    bad = _read_envelope(records).where("reason is not null")
    return bad.select(F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), "timestamp", "reason", F.base64("value").alias("value_base64"))


def topic(spark: SparkSession, servers: str, name: str) -> DataFrame:
    """A whole topic with its append times, as a table."""
    return spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": name, "startingOffsets": "earliest"}).load()


def sessions_without(lake_sessions: DataFrame, other: DataFrame) -> DataFrame:
    """Sessions of a fallback source that the lake doesn't have."""
    return other.select("session").distinct().join(lake_sessions.select("session"), "session", "left_anti")


def with_fallback(lake_rows: DataFrame, other_rows: DataFrame) -> DataFrame:
    """The lake's rows, and those of sessions that only the other source has. Columns by name; what one lacks is null."""
    missing = sessions_without(lake_rows.select("session").distinct(), other_rows)
    return lake_rows.unionByName(other_rows.join(missing, "session", "left_semi"), allowMissingColumns=True)


def pending(sessions: DataFrame, done: DataFrame, on: str | None = None) -> DataFrame:
    """Sessions not done yet; on: only those whose name carries this UTC date (yyyy-mm-dd). Names without one never match a date."""
    day = F.try_to_timestamp(F.regexp_extract("session", r"(\d{8})T\d{6}Z", 1), F.lit("yyyyMMdd")).cast("date")
    left = sessions.withColumn("session_date", day).join(done.select("session"), "session", "left_anti")
    return left if on is None else left.where(F.col("session_date") == F.lit(on).cast("date"))

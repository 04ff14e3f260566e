"""Sinks beside the lake's own writer: text lines, CSV, archives, a Kafka topic, local capture files."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.first_wins import canonical_json_hash


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """Rows as JSON lines; an existing path is an error."""
    df.write.mode("errorifexists").option("compression", compression).json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; arrays of strings are joined by ';'. one_file: for reports of few rows."""
    flat = [F.array_join(f.name, ";").alias(f.name) if f.dataType.simpleString() == "array<string>" else F.col(f"`{f.name}`") for f in df.schema.fields]
    out = df.select(*flat)
    (out.coalesce(1) if one_file else out).write.mode("errorifexists").option("header", True).csv(path)


def archive(spark: SparkSession, batch: DataFrame, path: str, key: str = "message_id", body: str = "raw_text") -> DataFrame:
    """Append the messages an archive lacks; returns key and verdict (new, duplicate, conflict) of each batch row.

    One row per key is stored and never changed; a known key with another content is a conflict and is only reported.
    Files are as large as the batches, not one per message.
    """
    from ..session import hadoop_path, stored

    rows = batch.where(F.col(key).isNotNull()).withColumn("content_sha256", canonical_json_hash(F.col(body)))
    fs, p = hadoop_path(spark, path)
    held = spark.read.parquet(path).select(key, F.col("content_sha256").alias("held")) if fs.exists(p) else spark.createDataFrame([], f"{key} string, held string")
    first = rows.groupBy(key).agg(F.min(F.struct("content_sha256", *[c for c in batch.columns if c != key])).alias("m"))
    known = stored(rows.join(held, key, "left").join(first.select(key, F.col("m.content_sha256").alias("first")), key), "archive")
    verdict = F.when(F.col("held").isNull(), F.when(F.col("content_sha256") == F.col("first"), "new").otherwise("conflict")).when(F.col("held") == F.col("content_sha256"), "duplicate").otherwise("conflict")
    out = stored(known.select(key, verdict.alias("verdict")), "archive-verdicts")
    fresh = known.where(F.col("held").isNull() & (F.col("content_sha256") == F.col("first"))).drop("held", "first").dropDuplicates([key])
    fresh.write.mode("append").option("compression", "zstd").parquet(path)
    return out


def kafka_rows(messages: DataFrame) -> DataFrame:
    """key, value of a topic: keyed by session, else run, else message, so that one session stays in one partition in order."""
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("session_id", "run_id", "message_id")])
    return messages.select(key.alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """To Kafka, acknowledged by all replicas. Needs the connector."""
    kafka_rows(messages).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}).save()


class CaptureFile:
    """A local append-only file of JSON lines with a byte cap; an existing file is never opened."""

    def __init__(self, path: str | os.PathLike, max_bytes: int | None = None):
        self.max_bytes, self.n_bytes = max_bytes, 0
        self._f = open(path, "xb")

    def append(self, record: dict) -> bool:
        """False, and nothing written, where the record would exceed the cap."""
        line = json.dumps(record, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode() + b"\n"
        if self.max_bytes is not None and self.n_bytes + len(line) > self.max_bytes:
            return False
        self._f.write(line)
        self.n_bytes += len(line)
        return True

    def close(self) -> None:
        self._f.flush()
        os.fsync(self._f.fileno())
        self._f.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def write_summary(path: str | os.PathLike, value: dict) -> None:
    """A small JSON document that is there whole or not at all."""
    path = Path(path)
    draft = path.with_name(f".{path.name}.draft")
    draft.write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    draft.replace(path)


def pack(path: str | os.PathLike) -> Path:
    """gzip a finished file, read the packed one back, and only then remove the plain one."""
    plain, packed = Path(path), Path(f"{path}.gz")

    def sha(f):
        h = hashlib.sha256()
        while block := f.read(1 << 20):
            h.update(block)
        return h.hexdigest()

    with plain.open("rb") as f, gzip.GzipFile(filename="", fileobj=packed.open("xb"), mode="wb", mtime=0) as g:
        while block := f.read(1 << 20):
            g.write(block)
    with plain.open("rb") as a, gzip.open(packed, "rb") as b:
        if sha(a) != sha(b):
            packed.unlink()
            raise ValueError(f"{packed} differs from what it was made of")
    plain.unlink()
    return packed

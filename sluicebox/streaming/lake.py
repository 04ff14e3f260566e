"""The stream into the lake: the functions of the batch path, in micro-batches, with state in the checkpoint.

Deduplication is Spark's own, keyed by message id and kept without a watermark, so a replay of any age finds its first
delivery (a watermark would drop unique late messages). A micro-batch is written under its batch id as a unit of the
lake; Spark replays the same offsets under the same id, and writing a unit again replaces it, so a crash between write
and commit leaves no doubles.

Events with a null txid are quarantined here as in the batch path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import LIFECYCLE_EVENTS, TRANSACTIONS
from ..functions.ids import clean_name
from ..operators import gate, normalise, rules
from ..operators.features import FEATURE_SET_VERSION, FEATURES, extract
from ..session import names_in

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def lake_rows(messages: DataFrame, seen: DataFrame | None = None, order: tuple[str, ...] = ("source_message_id",)) -> tuple[DataFrame, DataFrame]:
    """(transaction rows, event rows) as JSON for the gate, with an order: the one path of batch and stream.

    The first usable addition of a txid in a run gives its transaction row. seen: run_id and txid that earlier batches
    have written already.
    """
    found = normalise.events(messages, [c for c in order if c in messages.columns])
    ord_ = F.struct(*order, "channel", "event_type", "pos").alias("ord")
    event = F.struct(
        "event_id", F.col("run_id").alias("session"), "run_id", "txid", "event_type", F.date_format("event_time", ISO).alias("event_time"), "source_sequence", "replacement_txid", "source_message_id"
    )
    to_row = lambda s: F.parse_json(F.to_json(s, {"ignoreNullFields": "false"})).alias("row")
    events = found.select(to_row(event), ord_)
    added = extract(found.where("event_type = 'added' and txid is not null"), "payload").where("features is not null")
    firsts = added.groupBy("run_id", "txid").agg(F.min(F.struct(ord_, "event_id", "event_time", "source_mode", "features")).alias("m")).select("run_id", "txid", "m.*")
    if seen is not None:
        firsts = firsts.join(seen, ["run_id", "txid"], "left_anti")
    flat = firsts.select("ord", "run_id", "txid", "event_id", "event_time", "source_mode", *[F.col(f"features.{f}") for f in FEATURES])
    screened = rules.screen(flat)
    row = F.struct(
        "txid", "event_id", F.col("run_id").alias("session"), F.date_format("event_time", ISO).alias("received_at"), "source_mode", F.lit(FEATURE_SET_VERSION).alias("feature_set_version"), *FEATURES,
        "ruleset_version", "is_flagged", "signal_count", "rule_ids",
    )
    return screened.select(to_row(row), "ord"), events


def write_unit(spark: SparkSession, messages: DataFrame, lake: str, unit: str) -> list[dict]:
    """One set of first deliveries into the lake; the reports of its two tables."""
    buckets = [r.b for r in messages.select(_bucket(F.col("run_id")).alias("b")).distinct().collect()]  # SEEN_BUCKETS at most
    transactions, events = lake_rows(messages, _seen(spark, lake, unit, buckets))
    reports = [gate.write_lake(spark, transactions, TRANSACTIONS, lake, unit), gate.write_lake(spark, events, LIFECYCLE_EVENTS, lake, unit)]
    if reports[0]["rows_written"]:
        written = gate.read_lake(spark, lake, TRANSACTIONS, unit).select(F.col("session").alias("run_id"), "txid")
        placed = written.withColumn("bucket", _bucket(F.col("run_id"))).withColumn("of", F.lit(unit))
        placed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "of").parquet(f"{lake}/{SEEN}")
    return reports


#: Where the lake lists which transactions of which run it holds, in buckets of runs: a batch reads those of its own runs.
SEEN, SEEN_BUCKETS = "_seen", 256


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(SEEN_BUCKETS)).cast("int")


def _seen(spark: SparkSession, lake: str, unit: str, buckets: list[int]) -> DataFrame | None:
    """run_id, txid that other units have written, of the buckets asked for; nothing else of the lake is read."""
    there = set(names_in(spark, f"{lake}/{SEEN}"))
    paths = [f"{lake}/{SEEN}/bucket={b}" for b in buckets if f"bucket={b}" in there]
    if not paths:
        return None
    held = spark.read.schema("run_id string, txid string, bucket int, of string").option("basePath", f"{lake}/{SEEN}").parquet(*paths)
    return held.where(F.col("of") != unit).select("run_id", "txid").distinct()


def first_deliveries(messages: DataFrame) -> DataFrame:
    """A stream (or table) with one row per message id; messages without an id all stay."""
    keyed = messages.withColumn("__id", F.coalesce(clean_name(F.col("message_id")), F.concat(F.lit("none/"), F.sha2(F.to_json(F.struct("*")), 256))))
    return keyed.dropDuplicates(["__id"]).drop("__id")


def stream_to_lake(messages: DataFrame, lake: str, checkpoint: str, on_batch: Callable[[int, list[dict]], None] | None = None, every: str | None = None):
    """Start the query: all that is there now (every=None), or a batch each interval."""

    def write(df: DataFrame, batch_id: int) -> None:
        reports = write_unit(df.sparkSession, df, lake, f"stream-{batch_id:012d}")
        if on_batch:
            on_batch(batch_id, reports)

    writer = first_deliveries(messages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def enrich_stream(messages: DataFrame, enriched: str, errors: str, checkpoint: str):
    """Raw messages to their events in one place and their problems in another, in one pass over each micro-batch.

    Both are written under the batch's own directory, so a replay replaces them.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        from ..session import stored

        kept = stored(df, "enrich")
        e = normalise.events(kept)
        e.withColumn("payload", F.to_json("payload")).write.mode("overwrite").parquet(f"{enriched}/batch={batch_id}")
        normalise.issues(kept, ["message_id"]).write.mode("overwrite").json(f"{errors}/batch={batch_id}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- metrics


def progress_rows(query) -> list[dict]:
    """batch, rows, seconds and lag (offsets not yet read, where the source tells them) of each finished batch."""
    out = []
    for p in query.recentProgress:
        lag = 0
        for s in p["sources"]:
            end, latest = s.get("endOffset"), s.get("latestOffset")
            if isinstance(end, dict) and isinstance(latest, dict):
                for t, parts in latest.items():
                    if isinstance(parts, dict):
                        lag += sum(max(0, n - end.get(t, {}).get(k, 0)) for k, n in parts.items())
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["batchDuration"] / 1000, "lag": lag})
    return out


#: Alert rules over metrics: name, and for how long the condition must have held. Fixed values.
ALERTS = {"down": 120, "lag": 120, "stale": 300, "quarantine": 0}


def alerts(samples: DataFrame, max_lag: int = 1000, max_age: int = 600, quarantine_window: int = 600, by: tuple[str, ...] = ()) -> DataFrame:
    """at, alert, and the columns `by` (the worker a sample is of; without any, all samples are of one): from samples of (at TIMESTAMP, up BOOLEAN, lag BIGINT, age_seconds DOUBLE, quarantined BIGINT, a running total).

    A condition fires once it has held in all samples of its time, and the samples reach back that far.
    """
    seconds = F.unix_seconds("at")
    s = samples.withColumn("__t", seconds)
    each = Window.partitionBy(*by).orderBy("__t")

    def held(condition, span: int):
        w = each.rangeBetween(-span, 0)  # samples of one worker: some per minute
        return F.bool_and(condition).over(w) & (F.min("__t").over(each.rangeBetween(Window.unboundedPreceding, 0)) <= F.col("__t") - span)

    grown = F.max("quarantined").over(each.rangeBetween(-quarantine_window, 0)) > F.min("quarantined").over(each.rangeBetween(-quarantine_window, 0))
    rules_ = {
        "down": held(~F.col("up"), ALERTS["down"]),
        "lag": held(F.coalesce(F.col("lag") > max_lag, F.lit(False)), ALERTS["lag"]),
        "stale": held(F.coalesce(F.col("age_seconds") > max_age, F.lit(False)), ALERTS["stale"]),
        "quarantine": grown,
    }
    fired = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules_.items()]))
    return s.withColumn("__f", fired).select(*by, "at", F.explode("__f").alias("alert"))

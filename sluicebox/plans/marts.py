"""Staging views, the lifecycle of each transaction, and the marts on top.

Winners are picked by aggregation (min_by, max_by over an ordering struct), not by a window: partial aggregation keeps
one candidate per key and task, so neither a hot transaction nor a long history ever stands in one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changefeed import operation_rank
from .views import capture_sessions, cleaned_events, cleaned_transactions

#: Lifecycle status by last event type. Fixed values.
STATUS = {"added": "observed_unconfirmed", "removed": "removed_unknown_reason", "mined": "confirmed", "replaced": "superseded"}


def status_of(event_type: Column) -> Column:
    out = F.lit(STATUS["replaced"])
    for kind in ("mined", "removed", "added"):
        out = F.when(event_type == kind, F.lit(STATUS[kind])).otherwise(out)
    return F.when(event_type.isNotNull(), out)


def stg_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_transactions(spark, sf_dir).withColumnRenamed("event_id", "source_event_id").drop("source_mode")


def stg_lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_events(spark, sf_dir)


def stg_capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_sessions(spark, sf_dir)


def last_first() -> Column:
    """An ordering whose minimum is the last event: latest time, strongest type, smallest id."""
    return F.struct(F.bitwise_not(F.unix_micros("event_time")).alias("t"), F.negative(operation_rank(F.col("event_type"))).alias("r"), F.isnull("event_id").alias("n"), F.col("event_id").alias("e"))


def transaction_lifecycle(events: DataFrame) -> DataFrame:
    """One row per txid from all of its evidence, in one aggregation."""
    grouped = events.groupBy("txid").agg(
        F.min("event_time").alias("first_event_at"),
        F.max("event_time").alias("last_event_at"),
        F.count("*").alias("events"),
        F.bool_or(F.col("event_type") == "mined").alias("was_mined"),
        F.bool_or(F.col("event_type") == "replaced").alias("was_replaced"),
        F.min_by("event_type", last_first()).alias("latest_event_type"),
    )
    return grouped.withColumn("lifecycle_status", status_of(F.col("latest_event_type")))


def int_transaction_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transaction_lifecycle(stg_lifecycle_events(spark, sf_dir))


FIRST = ("session", "received_at", "dt", "hour", "n_in", "n_out", "value_out_sat", "fee_sat", "vsize", "fee_rate_sat_vb", "max_equal_output_count", "round_amount_fraction", "rbf_signaled", "is_flagged", "signal_count", "rule_ids", "feature_set_version", "ruleset_version")


def fct_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per transaction: first observation, number of observations, lifecycle. One shuffle per side, on txid."""
    rest = [c for c in FIRST if c not in ("received_at", "session")]
    t = stg_transactions(spark, sf_dir).where("txid is not null")
    first = t.groupBy("txid").agg(F.min(F.struct("received_at", "session", *rest)).alias("f"), F.count("*").alias("sessions_observed"))
    life = int_transaction_lifecycle(spark, sf_dir)
    named = [F.col("f.session").alias("first_session"), F.col("f.received_at").alias("first_received_at"), *[F.col(f"f.{c}") for c in rest]]
    return first.join(life, "txid", "left").select(
        "txid",
        *named,
        "sessions_observed",
        F.coalesce("lifecycle_status", F.lit(STATUS["added"])).alias("lifecycle_status"),
        F.coalesce("was_mined", F.lit(False)).alias("was_mined"),
        F.coalesce("was_replaced", F.lit(False)).alias("was_replaced"),
        "last_event_at",
    )


def fct_hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions, flags, exact fee quantiles and events per hour; hours without transactions are left out.

    Exact percentiles keep a histogram of distinct values per hour (fee rates have six decimals and repeat).
    """
    t = stg_transactions(spark, sf_dir).groupBy("dt", "hour").agg(
        F.count("*").alias("transactions"),
        F.count_if("is_flagged").alias("flagged"),
        F.expr("percentile(fee_rate_sat_vb, array(0.5, 0.9))").alias("q"),
        F.sum("value_out_sat").alias("value_out_sat"),
    )
    kinds = ("added", "removed", "mined", "replaced")
    e = stg_lifecycle_events(spark, sf_dir).groupBy("dt", "hour").agg(*[F.count_if(F.col("event_type") == k).alias(f"events_{k}") for k in kinds])
    return t.join(e, ["dt", "hour"], "left").select(
        "dt",
        "hour",
        "transactions",
        "flagged",
        F.round(F.lit(100.0) * F.col("flagged") / F.col("transactions"), 2).alias("flag_rate_pct"),
        F.col("q")[0].alias("median_fee_rate_sat_vb"),
        F.col("q")[1].alias("p90_fee_rate_sat_vb"),
        "value_out_sat",
        *[F.coalesce(f"events_{k}", F.lit(0)).alias(f"events_{k}") for k in kinds],
    )


def dim_capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = stg_transactions(spark, sf_dir).groupBy("session").agg(F.count("*").alias("transactions"), F.count_if("is_flagged").alias("flagged"))
    ratio = F.when(F.col("elapsed_seconds") > 0, F.round(F.lit(100.0) * F.col("recorded_gap_seconds") / F.col("elapsed_seconds"), 2))
    return (
        stg_capture_sessions(spark, sf_dir)
        .withColumns({"gap_pct": ratio, "collected_on_aws": F.startswith("session", F.lit("session-aws-"))})
        .join(per, "session", "left")
        .fillna(0, ["transactions", "flagged"])
    )


def outcome_shares(facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("is_flagged", "lifecycle_status").agg(F.count("*").alias("transactions"))
    totals = counts.groupBy("is_flagged").agg(F.sum("transactions").alias("total"))
    joined = counts.join(F.broadcast(totals), counts.is_flagged.eqNullSafe(totals.is_flagged)).drop(totals.is_flagged)
    return joined.select("is_flagged", "lifecycle_status", "transactions", F.round(F.lit(100.0) * F.col("transactions") / F.col("total"), 2).alias("pct_within_flag_group"))


def fct_outcomes_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_shares(fct_transactions(spark, sf_dir))


def build_marts(spark: SparkSession, sf_dir: str, out_dir: str) -> dict[str, int]:
    """Write the marts in order of dependence; the facts are read back, not computed again. Returns their row counts."""
    done = {}
    for f in (int_transaction_lifecycle, fct_transactions, fct_hourly_activity, dim_capture_sessions):
        f(spark, sf_dir).write.mode("overwrite").parquet(f"{out_dir}/{f.__name__}")
        done[f.__name__] = spark.read.parquet(f"{out_dir}/{f.__name__}").count()
    facts = spark.read.parquet(f"{out_dir}/fct_transactions")
    outcome_shares(facts).write.mode("overwrite").parquet(f"{out_dir}/fct_outcomes_by_flag")
    done["fct_outcomes_by_flag"] = spark.read.parquet(f"{out_dir}/fct_outcomes_by_flag").count()
    return done

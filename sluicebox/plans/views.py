"""The lake as named views: tables of a scale directory, or of a lake directory, with their partition values."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..sources import table


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened observations with dt (text) and hour (int) of their receipt."""
    return table(spark, sf_dir, "transactions").withColumns({"dt": F.date_format("received_at", "yyyy-MM-dd"), "hour": F.hour("received_at")})


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lifecycle_events").withColumns({"dt": F.date_format("event_time", "yyyy-MM-dd"), "hour": F.hour("event_time")})


def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "capture_sessions")


def register(spark: SparkSession, sf_dir: str) -> None:
    """The views that SQL texts name."""
    for f in (transactions, lifecycle_events, capture_sessions):
        f(spark, sf_dir).createOrReplaceTempView(f.__name__)


#: Queries by name; all run as they stand on the views of `register`.
NAMED = {
    "hourly_flag_rate": """
        SELECT dt, hour, count(*) AS transactions, count_if(is_flagged) AS flagged,
               round(100.0D * count_if(is_flagged) / count(*), 2) AS flag_rate_pct
        FROM transactions GROUP BY dt, hour ORDER BY dt, hour""",
    "signals_by_rule": """
        SELECT rule_id, count(*) AS signals FROM transactions LATERAL VIEW explode(rule_ids) r AS rule_id
        GROUP BY rule_id ORDER BY signals DESC, rule_id""",
    "lifecycle_outcomes": """
        WITH last AS (
            SELECT max_by(event_type, struct(event_time, CASE event_type WHEN 'mined' THEN 4 WHEN 'replaced' THEN 3 WHEN 'removed' THEN 2 ELSE 1 END, event_type)) AS event_type
            FROM lifecycle_events GROUP BY txid)
        SELECT event_type AS latest_state, count(*) AS transactions FROM last GROUP BY event_type ORDER BY transactions DESC, latest_state""",
    "capture_coverage": """
        SELECT session, started_at, elapsed_seconds, stop_reason, messages_saved, connection_errors, recorded_gap_seconds,
               round(100.0D * recorded_gap_seconds / nullif(elapsed_seconds, 0), 2) AS gap_pct
        FROM capture_sessions ORDER BY started_at""",
}


def query_text(name_or_path: str) -> str:
    """The text of a file, or of a named query; an unknown name says which there are."""
    path = Path(name_or_path)
    if path.is_file():
        return path.read_text(encoding="utf-8")
    name = name_or_path.removesuffix(".sql")
    if name not in NAMED:
        raise ValueError(f"no file and no named query {name_or_path!r}; named are {', '.join(sorted(NAMED))}")
    return NAMED[name]


def run_query(spark: SparkSession, sf_dir: str, name_or_path: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(query_text(name_or_path))


def as_json_rows(df: DataFrame) -> dict:
    """{columns, rows} of a small result, times as ISO text: what the command line prints."""
    iso = lambda v: v.isoformat() if hasattr(v, "isoformat") else v
    return {"columns": df.columns, "rows": [[iso(v) for v in row] for row in df.collect()]}


def cleaned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with cleaned ids and types; those without a txid or of an unknown type are no evidence."""
    e = lifecycle_events(spark, sf_dir)
    e = e.withColumns({"event_id": clean_id(F.col("event_id")), "txid": clean_id(F.col("txid")), "event_type": clean_id(F.col("event_type"))})
    return e.where("txid is not null and event_time is not null and event_type in ('added', 'removed', 'mined', 'replaced')")


def cleaned_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return t.withColumns({"txid": clean_id(F.col("txid")), "event_id": clean_id(F.col("event_id"))})

"""Table contracts: columns, types, keys and row checks, declared once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
TXID = r"^[0-9a-f]{64}\z"
EVENT_TYPES = ("added", "removed", "mined", "replaced")

SPARK_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = False


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    key: str
    time: str
    hourly: bool
    checks: tuple[tuple[str, str], ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.kind], f.nullable) for f in self.fields])

    @property
    def read_schema(self) -> T.StructType:
        """With the partition columns in their own types: dt is text, hour a number."""
        parts = [T.StructField("dt", T.StringType())] + ([T.StructField("hour", T.IntegerType())] if self.hourly else [])
        return T.StructType([*[T.StructField(f.name, f.dataType) for f in self.schema.fields], *parts])

    def partition(self) -> dict[str, Column]:
        out = {"dt": F.date_format(self.time, "yyyy-MM-dd")}
        return out | ({"hour": F.date_format(self.time, "HH")} if self.hourly else {})

    def ddl(self, location: str) -> str:
        """An external table for a catalogue."""
        columns = ",\n  ".join(f"{f.name} {f.kind}" for f in self.fields)
        parts = "dt string, hour int" if self.hourly else "dt string"
        return f"CREATE EXTERNAL TABLE {self.name} (\n  {columns})\nPARTITIONED BY ({parts})\nSTORED AS PARQUET\nLOCATION '{location}/{self.name}'"


def _fields(text: str) -> tuple[Field, ...]:
    """name:type, with ? for nullable."""
    out = []
    for item in text.split():
        name, kind = item.split(":")
        out.append(Field(name, kind.rstrip("?"), kind.endswith("?")))
    return tuple(out)


#: The lake's tables. Fixed values.
TRANSACTIONS = Contract(
    "transactions",
    _fields(
        "txid:string event_id:string session:string received_at:timestamp source_mode:string feature_set_version:string n_in:int n_out:int value_out_sat:bigint fee_sat:bigint vsize:int fee_rate_sat_vb:double"
        " max_equal_output_count:int round_amount_fraction:double rbf_signaled:boolean? ruleset_version:string is_flagged:boolean signal_count:int rule_ids:array<string>"
    ),
    "txid",
    "received_at",
    True,
    (
        ("txid_format", rf"txid rlike '{TXID}'".replace("\\", "\\\\")),
        ("counts_positive", "n_in >= 1 and n_out >= 1 and vsize >= 1"),
        ("amounts_nonnegative", "value_out_sat >= 0 and fee_sat >= 0 and fee_rate_sat_vb >= 0"),
        ("fraction_in_range", "round_amount_fraction between 0 and 1"),
        ("flag_matches_signals", "signal_count = size(rule_ids) and is_flagged = (signal_count > 0)"),
    ),
)
LIFECYCLE_EVENTS = Contract(
    "lifecycle_events",
    _fields("event_id:string session:string run_id:string txid:string event_type:string event_time:timestamp source_sequence:bigint? replacement_txid:string? source_message_id:string"),
    "event_id",
    "event_time",
    True,
    (
        ("txid_format", rf"txid rlike '{TXID}'".replace("\\", "\\\\")),
        ("event_type_known", "event_type in ('added', 'removed', 'mined', 'replaced')"),
        ("replacement_txid_format", rf"replacement_txid is null or replacement_txid rlike '{TXID}'".replace("\\", "\\\\")),
    ),
)
CAPTURE_SESSIONS = Contract(
    "capture_sessions",
    _fields(
        "session:string run_id:string? source_url:string? started_at:timestamp ended_at:timestamp? elapsed_seconds:double stop_reason:string messages_saved:bigint connection_errors:bigint recorded_gaps:bigint"
        " recorded_gap_seconds:double events_added:bigint events_removed:bigint events_mined:bigint events_replaced:bigint"
    ),
    "session",
    "started_at",
    False,
    (("counts_nonnegative", "least(messages_saved, connection_errors, recorded_gaps) >= 0 and elapsed_seconds >= 0 and recorded_gap_seconds >= 0"),),
)
CONTRACTS = {c.name: c for c in (TRANSACTIONS, LIFECYCLE_EVENTS, CAPTURE_SESSIONS)}

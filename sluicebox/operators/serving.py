"""The serving tables: merge of new rows, projection of states, rebuild and swap, and the reads of the API."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.marts import last_first, status_of
from ..session import hadoop_path, read_small, write_atomically

SCORE_KEY = ["session", "txid", "feature_set_version", "ruleset_version"]
SCORE_CONTENT = ["n_in", "n_out", "value_out_sat", "fee_sat", "vsize", "fee_rate_sat_vb", "max_equal_output_count", "round_amount_fraction", "rbf_signaled", "signal_count", "is_flagged"]


# ---------------------------------------------------------------- merge

def classify_existing(staged: DataFrame, stored: DataFrame, key: list[str] = SCORE_KEY, content: list[str] = SCORE_CONTENT) -> DataFrame:
    """n_new, n_duplicate, n_conflict of staged rows (repetitions within the batch count once) against a table."""
    a = staged.select(*key, F.struct(*content).alias("a")).dropDuplicates(key + ["a"]).groupBy(*key).agg(F.min("a").alias("a"))
    b = stored.select(*key, F.struct(*content).alias("b")).groupBy(*key).agg(F.min("b").alias("b"))
    both = a.join(b, key, "left")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count_if(F.col("b").isNull()).alias("n_new"), F.count_if(F.col("b").isNotNull() & same).alias("n_duplicate"), F.count_if(F.col("b").isNotNull() & ~same).alias("n_conflict"))


def insert_absent(staged: DataFrame, stored: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows to append: one of each key that the table lacks (the least by `order`); stored rows are never changed."""
    from .first_wins import kept

    return kept(staged, key, order).join(stored.select(*key), key, "left_anti")


def seen_times(*observed: DataFrame) -> DataFrame:
    """txid, first_seen_at, last_seen_at over tables of (txid, t). Merging is the same again, over the result's ends."""
    rows = observed[0].select("txid", "t")
    for other in observed[1:]:
        rows = rows.unionByName(other.select("txid", "t"))
    return rows.where("txid is not null").groupBy("txid").agg(F.min("t").alias("first_seen_at"), F.max("t").alias("last_seen_at"))


def merge_seen(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The table of seen_times with a batch merged in: least first, greatest last."""
    ends = table.select("txid", F.explode(F.array("first_seen_at", "last_seen_at")).alias("t"))
    return seen_times(ends, batch)


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("txid").agg(F.min_by("event_type", last_first()).alias("k")).select("txid", status_of(F.col("k")).alias("status"))


def status_changes(table: DataFrame, events: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """txid, old_status, status where the projected status differs from the table's. touched: only these txids (semi join)."""
    if touched is not None:
        events = events.join(touched.select("txid").distinct(), "txid", "left_semi")
    joined = table.join(latest_status(events), "txid")
    return joined.where(~F.col("lifecycle_status").eqNullSafe(F.col("status"))).select("txid", F.col("lifecycle_status").alias("old_status"), "status")


def rebuilt_transactions(events: DataFrame, scores: DataFrame) -> DataFrame:
    """txid, first_seen_at, last_seen_at, lifecycle_status from all evidence."""
    seen = seen_times(events.select("txid", F.col("event_time").alias("t")), scores.select("txid", F.col("received_at").alias("t")))
    out = seen.join(latest_status(events), "txid", "left")
    return out.select("txid", "first_seen_at", "last_seen_at", F.coalesce("status", F.lit("observed_unconfirmed")).alias("lifecycle_status"))


class Versions:
    """A table as numbered directories and a pointer; readers follow the pointer, a rebuild switches it in one rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int | None:
        fs, p = hadoop_path(self.spark, f"{self.root}/pointers")
        if not fs.exists(p):
            return None
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(f) for f in found if f.isdigit()), default=None)

    def swap_in(self, tables: dict[str, DataFrame]) -> int:
        """Write every table of a new version, then the pointer. A failure before that leaves the old version in place."""
        last = self.current()
        version = 0 if last is None else last + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        write_atomically(self.spark, f"{self.root}/pointers/{version}", json.dumps(sorted(tables)))
        return version

    def tables(self) -> list[str]:
        return json.loads(read_small(self.spark, f"{self.root}/pointers/{self.current()}"))

    def read(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"nothing was built in {self.root}")
        return self.spark.read.parquet(f"{self.root}/v{version}/{name}")


# ---------------------------------------------------------------- reads of the API

def encode_cursor(received_at: datetime, score_id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([received_at.isoformat(), score_id]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    try:
        at, score_id = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return datetime.fromisoformat(at), score_id
    except Exception as error:
        raise ValueError("not a cursor of this list") from error


def alerts(scores: DataFrame, limit: int = 50, since: datetime | Column | None = None, detector: str | None = None, after: tuple | None = None, id_column: str = "event_id") -> DataFrame:
    """Flagged scores, newest first; one page and one row more, by TakeOrderedAndProject. after: the last (time, id) seen."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    rows = scores.where("is_flagged")
    if since is not None:
        rows = rows.where(F.col("received_at") >= (since if isinstance(since, Column) else F.lit(since)))
    if detector is not None:
        rows = rows.where(F.col("ruleset_version") == detector)
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col("received_at") < at) | (F.col("received_at") == at) & (F.col(id_column) < last))
    return rows.orderBy(F.desc("received_at"), F.desc(id_column)).limit(limit + 1)


def alerts_page(scores: DataFrame, limit: int = 50, cursor: str | None = None, id_column: str = "event_id", **filters) -> dict:
    """{alerts, next_cursor}: a page as the API gives it."""
    rows = alerts(scores, limit, after=decode_cursor(cursor) if cursor else None, id_column=id_column, **filters).collect()
    page = rows[:limit]
    more = encode_cursor(page[-1]["received_at"], page[-1][id_column]) if len(rows) > limit else None
    return {"alerts": [r.asDict() for r in page], "next_cursor": more}


def transaction_history(events: DataFrame, txid: str | Column) -> DataFrame:
    """The events of one transaction, in order; the predicate reaches the scan."""
    return events.where(F.col("txid") == txid).orderBy("event_time", "event_id")


def model_inventory(scores: DataFrame) -> DataFrame:
    return scores.groupBy("ruleset_version", "feature_set_version").agg(F.count("*").alias("scores"), F.count_if("is_flagged").alias("flagged"), F.max("received_at").alias("latest_received_at"))


def pipeline_status(transactions: DataFrame, scores: DataFrame, events: DataFrame) -> DataFrame:
    """One row: a single aggregation per table."""
    t = transactions.agg(F.count("*").alias("transactions"))
    s = scores.agg(F.count("*").alias("scores"), F.count_if("is_flagged").alias("flagged"), F.max("received_at").alias("latest_score_received_at"))
    e = events.agg(F.count("*").alias("lifecycle_events"), F.max("event_time").alias("latest_event_time"))
    return t.crossJoin(s).crossJoin(e)

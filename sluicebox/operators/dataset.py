"""Chronological dataset splits of whole sessions, with a checksummed manifest."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRACTIONS = (0.6, 0.2, 0.2)
SPLITS = ("train", "calibration", "test")


def session_summary(transactions: DataFrame) -> DataFrame:
    """One row per session: rows, flagged, first and last time, versions, and a checksum of its rows in no order."""
    return transactions.groupBy("session").agg(
        F.count("*").alias("n_rows"),
        F.count_if("is_flagged").alias("n_flagged"),
        F.min("received_at").alias("first_received_at"),
        F.max("received_at").alias("last_received_at"),
        F.array_sort(F.collect_set("source_mode")).alias("source_modes"),
        F.array_sort(F.collect_set("feature_set_version")).alias("feature_set_versions"),
        F.array_sort(F.collect_set("ruleset_version")).alias("ruleset_versions"),
        F.sum(F.xxhash64("txid", "event_id").cast("decimal(38,0)")).cast("string").alias("checksum"),
    )


def eligibility(summary: DataFrame, min_rows: int, source_mode: str = "ws") -> DataFrame:
    """summary with reason: null for usable sessions, else the first reason against."""
    reason = (
        F.when((F.size("source_modes") != 1) | (F.col("source_modes")[0] != source_mode), F.lit("not live"))
        .when(F.size("feature_set_versions") != 1, F.lit("mixed feature versions"))
        .when(F.size("ruleset_versions") != 1, F.lit("mixed rulesets"))
        .when(F.col("n_rows") < min_rows, F.lit("too few rows"))
    )
    return summary.withColumn("reason", reason)


def choose_cuts(counts: list[int], fractions: tuple[float, float, float] = FRACTIONS) -> tuple[int, int]:
    """(i, j): sessions before i train, before j calibrate, the rest test; shares closest to the fractions, ties earlier.

    With the first cut given, the miss of the other two shares is a convex function of the rows before the second: it
    falls up to the nearer of the two places that suit one share each, is level between them and rises behind. So the
    best second cut is next to that place, and bisection over the prefix sums finds it. All of it is whole numbers.
    """
    n = len(counts)
    if n < 3:
        raise ValueError("three sessions at least are needed for three splits")
    ends = [0, *itertools.accumulate(counts)]
    exact = [Fraction(str(f)) for f in fractions]
    unit = math.lcm(*[f.denominator for f in exact])
    total = ends[-1]
    train, calibrate, test = (int(f * unit) * total for f in exact)
    best: tuple[int, int, int] | None = None
    for i in range(1, n - 1):
        suits = min(unit * ends[i] + calibrate, unit * total - test)
        near = bisect.bisect_left(ends, suits, i + 1, n - 1, key=lambda rows: unit * rows)
        for j in {near, max(i + 1, bisect.bisect_left(ends, ends[near - 1]))}:
            sizes = unit * ends[i], unit * (ends[j] - ends[i]), unit * (total - ends[j])
            miss = sum(abs(size - wish) for size, wish in zip(sizes, (train, calibrate, test), strict=True))
            best = min(best or (miss, i, j), (miss, i, j))
    return best[1], best[2]


def manifest(transactions: DataFrame, min_rows: int = 1, fractions: tuple[float, float, float] = FRACTIONS) -> dict:
    """The splits as a small document, one entry per session, with an id that follows from its content."""
    rows = eligibility(session_summary(transactions), min_rows).orderBy("first_received_at", "session").toLocalIterator()
    sessions, left_out = [], []
    for r in rows:
        d = r.asDict()
        d["first_received_at"], d["last_received_at"] = str(d["first_received_at"]), str(d["last_received_at"])
        (left_out if d.pop("reason") else sessions).append(d | ({"reason": r.reason} if r.reason else {}))
    i, j = choose_cuts([s["n_rows"] for s in sessions], fractions)
    for at, s in enumerate(sessions):
        s["split"] = SPLITS[(at >= i) + (at >= j)]
    body = {"schema_version": 1, "fractions": list(fractions), "sessions": sessions, "left_out": left_out}
    return body | {"manifest_id": content_id(body)}


def content_id(body: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in body.items() if k != "manifest_id"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def verify(document: dict, transactions: DataFrame) -> list[str]:
    """What no longer holds: the document's own id, and each session's rows and checksum."""
    wrong = [] if document.get("manifest_id") == content_id(document) else ["the manifest was changed after it was made"]
    now = {r.session: r for r in session_summary(transactions).select("session", "n_rows", "checksum").toLocalIterator()}
    for s in document["sessions"]:
        if s["session"] not in now or (now[s["session"]].n_rows, now[s["session"]].checksum) != (s["n_rows"], s["checksum"]):
            wrong.append(f"{s['session']}: its rows are not those of the manifest")
    return wrong


def split_frame(spark, document: dict) -> DataFrame:
    """session, session_order, split of a manifest."""
    rows = [(s["session"], k, s["split"]) for k, s in enumerate(document["sessions"])]
    return spark.createDataFrame(rows, "session string, session_order int, split string")


def split_rows(transactions: DataFrame, splits: DataFrame) -> DataFrame:
    """The first observation of each txid over all splits, with its split: filter by split afterwards, never before."""
    ordered = transactions.join(splits, "session")
    rest = [c for c in ordered.columns if c not in ("txid", "session_order", "received_at")]
    first = ordered.where("txid is not null").groupBy("txid").agg(F.min(F.struct("session_order", "received_at", *rest)).alias("m"))
    return first.select("txid", "m.*")


def repeated_across_sessions(transactions: DataFrame, splits: DataFrame) -> DataFrame:
    """session, n_repeated: txids of a session that an earlier session has, too."""
    pairs = transactions.where("txid is not null").join(splits, "session").select("txid", "session", "session_order").distinct()
    first = pairs.groupBy("txid").agg(F.min("session_order").alias("first_order"))
    return pairs.join(first, "txid").groupBy("session").agg(F.count_if(F.col("session_order") > F.col("first_order")).alias("n_repeated"))


def split_hours(sessions: DataFrame, splits: DataFrame) -> DataFrame:
    """split_name, hours: null where any of its sessions has no known length."""
    joined = splits.join(sessions.select("session", "elapsed_seconds"), "session", "left")
    known = F.bool_and(F.col("elapsed_seconds").isNotNull())
    return joined.groupBy("split_name").agg(F.when(known, F.sum("elapsed_seconds") / 3600.0).alias("hours"))

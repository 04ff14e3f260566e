"""Filling in what messages lack from a lookup table, or from a rate-limited service."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill(rows: DataFrame, lookup: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """rows with null fields taken from a lookup table (one row per key; the least of several); what is there stays."""
    found = lookup.groupBy(key).agg(F.min(F.struct(*fields)).alias("__l"))
    joined = rows.join(found, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.col(f"__l.{f}")) for f in fields}).drop("__l")


def decisions(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """rows with decision: complete (nothing to ask for), ask, or skip (no key)."""
    missing = None
    for f in fields:
        m = F.col(f).isNull()
        missing = m if missing is None else missing | m
    return rows.withColumn("decision", F.when(~missing, "complete").when(F.col(key).isNull(), "skip").otherwise("ask"))


def lookup_with_budget(wanted: DataFrame, key: str, fetch: Callable[[str], dict | None], schema: str, max_requests: int) -> DataFrame:
    """key and the fields fetched for at most max_requests different keys, asked one after the other.

    A budget of requests holds for the whole run, so this is a loop on the driver by nature; its length is the budget.
    The keys come in their order, so a rerun asks for the same ones.
    """
    spark = wanted.sparkSession
    keys = [r[0] for r in wanted.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key).limit(max_requests).collect()]
    rows = []
    names = [f.strip().split()[0] for f in schema.split(",")]
    for k in keys:
        try:
            got = fetch(k)
        except Exception:  # a failed request leaves its row as it is
            got = None
        if got:
            rows.append((k, *[got.get(n) for n in names]))
    return spark.createDataFrame(rows, f"{key} string, {schema}")

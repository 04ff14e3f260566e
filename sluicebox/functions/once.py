"""Evaluate an expensive expression once per row, however often it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, behind a generator of one row: the optimizer merges projections, and with them copies
    expressions into each place that uses them, but not across a generator."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(packed).alias("__once")).select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[F.col(f"__once.{n}").alias(n) for n in columns])

"""Data tests as queries: the rows returned are the failures, so no row means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their counts. Keys with a null are not compared."""
    some = df.dropna(subset=list(keys))
    return some.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """column, n_null of the columns that have nulls; one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns])).alias("x"))
    return long.select("x.*").where("n_null > 0")


def accepted_values(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Other values (null is no value), with their counts."""
    other = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
    return other.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def relationship(df: DataFrame, column: str, to: DataFrame, to_column: str) -> DataFrame:
    """Values without a counterpart, with their counts: aggregated before the anti join, so a hot value is one row of it."""
    held = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return held.join(to.select(F.col(to_column).alias("value")), "value", "left_anti")


def failing(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition that must never hold does (null: doesn't)."""
    return df.where(condition)


def freshness(df: DataFrame, column: str, now: Column, warn_after_hours: float) -> DataFrame:
    """latest, hours_old, is_stale: one row."""
    last = df.agg(F.max(column).alias("latest"))
    age = (F.unix_micros(now) - F.unix_micros("latest")) / F.lit(3_600_000_000.0)
    return last.select("latest", age.alias("hours_old"), (F.coalesce(age, F.lit(float("inf"))) > warn_after_hours).alias("is_stale"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side: the acceptance check of two ways to one table."""
    columns = left.columns
    a = left.exceptAll(right.select(*columns)).withColumn("side", F.lit("left"))
    b = right.select(*columns).exceptAll(left).withColumn("side", F.lit("right"))
    return a.unionByName(b)

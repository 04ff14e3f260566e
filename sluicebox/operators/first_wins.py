"""First row wins: one helper for every place where rows repeat a key.

What differs from place to place is given as parameters: the scope and key, the order that says which row came first
(explicit, as a shuffle keeps none), and the content by which a later row is a duplicate or a conflict. All of it is
one aggregation per key (min_by over the order), joined back only if the losing rows are wanted.

Defined results: a null key is kept as it is (`unkeyed`) and never compared; ties of the order are broken by content;
two empty contents are equal; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """A hash of the columns in which null differs from any value."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def canonical_json_hash(c: Column) -> Column:
    """A hash of JSON text whatever the order of its keys and its white space; of other text, the hash of the text.

    Numbers are compared as JSON numbers without their spelling: 1.0 is 1.
    """
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(c)), c), 256)


def classified(df: DataFrame, keys: list[str], order: list[str], content: Column) -> DataFrame:
    """df with verdict: kept, duplicate (same content as the kept row), conflict (other content) or unkeyed."""
    rows = df.withColumn("__h", content)
    keyed = None
    for k in keys:
        keyed = F.col(k).isNotNull() if keyed is None else keyed & F.col(k).isNotNull()
    marked = rows.withColumn("__o", F.struct(*order, "__h"))
    first = marked.where(keyed).groupBy(*keys).agg(F.min("__o").alias("__first"))
    joined = marked.join(first, keys, "left")
    # Rows alike in order and content are told apart by nothing; all but one of them are duplicates.
    same = F.col("__o") == F.col("__first")
    verdict = F.when(F.col("__first").isNull(), "unkeyed").when(same, "kept").when(F.col("__h") == F.col("__first")["__h"], "duplicate").otherwise("conflict")
    return joined.withColumn("verdict", verdict).drop("__h", "__o", "__first")


def summary(df: DataFrame, keys: list[str], order: list[str], content: Column) -> DataFrame:
    """n_kept, n_duplicate, n_conflict: one row, by one aggregation; nothing is joined.

    Each key's kept row has the least order; rows of its content beyond that one are duplicates, all others conflicts.
    """
    rows = df.dropna(subset=keys).withColumn("__h", content)
    by_content = rows.groupBy(*keys, "__h").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("o"))
    by_key = by_content.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct("o", "__h", "n")).alias("first"))
    return by_key.agg(
        F.count("*").alias("n_kept"),
        F.coalesce(F.sum(F.col("first.n") - 1), F.lit(0)).alias("n_duplicate"),
        F.coalesce(F.sum(F.col("n") - F.col("first.n")), F.lit(0)).alias("n_conflict"),
    )


def kept(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in the columns of df. Rows with a null key are left out."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[F.col(c) for c in order], F.struct(*rest).alias("row"))
    first = df.dropna(subset=keys).groupBy(*keys).agg(F.min(ordered).alias("m"))
    return first.select(*keys, "m.row.*").select(*df.columns)


def first_time(df: DataFrame, key: str, time: str) -> DataFrame:
    """key, first time of each."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(time).alias(time))


def conflicting_keys(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Keys that stand with more than one content: fatal where an archive must be consistent."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(content).alias("n_contents")).where("n_contents > 1")

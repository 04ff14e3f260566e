"""Differences between two copies of a table (problem 3).

Both sides are brought to one row per key in the shuffle that the join needs anyway (the aggregation is combined map
side, so a row repeated a million times travels once), then joined by a null-safe full outer join on the key; each
joined row is compared column by column into an array of (field, left value, right value). No column is compared twice
and nothing but the key decides the partition, so both sides are shuffled once each.

Defined results: null keys match null keys; null differs from any value; doubles differ beyond a tolerance, NaN equals
NaN; timestamps are cut to the grain; arrays are compared as sets, null like empty; two empty tables give no rows;
columns that one side lacks are reported once per table by `schema_difference`, not per row. Repetitions of a row count
once; several rows of one key on a side that differ otherwise are reported as a difference of their own (`several_rows`,
with the number of rows on each side), and the smallest of them (in column order) is compared. Whether rows of a key
differ is told by a 64-bit hash of their columns and by the range of each double, so no more than that is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import clean_id


def schema_difference(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, left type, right type) of each column that the two don't share with one type."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return [(c, a.get(c), b.get(c)) for c in sorted({*a, *b}) if a.get(c) != b.get(c)]


def normalised(c: Column, kind: T.DataType, grain: str, ids: bool) -> Column:
    """The form of a value in which equal ones are equal."""
    if isinstance(kind, T.TimestampType):
        return F.date_trunc(grain, c)
    if isinstance(kind, T.ArrayType):
        return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast(kind))))
    return clean_id(c) if ids else c


def diff(left: DataFrame, right: DataFrame, keys: list[str], ids: tuple[str, ...] = (), tolerance: float = 1e-6, grain: str = "millisecond", names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """keys, side (null, or the name of the only side that has the row), and differences ARRAY<STRUCT<field, left_value, right_value>>.

    ids: columns compared (and, if keys, returned) as cleaned ids. Rows without any difference are left out.
    """
    kinds = {f.name: f.dataType for f in left.schema.fields}
    shared = [c for c in left.columns if c in right.columns and c not in keys]

    doubles = [i for i, c in enumerate(shared) if isinstance(kinds[c], (T.DoubleType, T.FloatType))]

    def side(df: DataFrame, name: str) -> DataFrame:
        # One struct holds the key: it is never null itself and its null fields equal each other, so a plain equality
        # of structs is the null-safe match, and the join needs no partitioning beyond that of the aggregation.
        key = F.struct(*[(clean_id(F.col(f"`{k}`")) if k in ids else F.col(f"`{k}`")).alias(f"k{i}") for i, k in enumerate(keys)])
        values = [normalised(F.col(f"`{c}`"), kinds[c], grain, c in ids).alias(f"v{i}") for i, c in enumerate(shared)]
        one = df.select(key.alias(f"k{name}"), F.struct(F.lit(True).alias("here"), *values).alias("row"))
        exact = F.xxhash64(*[F.col(f"row.v{i}").isNull() if i in doubles else F.col(f"row.v{i}") for i in range(len(shared))], F.lit(0))
        ranges = [f(F.col(f"row.v{i}")).alias(f"{how}{i}") for i in doubles for how, f in (("least", F.min), ("most", F.max))]
        rows = one.groupBy(f"k{name}").agg(F.min("row").alias(name), F.count("*").alias(f"n{name}"), F.min(exact).alias("h0"), F.max(exact).alias("h1"), *ranges)
        several = F.col("h0") != F.col("h1")
        for i in doubles:
            low, high = F.col(f"least{i}"), F.col(f"most{i}")
            several = several | F.coalesce(~F.isnan(low) & (F.isnan(high) | (high - low > tolerance)), F.lit(False))
        return rows.select(f"k{name}", name, F.when(several, F.col(f"n{name}")).alias(f"s{name}"))

    joined = side(left, "l").join(side(right, "r"), F.col("kl") == F.col("kr"), "full_outer")

    def change(i: int, c: str) -> Column:
        a, b = F.col(f"l.v{i}"), F.col(f"r.v{i}")
        same = a.eqNullSafe(b)
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            same = same | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        return F.when(~same, F.struct(F.lit(c).alias("field"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value")))

    only = F.when(F.col("r").isNull(), F.lit(names[0])).when(F.col("l").isNull(), F.lit(names[1]))
    changes = F.array_compact(F.array(*[change(i, c) for i, c in enumerate(shared)])) if shared else F.array().cast("array<struct<field:string,left_value:string,right_value:string>>")
    text = lambda c: F.coalesce(F.col(c), F.lit(1)).cast("string")
    several = F.when(F.col("sl").isNotNull() | F.col("sr").isNotNull(), F.array(F.struct(F.lit("several_rows").alias("field"), text("sl").alias("left_value"), text("sr").alias("right_value"))))
    none = F.array().cast("array<struct<field:string,left_value:string,right_value:string>>")
    out = joined.select(
        *[F.coalesce("kl", "kr")[f"k{i}"].alias(k) for i, k in enumerate(keys)],
        only.alias("side"),
        F.concat(F.when(only.isNull(), changes).otherwise(none), F.coalesce(several, none)).alias("differences"),
    )
    return out.where("side is not null or size(differences) > 0")


def findings(differences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field_name: one row for each differing field, or only_in_<side>."""
    only = F.when(F.col("side").isNotNull(), F.array(F.concat(F.lit("only_in_"), F.col("side")))).otherwise(F.array().cast("array<string>"))
    fields = F.concat(only, F.transform("differences", lambda d: d["field"]))
    return differences.select(*keys, F.explode(fields).alias("field_name"))


def summary(differences: DataFrame, keys: list[str]) -> DataFrame:
    """field_name, n_rows: how often each field differs."""
    return findings(differences, keys).groupBy("field_name").agg(F.count("*").alias("n_rows"))

"""The quality gate: rows as JSON (VARIANT) in, typed rows and quarantined rows with their reasons out.

Every column is checked against its contract by its type as written; only rows without a type error are put to the row
checks; only rows that passed all of that compete for their key, and the first of them (in a given order) is the one
written. All of it is columns and one aggregation by key; the report is one more.

A whole number beyond 64 bits is a type error here. Times need a zone and are cut to milliseconds.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Contract, Field
from ..functions.ids import iso_instant
from ..functions.once import once
from ..session import forget, hadoop_path, stored, write_atomically
from .normalise import kind_from, kind_of, member

_WANTED = {"string": ("string",), "bigint": ("integer",), "int": ("integer",), "double": ("integer", "decimal", "huge"), "boolean": ("boolean",), "timestamp": ("string",), "array<string>": ("list",)}


def _written_as(s: Column) -> Column:
    return F.when(s == "BOOLEAN", F.lit("boolean")).when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), F.when(s.rlike(r"^DECIMAL\(\d+,0\)$"), F.lit("huge")).otherwise(F.lit("decimal"))).otherwise(kind_from(s))


def _typed(v: Column, written: Column, f: Field) -> Column:
    """The value in its type; null where it is missing or not of that type."""
    right = written.isin(*_WANTED[f.kind])
    if f.kind == "timestamp":
        value = F.date_trunc("millisecond", iso_instant(F.try_variant_get(v, "$", "string")))
    elif f.kind == "array<string>":
        items = F.try_variant_get(v, "$", "array<variant>")
        value = F.when(F.forall(items, lambda x: F.coalesce(kind_of(x) == "string", F.lit(False))), F.try_variant_get(v, "$", "array<string>"))
    elif f.kind == "int":
        value = F.try_variant_get(v, "$", "bigint").try_cast("int")
    else:
        value = F.try_variant_get(v, "$", f.kind)
    return F.when(right, value)


def checked(rows: DataFrame, contract: Contract, row: str = "row", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """typed STRUCT, failures ARRAY<STRING> (codes, empty for a good row), and row and order as they came."""
    if {f.name for f in contract.fields} & set(rows.columns):
        raise ValueError("columns beside the row must not be named like columns of the contract")
    absent = lambda f: F.coalesce(F.col(f"__w.{f.name}"), F.lit("null_value")) == "null_value"
    out = once(rows.select(row, *order), **{row: F.col(row)})
    out = once(out, __m=F.struct(*[member(F.col(row), f"$.{f.name}").alias(f.name) for f in contract.fields]))
    v = lambda f: F.col(f"__m.{f.name}")
    out = once(out, __s=F.struct(*[F.schema_of_variant(v(f)).alias(f.name) for f in contract.fields]))
    out = once(out, __w=F.struct(*[_written_as(F.col(f"__s.{f.name}")).alias(f.name) for f in contract.fields]))
    out = once(out, typed=F.struct(*[_typed(v(f), F.col(f"__w.{f.name}"), f).alias(f.name) for f in contract.fields]))
    codes = []
    for f in contract.fields:
        wrong = F.col(f"typed.{f.name}").isNull()
        codes.append(F.when(wrong & ~absent(f) if f.nullable else wrong, F.lit(f"type:{f.name}")))
    flat = once(out, types=F.array_compact(F.array(*codes))).select("*", "typed.*")
    checks = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(text), F.lit(False)), F.lit(f"check:{name}")) for name, text in contract.checks]))
    flat = once(flat, failures=F.when(F.size("types") > 0, F.col("types")).otherwise(checks))
    return flat.select(row, *order, "typed", "failures")


def with_duplicates(rows: DataFrame, contract: Contract, order: tuple[str, ...] = ("ord",), scope: tuple[str, ...] = ()) -> DataFrame:
    """The same with duplicate_key added to all passing rows of a key but its first. scope: columns within which keys compete."""
    key = F.when(F.size("failures") == 0, F.col(f"typed.{contract.key}"))
    # Rows without a key find nothing in the join; a salt keeps them from meeting in one task.
    keyed = rows.withColumn("__k", key).withColumn("__s", F.when(F.col("__k").isNull(), F.pmod(F.xxhash64(*order), F.lit(4096))).otherwise(F.lit(0)))
    first = keyed.where("__k is not null").groupBy("__k", "__s", *scope).agg(F.min(F.struct(*order)).alias("__f"))
    joined = keyed.join(first, ["__k", "__s", *scope], "left")
    later = F.col("__f").isNotNull() & (F.struct(*order) > F.col("__f"))
    return joined.withColumn("failures", F.when(later, F.array(F.lit("duplicate_key"))).otherwise(F.col("failures"))).drop("__k", "__s", "__f")


def validate(rows: DataFrame, contract: Contract, order: tuple[str, ...] = ("ord",), scope: tuple[str, ...] = (), row: str = "row") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, quarantined, failed checks): typed rows; row as JSON with its errors; check and n."""
    done = with_duplicates(checked(rows, contract, row, (*order, *scope)), contract, order, scope)
    good = done.where(F.size("failures") == 0).select("typed.*")
    bad = done.where(F.size("failures") > 0).select(F.to_json(row).alias("row"), F.col("failures").alias("errors"))
    failed = done.select(F.explode("failures").alias("check")).groupBy("check").agg(F.count("*").alias("n"))
    return good, bad, failed


def write_lake(spark: SparkSession, rows: DataFrame, contract: Contract, lake: str, unit: str, order: tuple[str, ...] = ("ord",), scope: tuple[str, ...] = (), row: str = "row") -> dict:
    """One unit of work (a session, a micro-batch) through the gate into the lake; writing it again replaces it.

    Layout: <lake>/<table>/unit=<unit>/dt=.../hour=... Only this unit's directories are replaced, so other units are
    never touched; readers see the partition columns as before and `unit` beside them. The report is written last: it
    marks the unit as whole. The gated rows are kept once and read for good rows, quarantine and counts.
    """
    done = stored(with_duplicates(checked(rows, contract, row, (*order, *scope)), contract, order, scope).select(F.to_json(row).alias("row"), "typed", "failures"), "gate")
    good = done.where(F.size("failures") == 0).select("typed.*").withColumns(contract.partition())
    parts = list(contract.partition())
    path, quarantine, report_path = f"{lake}/{contract.name}/unit={unit}", f"{lake}/_quarantine/{contract.name}/unit={unit}", f"{lake}/_quality/{contract.name}/{unit}.json"
    for p in (report_path, quarantine):
        fs, target = hadoop_path(spark, p)
        fs.delete(target, True)
    # Rebalanced, not repartitioned: an hour that holds very much is split over several tasks and files.
    spread = good.hint("rebalance", *parts).sortWithinPartitions(*parts, contract.time, contract.key)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy(*parts).parquet(path)
    counts = done.agg(F.count("*").alias("n_in"), F.count_if(F.size("failures") == 0).alias("n_good")).first()
    failed = {r.check: r.n for r in done.select(F.explode("failures").alias("check")).groupBy("check").agg(F.count("*").alias("n")).collect()}  # a row per kind of check
    if counts.n_in > counts.n_good:
        done.where(F.size("failures") > 0).select("row", F.col("failures").alias("errors")).write.mode("overwrite").json(quarantine)
    report = {"table": contract.name, "unit": unit, "rows_in": counts.n_in, "rows_written": counts.n_good, "rows_quarantined": counts.n_in - counts.n_good, "failed_checks": dict(sorted(failed.items()))}
    write_atomically(spark, report_path, json.dumps(report, sort_keys=True))
    forget(done)
    return report


def read_lake(spark: SparkSession, lake: str, contract: Contract, unit: str | None = None) -> DataFrame:
    """A lake table with its own types for partition columns; columns that older files lack are null. unit: that one only."""
    from pyspark.sql import types as T

    schema = T.StructType([*contract.read_schema.fields, T.StructField("unit", T.StringType())])
    return spark.read.schema(schema).option("basePath", f"{lake}/{contract.name}").parquet(f"{lake}/{contract.name}" + (f"/unit={unit}" if unit else ""))

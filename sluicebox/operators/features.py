"""Transaction features, by native expressions over VARIANT: rejected with a reason, never filled in.

A feature row needs lists vin and vout that are not empty and hold objects only, no coinbase input, whole numbers for
weight (at least 1), fee and every output's value (at least 0). The first rule broken is the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..functions.rounding import round6

FEATURE_SET_VERSION = "transaction-v2"
#: Outputs of a multiple of this are round. Fixed value.
ROUND_UNIT_SAT = 100_000
#: Input sequences below this signal replaceability. Fixed values.
RBF_BELOW = 0xFFFFFFFE
SEQUENCE_MAX = 0xFFFFFFFF
FEATURES = ("n_in", "n_out", "value_out_sat", "fee_sat", "vsize", "fee_rate_sat_vb", "max_equal_output_count", "round_amount_fraction", "rbf_signaled")


def whole(v: Column) -> Column:
    """The BIGINT of a variant that is an integer as written; null for 3.0, "3", true or what doesn't fit."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _list(tx: Column, name: str) -> Column:
    return F.try_variant_get(tx, f"$.{name}", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _truthy(v: Column) -> Column:
    """Not null, false, 0, or empty."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    empty = kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>") | text.isin("false", "0", "", "0.0", "-0", "[]", "{}")
    return F.coalesce(v.isNotNull() & ~empty, F.lit(False))


def reason(tx: Column) -> Column:
    """Null for a usable transaction, else what is wrong with it first."""
    vin, vout = _list(tx, "vin"), _list(tx, "vout")
    weight, fee = whole(F.try_variant_get(tx, "$.weight", "variant")), whole(F.try_variant_get(tx, "$.fee", "variant"))
    out = F.when(~_is_object(tx), F.lit("transaction is no object"))
    for name, items in (("vin", vin), ("vout", vout)):
        out = out.when(items.isNull() | (F.size(items) == 0), F.lit(f"{name} must be a list with entries"))
        out = out.when(~F.forall(items, _is_object), F.lit(f"{name} entries must be objects"))
    out = out.when(F.exists(vin, lambda i: _truthy(F.try_variant_get(i, "$.is_coinbase", "variant"))), F.lit("coinbase"))
    out = out.when(F.coalesce(weight, F.lit(0)) < 1, F.lit("weight must be an integer of 1 or more"))
    out = out.when(F.coalesce(fee, F.lit(-1)) < 0, F.lit("fee must be an integer of 0 or more"))
    value = lambda o: F.coalesce(whole(F.try_variant_get(o, "$.value", "variant")), F.lit(-1))
    return out.when(F.exists(vout, lambda o: value(o) < 0), F.lit("output value must be an integer of 0 or more"))


def most_equal(values: Column) -> Column:
    """The greatest multiplicity in an array: runs of the sorted array, so a transaction of very many outputs takes n log n."""
    runs = F.aggregate(
        F.array_sort(values),
        F.struct(F.lit(None).cast("bigint").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("m")),
        lambda s, x: F.struct(
            x.alias("v"),
            F.when(s["v"] == x, s["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.greatest(s["m"], F.when(s["v"] == x, s["n"] + 1).otherwise(F.lit(1))).alias("m"),
        ),
    )
    return runs["m"]


def replaceable(sequences: Column) -> Column:
    """True if any valid sequence signals it, false if all are valid and none does, else unknown (null)."""
    valid = lambda s: s.isNotNull() & s.between(0, SEQUENCE_MAX)
    signals = F.exists(sequences, lambda s: F.coalesce(valid(s) & (s < RBF_BELOW), F.lit(False)))
    return F.when(signals, F.lit(True)).when(F.forall(sequences, lambda s: F.coalesce(valid(s), F.lit(False))), F.lit(False))


def with_features(df: DataFrame, values: Column, sequences: Column, weight: Column, fee: Column, into: str = "features") -> DataFrame:
    """df with the features as a STRUCT, from typed parts: output values, input sequences (null: none or invalid), weight
    and fee. Null values give a null struct."""
    out = once(df, __v=values, __s=sequences, __w=weight.cast("bigint"), __f=fee.cast("bigint"))
    out = once(out, __p=F.filter("__v", lambda x: x > 0), __z=F.floor((F.col("__w") + 3) / 4).cast("bigint"))
    share = F.size(F.filter("__p", lambda x: x % ROUND_UNIT_SAT == 0)) / F.nullif(F.size("__p"), F.lit(0))
    out = once(out, __rate=F.try_divide(F.col("__f"), F.col("__z")), __share=F.coalesce(share, F.lit(0.0)))
    made = {
        "n_in": F.size("__s"),
        "n_out": F.size("__v"),
        "value_out_sat": F.aggregate("__v", F.lit(0).cast("bigint"), lambda a, x: a + x),
        "fee_sat": F.col("__f"),
        "vsize": F.col("__z").cast("int"),
        "fee_rate_sat_vb": round6(F.col("__rate")),
        "max_equal_output_count": most_equal(F.col("__p")),
        "round_amount_fraction": round6(F.col("__share")),
        "rbf_signaled": replaceable(F.col("__s")),
    }
    whole_struct = F.struct(*[made[n].alias(n) for n in FEATURES])
    return out.withColumn(into, F.when(F.col("__v").isNotNull(), whole_struct)).drop("__v", "__s", "__w", "__f", "__p", "__z", "__rate", "__share")


def extract(df: DataFrame, tx: str = "entry") -> DataFrame:
    """df with `features` (STRUCT, null if rejected) and `reason` (null if not)."""
    v = F.col(tx)
    parts = once(df, reason=reason(v))
    fine = F.col("reason").isNull()
    values = F.when(fine, F.transform(_list(v, "vout"), lambda o: whole(F.try_variant_get(o, "$.value", "variant"))))
    sequences = F.when(fine, F.transform(_list(v, "vin"), lambda i: whole(F.try_variant_get(i, "$.sequence", "variant"))))
    number = lambda name: F.when(fine, whole(F.try_variant_get(v, f"$.{name}", "variant")))
    return with_features(parts, values, sequences, number("weight"), number("fee"))

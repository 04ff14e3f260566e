"""Screening rules: predicates over features that add named signals, in a fixed order, with a readable explanation."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULESET_VERSION = "structural-rules-v1"


@dataclass(frozen=True)
class Thresholds:
    many_outputs_min: int = 10
    many_outputs_max_inputs: int = 2
    many_inputs_min: int = 10
    many_inputs_max_outputs: int = 2
    repeated_value_min: int = 3
    repeated_value_min_inputs: int = 3

    def __post_init__(self):
        for name, value in asdict(self).items():
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a whole number above 0")


def signals(n_in: Column, n_out: Column, repeated: Column, t: Thresholds | dict[str, Column] = Thresholds()) -> Column:
    """ARRAY<STRUCT<rule_id, explanation>>, empty where no rule fires. t: constants, or columns of a sweep."""
    v = {k: F.lit(x) for k, x in asdict(t).items()} if isinstance(t, Thresholds) else t
    s = lambda c: c.cast("string")
    fan_out = (n_in <= v["many_outputs_max_inputs"]) & (n_out >= v["many_outputs_min"])
    fan_in = (n_in >= v["many_inputs_min"]) & (n_out <= v["many_inputs_max_outputs"])
    same = (n_in >= v["repeated_value_min_inputs"]) & (repeated >= v["repeated_value_min"])
    made = [
        (fan_out, "many_outputs", F.concat(s(n_out), F.lit(" outputs are paid from "), s(n_in), F.lit(" input(s); the rule starts at "), s(v["many_outputs_min"]), F.lit(" outputs."))),
        (fan_in, "many_inputs", F.concat(s(n_in), F.lit(" inputs go to "), s(n_out), F.lit(" output(s); the rule starts at "), s(v["many_inputs_min"]), F.lit(" inputs."))),
        (same, "repeated_output_values", F.concat(s(repeated), F.lit(" outputs have one value, paid from "), s(n_in), F.lit(" inputs; ordinary payments can look so, too."))),
    ]
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule_id"), e.alias("explanation"))) for c, n, e in made]))


def feature_error(prefix: str = "") -> Column:
    """Null for a feature row that can be screened, else why not."""
    c = lambda n: F.col(f"{prefix}{n}")
    out = None
    for name in ("n_in", "n_out", "value_out_sat", "fee_sat", "vsize", "max_equal_output_count"):
        bad = c(name).isNull() | (c(name) < 0)
        text = F.lit(f"{name} must be a whole number, 0 or more")
        out = F.when(bad, text) if out is None else out.when(bad, text)
    for name in ("fee_rate_sat_vb", "round_amount_fraction"):
        x = c(name)
        out = out.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0), F.lit(f"{name} must be finite, 0 or more"))
    out = out.when((c("n_in") < 1) | (c("n_out") < 1) | (c("vsize") < 1), F.lit("counts must be above 0"))
    return out.when((c("max_equal_output_count") > c("n_out")) | (c("round_amount_fraction") > 1), F.lit("features contradict each other"))


def screen(df: DataFrame, t: Thresholds = Thresholds(), prefix: str = "") -> DataFrame:
    """df with signals, rule_ids, signal_count, is_flagged, ruleset_version, and error (then the others are null)."""
    c = lambda n: F.col(f"{prefix}{n}")
    out = df.withColumn("error", feature_error(prefix))
    out = out.withColumn("signals", F.when(F.col("error").isNull(), signals(c("n_in"), c("n_out"), c("max_equal_output_count"), t)))
    return out.withColumns(
        {
            "rule_ids": F.transform("signals", lambda s: s["rule_id"]),
            "signal_count": F.when(F.col("error").isNull(), F.size("signals")),
            "is_flagged": F.when(F.col("error").isNull(), F.size("signals") > 0),
            "ruleset_version": F.lit(RULESET_VERSION),
        }
    )


def disagreements(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Rows whose stored rule ids are not those of their own features: must be none before they are served."""
    again = F.transform(signals(F.col("n_in"), F.col("n_out"), F.col("max_equal_output_count"), t), lambda s: s["rule_id"])
    return df.withColumn("derived_rule_ids", again).where(~F.col("derived_rule_ids").eqNullSafe(F.col("rule_ids")))


# ---------------------------------------------------------------- the lab: scenarios against thresholds

#: name, kind, n_in, n_out, max_equal_output_count, expected rules: small scenarios at the edges of the rules.
SCENARIOS = (
    ("payment", "ordinary", 1, 2, 1, ()),
    ("fan_out_below", "edge", 2, 9, 1, ()),
    ("fan_out_at", "edge", 2, 10, 1, ("many_outputs",)),
    ("fan_out_more_inputs", "edge", 3, 10, 1, ()),
    ("fan_in_below", "edge", 9, 2, 1, ()),
    ("fan_in_at", "edge", 10, 2, 1, ("many_inputs",)),
    ("equal_below", "edge", 3, 4, 2, ()),
    ("equal_at", "edge", 3, 4, 3, ("repeated_output_values",)),
)


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s[:5], list(s[5])) for s in SCENARIOS], "scenario string, kind string, n_in int, n_out int, max_equal_output_count int, expected array<string>")


def lab(spark: SparkSession, t: Thresholds = Thresholds()) -> DataFrame:
    """scenario, expected, rule_ids, passed."""
    cases = scenarios(spark)
    got = F.transform(signals(F.col("n_in"), F.col("n_out"), F.col("max_equal_output_count"), t), lambda s: s["rule_id"])
    return cases.select("scenario", "kind", "expected", got.alias("rule_ids"), F.array_sort(got).eqNullSafe(F.array_sort("expected")).alias("passed"))


def threshold_sweep(spark: SparkSession, values: dict[str, tuple[int, ...]] | None = None, base: Thresholds = Thresholds()) -> DataFrame:
    """Each scenario under each single changed threshold: threshold, value, scenario, is_flagged, changed (against base)."""
    values = values or {"many_outputs_min": (5, 10, 20), "many_inputs_min": (5, 10, 20)}
    rows = []
    for name, options in values.items():
        for x in options:
            rows.append((name, x, *(asdict(base) | {name: x}).values()))
    grid = spark.createDataFrame(rows, "threshold string, value int, " + ", ".join(f"{n} int" for n in asdict(base)))
    both = scenarios(spark).crossJoin(F.broadcast(grid))  # both are short literals
    own = {n: F.col(n) for n in asdict(base)}
    flagged = F.size(signals(F.col("n_in"), F.col("n_out"), F.col("max_equal_output_count"), own)) > 0
    plain = F.size(signals(F.col("n_in"), F.col("n_out"), F.col("max_equal_output_count"), base)) > 0
    return both.select("threshold", "value", "scenario", flagged.alias("is_flagged"), (flagged != plain).alias("changed"))

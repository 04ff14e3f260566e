"""Calibration and comparison of scores: budgets, agreement, percentiles of three definitions, tail positions.

Whatever needs a rank in the whole table is computed from counts of distinct values, not by a window without a
partition: values are counted first (combined map side), ranked within ranges, and ranges are offset by a small table
of totals, so no task sees all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def cumulative(counts: DataFrame, value: str, n: str = "n", parts: int | None = None) -> DataFrame:
    """counts with `below` (rows of smaller values) and `total`: prefix sums over range partitions and their offsets."""
    spark = counts.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(counts.repartitionByRange(parts, value).withColumn("__p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__p").agg(F.sum(n).alias("__s"))  # a row per partition
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__p", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__o"), F.sum("__s").over(Window.partitionBy()).alias("total"))
    inner = Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "__p").withColumn("below", F.col("__o") + F.coalesce(F.sum(n).over(inner), F.lit(0))).drop("__p", "__o")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def budget_threshold(scores: DataFrame, per_thousand: float, score: str = "score") -> DataFrame:
    """threshold, target_flags, actual_flags: flag what is greater than the value at rank k (from 0) of the falling order.

    k = floor(per_thousand / 1000 * n); ties at the threshold are not flagged, so actual_flags may be below k. No row if
    the budget flags nothing.
    """
    if not 0 < per_thousand < 1000:
        raise ValueError("the budget must be between 0 and 1000 per 1,000")
    ranks = cumulative(value_counts(scores, score), "value")
    above = F.col("total") - F.col("below") - F.col("n")
    k = F.floor(F.lit(per_thousand / 1000) * F.col("total"))
    at = ranks.where((k >= 1) & (above <= k) & (k < above + F.col("n")))
    return at.select(F.col("value").alias("threshold"), k.alias("target_flags"), above.alias("actual_flags"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """both, a_only, b_only, neither and jaccard (null if neither flags anything)."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    counts = df.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))
    union = F.col("both") + F.col("a_only") + F.col("b_only")
    return counts.withColumn("jaccard", F.round(F.try_divide(F.col("both").cast("double"), union.cast("double")), 4))


def alert_rates(df: DataFrame, flag: str, hours: DataFrame) -> DataFrame:
    """flagged, per_1000, per_hour (null where any session's length is unknown). hours: one row, column hours."""
    one = df.agg(F.count_if(flag).alias("flagged"), F.count("*").alias("n")).crossJoin(hours)
    return one.select("flagged", F.round(F.try_divide(F.lit(1000.0) * F.col("flagged"), "n"), 2).alias("per_1000"), F.round(F.try_divide(F.col("flagged").cast("double"), "hours"), 1).alias("per_hour"))


def percentiles(df: DataFrame, value: str, points: tuple[float, ...]) -> DataFrame:
    """point, value: linear between neighbours (exact), from counts of distinct values. Nulls don't count; no row without any value."""
    return quantile_grids(df, (value,), points).select("point", "value")


def nearest_rank(df: DataFrame, value: str, points: tuple[float, ...]) -> DataFrame:
    """point, value: the element at floor(point * n) of the rising order (from 0), the last for point 1."""
    ranks = cumulative(value_counts(df, value), "value")
    wanted = F.explode(F.array(*map(F.lit, points))).alias("point")
    at = ranks.select("value", "n", "below", "total", wanted).withColumn("k", F.least(F.col("total") - 1, F.floor(F.col("point") * F.col("total"))))
    return at.where((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("n"))).select("point", "value")


def quantile_grids(df: DataFrame, names: tuple[str, ...], points: tuple[float, ...]) -> DataFrame:
    """feature, point, value: as percentiles, of each named column, from counts of distinct values. Nulls don't count."""
    parts = []
    for name in names:
        ranks = cumulative(value_counts(df, name), "value").select(F.lit(name).alias("feature"), F.col("value").cast("double"), "n", "below", "total")
        inside = lambda p, f: f(p * (F.col("total") - 1)).between(F.col("below"), F.col("below") + F.col("n") - 1)
        # Only the points that a value is an end of stand beside it.
        parts.append(ranks.select("*", F.explode(F.filter(F.array(*map(F.lit, points)), lambda p: inside(p, F.floor) | inside(p, F.ceil))).alias("point")))
    k = F.col("point") * (F.col("total") - 1)
    at = reduce(DataFrame.unionByName, parts).withColumns({"low": F.floor(k), "high": F.ceil(k), "share": k - F.floor(k)})
    holds = lambda i: (F.col("below") <= F.col(i)) & (F.col(i) < F.col("below") + F.col("n"))
    ends = at.where(holds("low") | holds("high")).groupBy("feature", "point").agg(
        F.max(F.when(holds("low"), F.col("value"))).alias("a"), F.max(F.when(holds("high"), F.col("value"))).alias("b"), F.max("share").alias("share")
    )
    return ends.select("feature", "point", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def tail_positions(rows: DataFrame, reference: DataFrame, key: str, features: tuple[str, ...], limit: int = 3) -> DataFrame:
    """key, feature, training_percentile, extremeness: the features of each row that lie furthest in a reference's tails.

    The percentile is the middle of the value's rank, (less + half of equal) / n. Reference values are counted; a row's
    value takes its rank from the nearest counted value below it, found by a window over the union of the two within
    range partitions of (feature, value); what stood last in the partitions before is carried over, a row per partition.
    A value that very many rows hold is joined back with its rows by a broadcast of bounded size or by a split join.
    """
    spark = rows.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = []
    for name in features:
        ref = value_counts(reference, name)
        ranks = cumulative(ref, "value").select(F.lit(name).alias("feature"), "value", "n", "below", "total")
        parts.append(ranks)
    ranks = stored(reduce(DataFrame.unionByName, parts), "tail-ranks")
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(key, "x.*").where("value is not null")
    asked = long.select("feature", "value").distinct()
    marks = asked.select("feature", F.col("value").cast("double"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("below"), F.lit(None).cast("bigint").alias("total"), F.lit(1).alias("asked"))
    known = ranks.select("feature", F.col("value").cast("double"), "n", "below", "total", F.lit(0).alias("asked"))
    both = stored(known.unionByName(marks).repartitionByRange(width, "feature", "value").withColumn("p", F.spark_partition_id()), "tail-both")
    held = F.when(F.col("asked") == 0, F.struct("value", "n", "below", "total"))
    inner = Window.partitionBy("p", "feature").orderBy("value", "asked").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy("feature", "p").agg(F.max(held).alias("end"))  # a row per feature and partition
    before = Window.partitionBy("feature").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("feature", "p", F.last("end", ignorenulls=True).over(before).alias("carried"))
    totals = ranks.groupBy("feature").agg(F.max("total").alias("total"))
    at = F.coalesce(F.last(held, ignorenulls=True).over(inner), F.col("carried"))
    placed = both.join(F.broadcast(carried), ["feature", "p"]).withColumn("at", at).where("asked = 1").select("feature", "value", "at")
    equal = F.col("at.value") == F.col("value")
    rank = F.when(F.col("at").isNull(), F.lit(0.0)).when(equal, F.col("at.below") + 0.5 * F.col("at.n")).otherwise((F.col("at.below") + F.col("at.n")).cast("double"))
    placed = placed.join(F.broadcast(totals), "feature").withColumn("p", rank / F.col("total"))
    found = long.join(placed.select("feature", "value", "p"), ["feature", "value"])
    found = found.withColumns({"training_percentile": F.round("p", 4), "extremeness": F.round(F.abs(F.col("p") - 0.5) * 2, 4)})
    best = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.negative("extremeness").alias("e"), "feature", "training_percentile", "extremeness"))).alias("a"))
    return best.select(key, F.explode(F.slice("a", 1, limit)).alias("x")).select(key, "x.feature", "x.training_percentile", "x.extremeness")


def ecdf(rows: DataFrame, value: str, reference: DataFrame, reference_value: str) -> DataFrame:
    """rows with ecdf: the share of reference values not greater than the row's."""
    ref = cumulative(value_counts(reference, reference_value), "value").select("value", (F.col("below") + F.col("n")).alias("upto"), "total", F.lit(0).alias("asked"))
    ref = stored(ref, "ecdf")
    asked = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct().select("value", F.lit(None).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("total"), F.lit(1).alias("asked"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = stored(ref.unionByName(asked).repartitionByRange(parts, "value").withColumn("p", F.spark_partition_id()), "ecdf-both")
    top = both.groupBy("p").agg(F.max("upto").alias("m"))
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = top.select("p", F.coalesce(F.max("m").over(w), F.lit(0)).alias("carried"))
    inner = Window.partitionBy("p").orderBy("value", "asked").rowsBetween(Window.unboundedPreceding, 0)
    total = ref.agg(F.max("total").alias("all"))
    placed = both.join(F.broadcast(carried), "p").withColumn("u", F.greatest(F.coalesce(F.max("upto").over(inner), F.lit(0)), "carried")).where("asked = 1")
    share = placed.crossJoin(F.broadcast(total)).select(F.col("value").alias(value), F.try_divide(F.col("u").cast("double"), F.col("all")).alias("ecdf"))
    return rows.join(share, value, "left")

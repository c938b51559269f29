"""Percentiles of very large columns by merging centroid digests (problem 5).

A digest of a group is a list of centroids (mean, weight) of its sorted values. Which centroid a value joins depends on
the quantile of its place: the size function k(q) = compression / (2 pi) * asin(2 q - 1) makes clusters small at the
ends and at most 2 / compression * n * sqrt(q (1 - q)) * pi wide in the middle. Digests merge by clustering
their centroids again, so those of single days or files can be combined in any order.

Building sorts only within (group, part): parts are days or hashes, so a hot group is many parts. Every step is a
window or an aggregation in the JVM. A second pass over the values counts, for every reported percentile, how
many values lie below and not above it: the certified rank error is the distance of the wanted rank from
that interval.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.runtime import broadcast_if_small, checkpoint

COMPRESSION = 400  #: a centroid in the middle holds at most 2 pi / 800 = 0.8 % of the values
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def size_function(q: Column, compression: int) -> Column:
    return F.lit(compression / (2 * pi)) * F.asin(F.lit(2.0) * F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)) - 1)


def cluster(points: DataFrame, keys: Sequence[str], compression: int = COMPRESSION) -> DataFrame:
    """keys + (mean, weight, low, high): points (keys, mean, weight, low, high) clustered within each key."""
    order = Window.partitionBy(*keys).orderBy("mean", "low", "high", "weight")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    placed = points.withColumn("_b", before).withColumn("_t", total)
    start = size_function(F.col("_b") / F.col("_t"), compression)
    return (
        placed.withColumn("_k", F.floor(start)).groupBy(*keys, "_k")
        .agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("_k")
    )


def points_of(df: DataFrame, keys: Sequence[str], value: str, part: Column) -> DataFrame:
    """keys + part + (mean, weight, low, high): equal values of a part counted together, nulls and NaN left out."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, part.alias("part"), v.alias("mean")).where(F.col("mean").isNotNull() & ~F.isnan("mean"))
    return rows.groupBy(*keys, "part", "mean").agg(F.count("*").alias("weight")).select("*", F.col("mean").alias("low"), F.col("mean").alias("high"))


def pack(centroids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One digest per key: keys + (n, low, high, centroids array<struct<mean, weight, low, high>>, sorted)."""
    return centroids.groupBy(*keys).agg(
        F.sum("weight").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sort_array(F.collect_list(F.struct("mean", "weight", "low", "high"))).alias("centroids"),  # at most the compression's number
    )


def build(df: DataFrame, keys: Sequence[str], value: str, part: Column, compression: int = COMPRESSION) -> DataFrame:
    """Digests by key and part, in the form that merge() combines."""
    return pack(cluster(points_of(df, keys, value, part), [*keys, "part"], compression), [*keys, "part"])


#: Parts of a key that are merged first, each in its own task, when digests of many days or files are combined.
FAN = 16


def merge(digests: DataFrame, keys: Sequence[str], compression: int = COMPRESSION) -> DataFrame:
    """Digests combined by key: any digests of the same keys, of days, files or earlier merges.

    In two steps: the digests of a key are dealt to FAN merges by their contents, then these are merged, so that a key
    with many digests is not sorted by one task.
    """
    dealt = digests.select(*keys, F.pmod(F.xxhash64("n", "low", "high", *(["part"] if "part" in digests.columns else [])), F.lit(FAN)).alias("_f"), F.explode("centroids").alias("x"))
    first = cluster(dealt.select(*keys, "_f", "x.*"), [*keys, "_f"], compression)
    return pack(cluster(first.drop("_f"), keys, compression), keys)


def percentile(q: float) -> Column:
    """The value at quantile q of a digest: of the first centroid that reaches rank ceil(q n).

    Inside a centroid the value moves from its lowest to its highest with the rank; a centroid of equal values is exact.
    """
    rank = F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("value"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["weight"]
        inside = F.when(x["weight"] > 1, (rank - acc["seen"] - 1) / (x["weight"] - 1)).otherwise(F.lit(0.0))
        value = F.coalesce(acc["value"], F.when(seen >= rank, F.when(x["low"] == x["high"], x["low"]).otherwise(x["low"] + (x["high"] - x["low"]) * inside)))
        return F.struct(seen.alias("seen"), value.alias("value"))

    return F.aggregate("centroids", start, step, lambda acc: acc["value"])


def certified_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES,
    part: Column | None = None, bound: float = 0.01, compression: int = COMPRESSION,
) -> DataFrame:
    """keys + (quantile, value, n, rank_error, certified): percentiles with the error that a second pass counted.

    rank_error is |wanted rank - nearest rank of the value| / n, where a value between two others has the ranks of
    both; certified says that it is at most `bound`. Null and NaN values are left out, groups without any other do not
    come out; null keys are equal to each other. Ties are one point; one value is every percentile. Empty table:
    no rows. Extra columns are ignored.
    """
    part = F.pmod(F.xxhash64(F.col(value), *[F.col(k) for k in keys]), F.lit(64)) if part is None else part
    safe = [f"_g{i}" for i in range(len(keys))]
    named = df.select(*[F.col(k).alias(s) for k, s in zip(keys, safe)], F.col(value).alias("_v"), part.alias("_p"))
    digests = merge(build(named, safe, "_v", F.col("_p"), compression), safe, compression)
    # one row per group, written once: the second pass broadcasts it if it is small; a larger one is joined by
    # shuffle, where adaptive execution splits the values of a hot group
    estimates = broadcast_if_small(checkpoint(digests.select(*safe, "n", *[percentile(q).alias(f"_q{i}") for i, q in enumerate(quantiles)])), 50_000)
    values = named.select(*safe, F.col("_v").cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = values.groupBy(*safe, "_v").agg(F.count("*").alias("_c"))
    tests = [F.col(f"values.{s}").eqNullSafe(F.col(f"estimates.{s}")) for s in safe]
    joined = counted.alias("values").join(estimates.alias("estimates"), tests).select(*[F.col(f"estimates.{s}").alias(s) for s in safe], "n", "_v", "_c", *[f"_q{i}" for i in range(len(quantiles))])
    sums = [F.sum(F.when(F.col("_v") < F.col(f"_q{i}"), F.col("_c")).otherwise(0)).alias(f"_lt{i}") for i in range(len(quantiles))]
    sums += [F.sum(F.when(F.col("_v") <= F.col(f"_q{i}"), F.col("_c")).otherwise(0)).alias(f"_le{i}") for i in range(len(quantiles))]
    ranks = joined.groupBy(*safe, "n", *[f"_q{i}" for i in range(len(quantiles))]).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"_q{i}").alias("value"), F.col(f"_lt{i}").alias("lt"), F.col(f"_le{i}").alias("le")) for i, q in enumerate(quantiles)]))
    out = ranks.select(*[F.col(s).alias(k) for s, k in zip(safe, keys)], "n", each.alias("_x")).select(*keys, "n", "_x.*")
    rank = F.greatest(F.ceil(F.col("quantile") * F.col("n")), F.lit(1))
    # a value of the column has the ranks lt + 1 to le; one between two values has those of both, lt and lt + 1
    lowest = F.when(F.col("le") > F.col("lt"), F.col("lt") + 1).otherwise(F.greatest(F.col("lt"), F.lit(1)))
    highest = F.when(F.col("le") > F.col("lt"), F.col("le")).otherwise(F.least(F.col("lt") + 1, F.col("n")))
    error = F.greatest(lowest - rank, rank - highest, F.lit(0)) / F.col("n")
    return out.select(*keys, "quantile", "value", "n", error.alias("rank_error"), (error <= bound).alias("certified"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """keys + (quantile, value, n): the values of rank ceil(q n) themselves, of groups of any size.

    Equal values are counted together and sorted in ranges of (keys, value). The ranges' sums tell which range holds a
    wanted rank, and only those ranges are counted through, so that no task sorts a hot group. Nulls, NaN, null keys,
    ties, empty tables and extra columns as in certified_percentiles.
    """
    safe = [f"_g{i}" for i in range(len(keys))]
    values = df.select(*[F.col(k).alias(s) for k, s in zip(keys, safe)], F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = values.groupBy(*safe, "_v").agg(F.count("*").alias("_c"))
    ordered = checkpoint(counted.repartitionByRange(*safe, "_v").withColumn("_range", F.spark_partition_id()))
    ranges = ordered.groupBy(*safe, "_range").agg(F.sum("_c").alias("_m"))
    so_far = Window.partitionBy(*safe).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.withColumn("_upto", F.sum("_m").over(so_far)).withColumn("n", F.sum("_m").over(Window.partitionBy(*safe)))
    each = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.greatest(F.ceil(F.lit(float(q)) * F.col("n")), F.lit(1)).alias("rank")) for q in quantiles])
    held = placed.withColumn("_want", F.filter(each, lambda x: (x["rank"] > F.col("_upto") - F.col("_m")) & (x["rank"] <= F.col("_upto")))).where(F.size("_want") > 0)
    tests = [F.col(f"ordered.{s}").eqNullSafe(F.col(f"held.{s}")) for s in safe]
    joined = ordered.alias("ordered").join(held.alias("held"), [*tests, F.col("ordered._range") == F.col("held._range")])
    within = Window.partitionBy(*safe, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = joined.select(*[f"ordered.{s}" for s in safe], "ordered._range", "_v", "_c", "n", "_want", (F.col("_upto") - F.col("_m")).alias("_before"))
    counts = counts.withColumn("_le", F.col("_before") + F.sum("_c").over(within))
    hit = F.filter("_want", lambda x: (x["rank"] > F.col("_le") - F.col("_c")) & (x["rank"] <= F.col("_le")))
    return counts.select(*[F.col(s).alias(k) for s, k in zip(safe, keys)], "n", "_v", F.explode(hit).alias("_x")).select(*keys, F.col("_x.quantile").alias("quantile"), F.col("_v").alias("value"), "n")

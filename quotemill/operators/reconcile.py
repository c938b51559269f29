"""One comparable fare per flight from the quotes of several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.cleaning import IDENTITY, with_identity

POLICIES = ("MIN", "DIRECT", "MEAN", "MEDIAN")


def reconcile(df: DataFrame, policy: str = "MIN", more_keys: Sequence[str] = (), direct: str = "is_direct") -> DataFrame:
    """Per flight: reconciled_fare, selected_observation_id, selected_source_id, all_quotes_count, sources_represented.

    MIN takes the cheapest quote; DIRECT the cheapest of those marked `direct`, else the cheapest; MEAN the mean fare
    (half even) with the first quote; MEDIAN the median fare with the quote nearest to it. Ties: lowest id. Everything
    but the median combines before the shuffle.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    rows = with_identity(df)
    keys = [*more_keys, *IDENTITY]
    quote = F.struct(F.col("total_fare").alias("fare"), F.col("observation_id").alias("id"), F.col("data_source_id").alias("source"))
    order = {
        "MIN": F.struct("total_fare", "observation_id"), "DIRECT": F.struct((~F.coalesce(F.col(direct), F.lit(False))).alias("d"), "total_fare", "observation_id"), "MEAN": F.struct("observation_id"),
    }
    common = [F.count("*").alias("all_quotes_count"), F.sort_array(F.collect_set("data_source_id")).alias("sources_represented")]
    if policy != "MEDIAN":
        picked = rows.groupBy(*keys).agg(F.min_by(quote, order[policy]).alias("_p"), F.avg("total_fare").alias("_m"), *common)
        fare = F.bround(F.col("_m"), 2) if policy == "MEAN" else F.col("_p.fare")
        return picked.select(*keys, fare.cast("decimal(10,2)").alias("reconciled_fare"), F.col("_p.id").alias("selected_observation_id"), F.col("_p.source").alias("selected_source_id"), "all_quotes_count", "sources_represented")
    # in whole cents: the mean of two of them is exact, and so is its rounding
    packed = rows.groupBy(*keys).agg(F.median((F.col("total_fare") * 100).cast("bigint")).alias("_m"), *common)
    fare = (F.bround(F.col("_m"), 0).cast("decimal(12,0)") / 100).cast("decimal(10,2)")
    named = packed.select(*[F.col(k).alias(f"_{k}") for k in keys], fare.alias("reconciled_fare"), "all_quotes_count", "sources_represented")
    near = rows.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return near.groupBy(*keys, "reconciled_fare", "all_quotes_count", "sources_represented").agg(
        F.min_by(quote, F.struct(F.abs(F.col("total_fare") - F.col("reconciled_fare")), F.col("observation_id"))).alias("_p")
    ).select(*keys, "reconciled_fare", F.col("_p.id").alias("selected_observation_id"), F.col("_p.source").alias("selected_source_id"), "all_quotes_count", "sources_represented")

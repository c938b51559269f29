"""Validation, duplicates and outliers. Rows are flagged, never dropped."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.text import blank

STATUSES = ("VALID", "MISSING", "INVALID_FARE", "SOLD_OUT", "DUPLICATE", "OUTLIER", "SCRAPE_ERROR", "CANCELLED")
READING = ("run_id", "data_source_id", "fingerprint_hash")
COHORT = ("route_id", "travel_date", "window_id", "cabin_class")
IDENTITY = ("airline_id", "flight", "route_id", "travel_date", "scheduled_departure_time", "cabin")


@dataclass(frozen=True)
class OutlierSettings:
    method: str = "IQR"  #: or MAD
    iqr_factor: float = 1.5
    mad_factor: float = 3.0
    least: int = 5  #: smaller cohorts have no outliers
    relative: float = 0.10  #: tolerance around the median of a cohort without dispersion
    absolute: float = 500.0


def validity(fare: str = "total_fare") -> Column:
    """struct(status, reason): the first rule a row breaks. The fare may be a text."""
    value = F.col(fare).try_cast("decimal(20,4)")
    rule = F
    for name in ("route_id", "airline_id", "window_id"):
        rule = rule.when(F.col(name).isNull() | (F.col(name) <= 0), F.struct(F.lit("MISSING").alias("status"), F.lit(name).alias("reason")))
    fail = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        rule.when(blank("flight_number"), fail("MISSING", "flight_number")).when(F.col("travel_date").isNull(), fail("MISSING", "travel_date"))
        .when(F.col("observed_at").isNull(), fail("MISSING", "observed_at")).when(blank("cabin_class"), fail("MISSING", "cabin_class"))
        .when(value.isNull(), fail("INVALID_FARE", "total_fare missing")).when(value <= 0, fail("INVALID_FARE", "total_fare not positive"))
        .when(blank("currency"), fail("INVALID_FARE", "currency")).when(F.col("is_available") == F.lit(False), fail("SOLD_OUT", "not available"))
        .otherwise(F.struct(F.lit("VALID").alias("status"), F.lit(None).cast("string").alias("reason")))
    )


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Number of a row among those of its keys, 1 for the first; nulls are equal."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def cohort_stats(df: DataFrame, cohort: Sequence[str] = COHORT, fare: str = "total_fare", cfg: OutlierSettings = OutlierSettings()) -> DataFrame:
    """Count, extremes, quartiles, median, bounds and low_dispersion of every cohort; small cohorts have no bounds."""
    x = F.col(fare).cast("double")
    out = df.groupBy(*cohort).agg(
        F.count(x).alias("count"), F.min(x).alias("min_fare"), F.max(x).alias("max_fare"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q")
    ).select(*cohort, "count", "min_fare", "max_fare", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    if cfg.method == "MAD":
        centred = df.select(*cohort, x.alias("_x")).join(out.select(*[F.col(c).alias(f"_{c}") for c in cohort], F.col("median").alias("_m")), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cohort])
        mads = centred.groupBy(*cohort).agg(F.median(F.abs(F.col("_x") - F.col("_m"))).alias("mad"))
        out = out.join(mads.select(*[F.col(c).alias(f"_{c}") for c in cohort], "mad"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cohort], "left").drop(*[f"_{c}" for c in cohort])
    elif cfg.method == "IQR":
        out = out.withColumn("mad", F.lit(None).cast("double"))
    else:
        raise ValueError(f"unknown method {cfg.method}")
    iqr = F.col("q3") - F.col("q1")
    reach = F.lit(cfg.mad_factor) * F.col("mad") / 0.6745
    around = F.greatest(F.lit(cfg.absolute), F.col("median") * cfg.relative)
    by_mad, flat = F.coalesce(F.col("mad") > 0, F.lit(False)), iqr <= 0
    enough = F.col("count") >= cfg.least
    lower = F.when(by_mad, F.col("median") - reach).when(flat, F.col("median") - around).otherwise(F.col("q1") - cfg.iqr_factor * iqr)
    upper = F.when(by_mad, F.col("median") + reach).when(flat, F.col("median") + around).otherwise(F.col("q3") + cfg.iqr_factor * iqr)
    return out.withColumns({
        "lower_bound": F.when(enough, F.greatest(lower, F.lit(0.0))), "upper_bound": F.when(enough, upper), "low_dispersion": enough & ~by_mad & flat,
    })


def with_outlier_flag(df: DataFrame, cohort: Sequence[str] = COHORT, fare: str = "total_fare", cfg: OutlierSettings = OutlierSettings()) -> DataFrame:
    """df with is_outlier: the fare lies strictly outside its cohort's bounds."""
    bounds = cohort_stats(df, cohort, fare, cfg).select(*[F.col(c).alias(f"_{c}") for c in cohort], F.col("lower_bound").alias("_lo"), F.col("upper_bound").alias("_hi"))
    x = F.col(fare).cast("double")
    joined = df.join(bounds, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cohort], "left")
    return joined.withColumn("is_outlier", F.coalesce((x < F.col("_lo")) | (x > F.col("_hi")), F.lit(False))).drop("_lo", "_hi", *[f"_{c}" for c in cohort])


def clean(df: DataFrame, order: Sequence[str] = ("observation_id",), cfg: OutlierSettings = OutlierSettings()) -> DataFrame:
    """df with quality_status and quality_reason: invalid rows first, then duplicates among the valid, then outliers among the rest."""
    checked = df.drop("quality_status", "quality_reason").withColumn("_v", validity())
    valid = F.col("_v.status") == "VALID"
    numbered = checked.withColumn("_n", F.when(valid, F.row_number().over(Window.partitionBy(valid, *READING).orderBy(*order))))
    keep = numbered.where(valid & (F.col("_n") == 1))
    bounds = cohort_stats(keep, cfg=cfg).select(*[F.col(c).alias(f"_{c}") for c in COHORT], F.col("lower_bound").alias("_lo"), F.col("upper_bound").alias("_hi"))
    x = F.col("total_fare").cast("double")
    joined = numbered.join(bounds, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in COHORT], "left")
    outside = F.coalesce((x < F.col("_lo")) | (x > F.col("_hi")), F.lit(False))
    status = F.when(~valid, F.col("_v.status")).when(F.col("_n") > 1, "DUPLICATE").when(outside, "OUTLIER").otherwise("VALID")
    reason = F.when(~valid, F.col("_v.reason")).when(F.col("_n") > 1, "loaded before in this run").when(outside, "outside the bounds of its cohort")
    return joined.withColumns({"quality_status": status, "quality_reason": reason}).drop("_v", "_n", "_lo", "_hi", *[f"_{c}" for c in COHORT])


def status_counts(df: DataFrame, column: str = "quality_status", statuses: Sequence[str] = STATUSES) -> DataFrame:
    """status, rows, percent for every status, also those that do not occur."""
    every = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = df.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    both = every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("rows"))
    return both.withColumn("percent", F.round(100 * F.col("rows") / F.greatest(F.sum("rows").over(Window.partitionBy()), F.lit(1)), 4))  # one row per status


def with_identity(df: DataFrame) -> DataFrame:
    """df with flight and cabin as they enter a flight's identity."""
    return df.withColumns({"flight": F.upper(F.trim("flight_number")), "cabin": F.upper(F.trim("cabin_class"))})


def cross_source_groups(df: DataFrame) -> DataFrame:
    """Flights that more than one source quotes: identity, quotes, sources (sorted)."""
    grouped = with_identity(df).groupBy(*IDENTITY).agg(F.count("*").alias("quotes"), F.sort_array(F.collect_set("data_source_id")).alias("sources"))
    return grouped.where(F.size("sources") > 1)

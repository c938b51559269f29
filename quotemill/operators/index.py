"""The index chain: daily summaries, relatives to a base, means over windows and routes, calendar rollups, errors.

Values are rounded half to even, weights half up.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.numbers import geometric_mean, percent_error, weighted_mean
from quotemill.functions.text import local_date
from quotemill.operators.reconcile import reconcile

ADVANCE: Mapping[int, int] = {1: 1, 2: 7, 3: 15, 4: 30, 5: 45}  #: days ahead by booking window
METRICS = {"GEOMETRIC": "geometric_mean_fare", "MEDIAN": "median_fare", "MEAN": "mean_fare", "MIN": "min_fare"}
PERIODS = {"WEEKLY": "week", "MONTHLY": "month", "YEARLY": "year"}


def target_days(advance: Mapping[int, int] = ADVANCE) -> Column:
    """Days ahead that a quote's window asks for, else its own if it is a standard one, else null."""
    table = F.create_map(*[F.lit(x) for pair in advance.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col("window_id").cast("int")), F.when(F.col("advance_days").isin(*advance.values()), F.col("advance_days")))


def usable(df: DataFrame, zone: str = "UTC", exclude_outliers: bool = True) -> DataFrame:
    """Rows fit for statistics, with observation_date: available, positive, economy, not flagged, and of the day their window means.

    A travel date is compared only if all parts of the comparison are known.
    """
    bad = ["MISSING", "INVALID_FARE", "SOLD_OUT", "DUPLICATE", "SCRAPE_ERROR", "CANCELLED"] + ["OUTLIER"] * exclude_outliers
    dated = df.withColumn("observation_date", local_date("observed_at", zone))
    expected = F.date_add("observation_date", target_days())
    return dated.where(
        F.coalesce("is_available", F.lit(False)) & (F.col("total_fare") > 0) & (F.col("cabin_class") == "ECONOMY")
        & ~F.coalesce(F.col("quality_status").isin(*bad), F.lit(False)) & F.coalesce(F.col("travel_date") == expected, F.lit(True))
    )


def daily_summary(df: DataFrame, policy: str = "MIN", metric: str = "GEOMETRIC", least: int = 3, zone: str = "UTC", digits: int = 2) -> DataFrame:
    """Per observation date, route and window: count, minimum, median, mean, geometric mean and the representative fare.

    Cohorts with several travel dates are left out. is_imputed says that there are fewer than `least` flights.
    """
    cohort = ["observation_date", "route_id", "window_id"]
    # quotes combine to flights before the first shuffle; only flights go on to their cohort
    flights = reconcile(usable(df, zone), policy, ["observation_date", "window_id"]).withColumn("x", F.col("reconciled_fare").cast("double"))
    stats = flights.groupBy(*cohort).agg(
        F.min("travel_date").alias("target_travel_date"), F.max("travel_date").alias("_last"), F.count("*").alias("observations_count"), F.min("x").alias("min_fare"),
        F.median("x").alias("median_fare"), F.avg("x").alias("mean_fare"), geometric_mean("x").alias("geometric_mean_fare"),
    ).where("target_travel_date = _last").drop("_last")
    rounded = stats.withColumns({c: F.bround(c, digits) for c in ("min_fare", "median_fare", "mean_fare", "geometric_mean_fare")})
    return rounded.select("*", F.col(METRICS.get(metric, METRICS["GEOMETRIC"])).alias("representative_fare"), (F.col("observations_count") < least).alias("is_imputed"))


def base_fares(summary: DataFrame, until: str, digits: int = 2) -> DataFrame:
    """route_id, window_id, benchmark_fare, sample_size: median representative fare of the days before `until`.

    In whole hundredths of a cent, so that the mean of two fares, and its rounding, is exact.
    """
    exact = F.median((F.col("representative_fare") * 10_000).cast("bigint"))
    median = exact / 10_000 if digits >= 4 else F.bround(exact / 10 ** (4 - digits), 0) / 10**digits
    return summary.where(F.col("observation_date") < F.lit(until).cast("date")).groupBy("route_id", "window_id").agg(
        median.alias("benchmark_fare"), F.count("*").alias("sample_size")
    )


def price_relatives(summary: DataFrame, base: DataFrame, digits: int = 6) -> DataFrame:
    """representative_fare / benchmark_fare * 100; cohorts without a positive benchmark are skipped."""
    joined = summary.join(base.where("benchmark_fare > 0").select("route_id", "window_id", "benchmark_fare"), ["route_id", "window_id"])
    return joined.select(
        F.col("observation_date").alias("index_date"), "route_id", "window_id",
        F.bround(F.col("representative_fare").cast("double") / F.col("benchmark_fare").cast("double") * 100, digits).alias("price_relative"),
    )


def route_index(relatives: DataFrame, weights: DataFrame | None = None, jevons: bool = False, digits: int = 4) -> DataFrame:
    """Mean of the windows' relatives per date and route: arithmetic, or weighted by window, or geometric."""
    rows = relatives if weights is None else relatives.join(weights.select("window_id", "weight"), "window_id")
    mean = geometric_mean("price_relative") if jevons else F.avg("price_relative") if weights is None else weighted_mean("price_relative", "weight")
    return rows.groupBy("index_date", "route_id").agg(F.bround(mean, digits).alias("index_value"), F.count("*").alias("windows_included"))


def national_index(routes: DataFrame, weights: DataFrame, digits: int = 4) -> DataFrame:
    """Weighted mean of the route indices per date, weights of the routes present made to sum to one."""
    joined = routes.join(weights.select("route_id", "weight"), "route_id")
    return joined.groupBy("index_date").agg(F.sum("weight").alias("_w"), F.bround(weighted_mean("index_value", "weight"), digits).alias("index_value"), F.count("*").alias("routes_included")).where("_w <> 0").drop("_w")


def rollup(index: DataFrame, period: str, digits: int = 4) -> DataFrame:
    """Mean index and least number of routes per week (from Monday), month or year."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period}")
    start = F.to_date(F.date_trunc(PERIODS[period], F.col("index_date")))
    return index.groupBy(start.alias("index_date")).agg(F.bround(F.avg("index_value"), digits).alias("index_value"), F.min("routes_included").alias("routes_included"), F.count("*").alias("days")).withColumn("period_type", F.lit(period))


def absolute_errors(index: DataFrame, benchmark: DataFrame, digits: int = 4) -> DataFrame:
    """Each period with its benchmark and percentage error; both null where there is no benchmark."""
    theirs = benchmark.select(F.col("period_start").alias("index_date"), F.col("benchmark").cast("double").alias("benchmark"))
    return index.select("index_date", "index_value").join(theirs, "index_date", "left").withColumn("error_percent", F.bround(percent_error(F.col("index_value"), F.col("benchmark")), digits))


def mean_absolute_error(errors: DataFrame, threshold: float = 5.0, digits: int = 4) -> DataFrame:
    """One row: periods, matched, mape (null if nothing matched) and whether it is within the threshold."""
    out = errors.agg(F.count("*").alias("periods"), F.count("error_percent").alias("matched"), F.bround(F.avg("error_percent"), digits).alias("mape"))
    return out.withColumn("passed", F.col("mape") <= threshold)


def route_weights(observations: DataFrame) -> DataFrame:
    """route_id, volume, weight: share of each route in all rows, to 8 places, half up."""
    volume = observations.groupBy("route_id").agg(F.count("*").alias("volume"))
    total = observations.agg(F.count("*").alias("total"))
    return volume.crossJoin(F.broadcast(total)).select("route_id", "volume", F.round((F.col("volume") / F.col("total")).cast("decimal(20,16)"), 8).alias("weight"))  # one row: the total

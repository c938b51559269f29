"""Checks of collection runs and coverage reports. A run is a run_id of the observations with what was announced for it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.numbers import share
from quotemill.functions.text import local_date
from quotemill.operators.index import ADVANCE

LOW_DATA = 5
CHECKS = ("count_differs", "fingerprints_repeat", "invalid_fares", "route_differs", "window_differs", "source_differs", "travel_dates_differ")
#: What a run may announce besides; null, or a table without the column, announces nothing.
TARGETS = {"route": "target_route_id", "window": "target_window_id"}


def runs_of(observations: DataFrame) -> DataFrame:
    """run_id, source_id, started_at, completed_at, records_scraped: the runs as their observations show them."""
    return observations.groupBy("run_id").agg(
        F.mode("data_source_id", deterministic=True).alias("source_id"), F.min("observed_at").alias("started_at"), F.max("created_at").alias("completed_at"),
        F.count("*").alias("records_scraped"), F.lit("COMPLETED").alias("status"),
    )


def audit_runs(runs: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per run: its counts and fares, the checks it fails, its consistency and health. One join for all runs.

    A run's observations must have its source, route and window, as far as it announces them. travel_date is the first
    one observed, else the day of the run plus the days that its window means.
    """
    runs = runs.withColumns({c: F.lit(None).cast("int") for c in TARGETS.values() if c not in runs.columns})
    facts = observations.groupBy("run_id").agg(
        F.count("*").alias("stored"), F.count_distinct(F.nullif("fingerprint_hash", F.lit(""))).alias("fingerprints"), F.count_if(F.col("total_fare").isNull() | (F.col("total_fare") <= 0)).alias("invalid_fares"),
        F.count_distinct("travel_date").alias("travel_dates"), F.min("data_source_id").alias("source_lo"), F.max("data_source_id").alias("source_hi"), *[f(f"{k}_id").alias(f"{k}_{n}") for k in TARGETS for f, n in ((F.min, "lo"), (F.max, "hi"))],
        F.min("total_fare").cast("double").alias("min_fare"), F.max("total_fare").cast("double").alias("max_fare"), F.round(F.avg(F.col("total_fare").cast("double")), 4).alias("mean_fare"), F.min("travel_date").alias("travel_date"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = runs.join(facts, "run_id", "left").withColumns({c: zero(F.col(c)) for c in ("stored", "fingerprints", "invalid_fares", "travel_dates")})
    done = F.col("status") == "COMPLETED"
    other = lambda k, target: F.coalesce((F.col(f"{k}_lo") != F.col(target)) | (F.col(f"{k}_hi") != F.col(target)), F.lit(False))
    tests = {
        "count_differs": done & (F.col("records_scraped") != F.col("stored")), "fingerprints_repeat": F.col("fingerprints") != F.col("stored"), "invalid_fares": F.col("invalid_fares") > 0,
        **{f"{k}_differs": other(k, c) for k, c in TARGETS.items()}, "source_differs": other("source", "source_id"), "travel_dates_differ": F.col("travel_dates") > 1,
    }
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    health = (
        F.when(F.col("status") == "FAILED", "FAILED").when(done & (F.col("records_scraped") == 0) & (F.col("stored") == 0), "NO_INVENTORY")
        .when(done & (F.col("stored") > 0) & (F.col("stored") < LOW_DATA), "SUCCESS_WITH_LOW_DATA").when(done & (F.col("stored") > 0), "SUCCESS").otherwise("FAILED")
    )
    days = F.element_at(F.create_map(*[F.lit(x) for pair in ADVANCE.items() for x in pair]), F.col("target_window_id").cast("int"))
    return joined.select(
        "run_id", "source_id", *TARGETS.values(), F.coalesce("travel_date", F.date_add(local_date("started_at"), days)).alias("travel_date"), "records_scraped", "stored", "fingerprints", "travel_dates", "min_fare", "max_fare", "mean_fare", F.array_join(failed, "; ").alias("notes"),
        F.when(F.size(failed) == 0, "CONSISTENT").otherwise("INCONSISTENT").alias("consistency"), health.alias("health"),
        (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")).alias("seconds"),
    )


def runs_on(runs: DataFrame, day: str, zone: str = "UTC", sources: Sequence[int] | None = None) -> DataFrame:
    """The runs that started on a local day, [start, end) as instants, so that the filter reaches the scan; of given sources, if any."""
    start, end = (F.to_utc_timestamp(F.lit(d).cast("timestamp"), zone) for d in (day, str(dt.date.fromisoformat(day) + dt.timedelta(days=1))))
    out = runs.where((F.col("started_at") >= start) & (F.col("started_at") < end))
    return out if sources is None else out.where(F.col("source_id").isin(*sources))


def with_labels(audits: DataFrame, sources: DataFrame, routes: DataFrame, windows: DataFrame) -> DataFrame:
    """audits with the codes of their source, route and window, UNKNOWN where there is none."""
    out = audits
    for rows, key, code, mine in ((sources, "source_id", "source_code", "source_id"), (routes, "route_id", "route_code", "target_route_id"), (windows, "window_id", "window_code", "target_window_id")):
        out = out.join(rows.select(F.col(key).alias(mine), code), mine, "left").withColumn(code, F.coalesce(code, F.lit("UNKNOWN")))
    return out


def durations(audits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """runs, mean, median, least and most seconds."""
    s = F.col("seconds").cast("double")
    return audits.groupBy(*keys).agg(F.count("seconds").alias("runs"), F.round(F.avg(s), 4).alias("mean"), F.median(s).alias("median"), F.min(s).alias("least"), F.max(s).alias("most"))


def source_split(observations: DataFrame, key: str, sources: DataFrame) -> DataFrame:
    """By route or window: rows of airlines' own sources and of agencies, tasks (runs) and rows per task."""
    typed = observations.join(sources.select(F.col("source_id").alias("data_source_id"), "source_type"), "data_source_id", "left")
    n = lambda kind: F.count_if(F.col("source_type") == kind)
    out = typed.groupBy(key).agg(n("AIRLINE_DIRECT").alias("direct"), n("OTA").alias("ota"), F.count("*").alias("rows"), F.count_distinct("run_id").alias("tasks"))
    return out.withColumn("rows_per_task", F.round(F.col("rows") / F.col("tasks"), 4))


def route_status(observations: DataFrame, windows: Sequence[int], least: int = 5) -> DataFrame:
    """By route: SUCCESS if each of the windows has `least` rows, PARTIAL if any has a row, else FAILED."""
    cells = [F.count_if(F.col("window_id") == w).alias(f"w{w}") for w in windows]
    out = observations.groupBy("route_id").agg(*cells)
    full = F.least(*[F.col(f"w{w}") for w in windows]) if len(windows) > 1 else F.col(f"w{windows[0]}")
    some = sum((F.col(f"w{w}") for w in windows), start=F.lit(0))
    return out.withColumn("state", F.when(full >= least, "SUCCESS").when(some > 0, "PARTIAL").otherwise("FAILED"))


def readiness(failures: Column, few: int = 5) -> Column:
    """READY without failures, READY_WITH_WARNINGS with a few, else NOT_READY."""
    return F.when(failures == 0, "READY").when(failures <= few, "READY_WITH_WARNINGS").otherwise("NOT_READY")


def batch_summary(audits: DataFrame) -> DataFrame:
    """One row: totals, rates (0 for no runs) and the mean duration."""
    count = lambda value: F.count_if(F.col("health") == value)
    totals = audits.agg(
        F.count("*").alias("runs"), (count("SUCCESS") + count("SUCCESS_WITH_LOW_DATA")).alias("successful"), count("NO_INVENTORY").alias("no_inventory"), count("FAILED").alias("failed"),
        F.count_if(F.col("consistency") == "CONSISTENT").alias("consistent"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored"), F.round(F.avg("seconds"), 4).alias("mean_seconds"),
    )
    return totals.withColumns({f"{n}_rate": F.round(100 * share(F.col(n), F.col("runs")), 4) for n in ("successful", "no_inventory", "failed", "consistent")})


def coverage(observations: DataFrame, codes: Sequence[str], windows: DataFrame) -> DataFrame:
    """Route by window: rows in each cell, their total and whether every cell has any."""
    cells = observations.join(windows.select("window_id", "window_code"), "window_id").groupBy("route_id").pivot("window_code", list(codes)).count()
    named = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("w_" + c.replace("T+", "")) for c in codes]
    wide = cells.select("route_id", *named)
    cols = ["w_" + c.replace("T+", "") for c in codes]
    return wide.withColumn("total", sum((F.col(c) for c in cols), start=F.lit(0))).withColumn("state", F.when(F.least(*cols) > 0, "COMPLETE").otherwise("PARTIAL"))


def price_delta(observations: DataFrame, keys: Sequence[str] = ("route_id", "travel_date", "airline_id", "flight_number")) -> DataFrame:
    """Flights quoted by several sources: cheapest fare of each source, then the spread between sources."""
    least = observations.where("total_fare > 0").groupBy(*keys, "data_source_id").agg(F.min("total_fare").alias("fare"))
    return least.groupBy(*keys).agg(F.count("*").alias("sources"), (F.max("fare") - F.min("fare")).cast("double").alias("delta")).where("sources > 1")


def window_premium(observations: DataFrame, near: int = 1, far: int = 2, digits: int = 4) -> DataFrame:
    """Per route: mean of the runs' mean fares in two windows and the premium of the near one in percent, 0 without a far one."""
    task = observations.where(F.col("total_fare") > 0).groupBy("route_id", "window_id", "run_id").agg(F.avg(F.col("total_fare").cast("double")).alias("fare"))
    mean = lambda w: F.avg(F.when(F.col("window_id") == w, F.col("fare")))
    both = task.groupBy("route_id").agg(mean(near).alias("near_fare"), mean(far).alias("far_fare"))
    premium = F.when(F.coalesce("far_fare", F.lit(0.0)) == 0, 0.0).otherwise((F.col("near_fare") - F.col("far_fare")) / F.col("far_fare") * 100)
    return both.select("route_id", F.round("near_fare", digits).alias("near_fare"), F.round("far_fare", digits).alias("far_fare"), F.round(premium, digits).alias("premium_percent"))


def source_rollup(observations: DataFrame) -> DataFrame:
    """Rows, flights and mean fare by source type and source, with subtotals and the grand total (null keys)."""
    return observations.rollup("source_type", "source_code").agg(F.count("*").alias("rows"), F.count_distinct("flight_number").alias("flights"), F.round(F.avg(F.col("total_fare").cast("double")), 4).alias("mean_fare"), F.grouping_id().alias("level"))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of uniqueness: the keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key, as one struct aggregation: nothing is sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def day_on_day(summary: DataFrame) -> DataFrame:
    """Change of the representative fare against the previous day that the route and window have, in percent."""
    w = Window.partitionBy("route_id", "window_id").orderBy("observation_date")
    before = F.lag("representative_fare").over(w)
    change = F.when(before != 0, (F.col("representative_fare") - before) / before * 100)
    return summary.select("route_id", "window_id", "observation_date", "representative_fare", F.round(change, 4).alias("change_percent"))


def modified_z(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """df with modified_z = 0.6745 (x - median) / MAD of its keys; null where the MAD is 0. Two aggregations, no window."""
    x = F.col(value).cast("double")
    named = lambda d, *cols: d.select(*[F.col(k).alias(f"_{k}") for k in keys], *cols)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    drop = [f"_{k}" for k in keys]
    medians = named(df.groupBy(*keys).agg(F.median(x).alias("_m")), "_m")
    centred = df.join(medians, on).drop(*drop)
    mads = named(centred.groupBy(*keys).agg(F.median(F.abs(x - F.col("_m"))).alias("_d")), "_d")
    return centred.join(mads, on).withColumn("modified_z", F.when(F.col("_d") > 0, 0.6745 * (x - F.col("_m")) / F.col("_d"))).drop("_m", "_d", *drop)


def disagreements(runs: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations whose source or time does not agree with their run; null sources of a run agree with any."""
    r = runs.select("run_id", F.col("source_id").alias("run_source"), "started_at", F.col("completed_at"))
    differs = (F.col("data_source_id") != F.col("run_source")) | (F.col("observed_at") < F.col("started_at")) | (F.col("observed_at") > F.col("completed_at"))
    return observations.join(r, "run_id").where(differs)


def representative_groups(df: DataFrame, keys: Sequence[str], members: str) -> DataFrame:
    """Sorted members of every group whose keys are all given; groups without a key are skipped."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(members)).alias("members"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of at most `most` rows; more is an error, not a truncation."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"

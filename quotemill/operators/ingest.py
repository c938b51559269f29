"""Ingestion of raw quotes: mapped to observations, resolved, without what a run has stored already; and the runs' states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions import text as X

OUTCOMES = ("INSERTED", "SKIPPED", "FAILED")


def observation(zone: str = "UTC") -> dict[str, Column]:
    """The columns of an observation that a quote gives: renamed, normal, with fee parts that quotes do not have."""
    none = F.lit(None).cast("decimal(10,2)")
    return {
        "flight_number": X.normal_flight_number("flight_number"), "travel_date": F.col("travel_date"), "observed_at": F.col("observed_at"),
        "advance_days": F.greatest(F.lit(0), F.date_diff("travel_date", X.local_date("observed_at", zone))), "scheduled_departure_time": X.parse_clock("departure_time"), "scheduled_arrival_time": X.parse_clock("arrival_time"),
        "cabin_class": F.coalesce(F.nullif(F.upper(F.trim("cabin_class")), F.lit("")), F.lit("ECONOMY")), "fare_family": F.col("fare_family"), "stops": F.col("stops"), "is_non_stop": F.coalesce(F.col("stops") == 0, F.lit(True)),
        "total_fare": F.col("total_fare"), "base_fare": none, "fuel_surcharge": none, "taxes_and_fees": none, "convenience_fee": none, "currency": F.col("currency"), "is_available": F.col("availability"),
        "quality_status": F.lit("VALID"), "fingerprint_hash": X.fingerprint(*(F.col(c) for c in ("airline", "flight_number", "origin", "destination", "travel_date", "departure_time", "cabin_class", "fare_family"))),
    }


def resolved(quotes: DataFrame, airlines: DataFrame, routes: DataFrame, codes: Mapping[str, str] | None = None) -> DataFrame:
    """quotes with airline_id and route_id, by airline code (a known alias, else the written text) or name and by route code; null if unknown.

    Plain equi-joins: the planner broadcasts the dimensions where they are small. Of several airlines that fit the least id counts.
    """
    named = airlines.select(F.explode(F.array(F.upper("airline_code"), F.upper("airline_name"))).alias("_airline"), F.col("airline_id").alias("_id")).where("_airline is not null").groupBy("_airline").agg(F.min("_id").alias("airline_id"))
    known = routes.select(F.col("route_code").alias("_route"), "route_id").groupBy("_route").agg(F.min("route_id").alias("route_id"))
    asked = quotes.withColumns({
        "_airline": F.upper(F.trim(X.mapped("airline", codes or {}))), "_route": F.concat_ws("-", F.upper(F.trim("origin")), F.upper(F.trim("destination"))),
    })
    return asked.join(named, "_airline", "left").join(known, "_route", "left").drop("_airline", "_route")


def ingest(quotes: DataFrame, runs: DataFrame, stored: DataFrame, ordinal: str = "quote_id", zone: str = "UTC") -> DataFrame:
    """quotes as observations of their run, with `outcome` and `error`.

    quotes: run_id, airline_id, route_id (null: unresolved) and the fields of a quote; runs: run_id, source_id, which is the
    source of all its observations; stored: run_id, data_source_id, fingerprint_hash of what is there. FAILED: the first
    thing that is lacking; SKIPPED: the run has stored the fingerprint, or an earlier quote of the batch (by
    `ordinal`) brings it; else INSERTED. A quote of an unknown run fails.
    """
    rest = [c for c in quotes.columns if c not in observation() and c not in ("airline_id", "route_id")]
    rows = quotes.select(*rest, "airline_id", "route_id", *[c.alias(n) for n, c in observation(zone).items()])
    rows = rows.join(runs.select("run_id", F.col("source_id").alias("data_source_id"), F.lit(True).alias("_run")), "run_id", "left")
    lacking = {"run": F.col("_run").isNull(), "airline": F.col("airline_id").isNull(), "route": F.col("route_id").isNull(), "flight_number": X.blank("flight_number"), "travel_date": F.col("travel_date").isNull(),
               "observed_at": F.col("observed_at").isNull(), "total_fare": ~F.coalesce(F.col("total_fare") > 0, F.lit(False))}
    rows = rows.withColumn("error", F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in lacking.items()])).drop("_run")
    reading = ["run_id", "data_source_id", "fingerprint_hash"]
    there = stored.select(*reading).distinct().withColumn("_there", F.lit(True))
    good = F.col("error").isNull()
    # quotes that fail do not hold back later ones
    first = F.row_number().over(Window.partitionBy(*reading, good).orderBy(ordinal))
    rows = rows.join(there, reading, "left").withColumn("_n", first)
    outcome = F.when(~good, "FAILED").when(F.col("_there").isNotNull() | (F.col("_n") > 1), "SKIPPED").otherwise("INSERTED")
    return rows.withColumn("outcome", outcome).drop("_there", "_n")


def ingest_counts(ingested: DataFrame) -> DataFrame:
    """run_id, quotes, inserted, skipped, failed and status: FAILED only if quotes failed and none was inserted."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = ingested.groupBy("run_id").agg(F.count("*").alias("quotes"), n("INSERTED").alias("inserted"), n("SKIPPED").alias("skipped"), n("FAILED").alias("failed"))
    return counts.withColumn("status", F.when((F.col("failed") > 0) & (F.col("inserted") == 0), "FAILED").otherwise("COMPLETED"))


def closed(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """runs with what their ingestion says: records_scraped grows by the inserted, status is its status; others are unchanged."""
    done = counts.select("run_id", F.col("inserted").alias("_inserted"), F.col("status").alias("_status"))
    out = runs.join(done, "run_id", "left")
    return out.withColumns({"records_scraped": F.coalesce("records_scraped", F.lit(0)) + F.coalesce("_inserted", F.lit(0)), "status": F.coalesce("_status", "status")}).drop("_inserted", "_status")


def orphans(runs: DataFrame) -> DataFrame:
    """Runs that never ended: still RUNNING."""
    return runs.where("status = 'RUNNING'")


def fail_stuck(runs: DataFrame, now: Column, most: str = "3 hours", error: str = "stuck") -> DataFrame:
    """runs in which those RUNNING for longer than `most` are FAILED, with the time and the reason."""
    stuck = F.coalesce((F.col("status") == "RUNNING") & (F.col("started_at") < now - F.expr(f"interval {most}")), F.lit(False))
    return runs.withColumns({"completed_at": F.when(stuck, now).otherwise(F.col("completed_at")), "error_summary": F.when(stuck, F.lit(error)).otherwise(F.col("error_summary")), "status": F.when(stuck, "FAILED").otherwise(F.col("status"))})


def task_states(tasks: DataFrame, runs: DataFrame, keys: Sequence[str] = ("route_id", "window_id")) -> DataFrame:
    """tasks with their latest run: run_id, status (NOT_STARTED without one), records_scraped. Runs combine before the shuffle."""
    targets = runs.select(*[F.col("target_" + k).alias(k) for k in keys], "run_id", "status", "records_scraped", "started_at")
    last = targets.groupBy(*keys).agg(F.max_by(F.struct("run_id", "status", "records_scraped"), F.struct("started_at", "run_id")).alias("_r"))
    joined = tasks.join(last, list(keys), "left")
    return joined.select(*tasks.columns, "_r.run_id", F.coalesce("_r.status", F.lit("NOT_STARTED")).alias("status"), F.coalesce("_r.records_scraped", F.lit(0)).alias("records_scraped"))


def cycle_plan(tasks: DataFrame, sources: Sequence[str], seconds: float = 2.0) -> DataFrame:
    """What a collection cycle would do, by window: tasks of all sources, and the pauses between them."""
    n = len(sources)
    return tasks.groupBy("window_code").agg((F.count("*") * n).alias("tasks"), F.count_distinct("route_id").alias("routes"), (F.count("*") * n * seconds).alias("pause_seconds"))


def first_of_page(cards: DataFrame, page: Sequence[str], keys: Sequence[str], ordinal: str) -> DataFrame:
    """The first card of each flight, departure, fare (and whatever `keys` name) of a page; nulls are equal."""
    n = F.row_number().over(Window.partitionBy(*page, *keys).orderBy(ordinal))
    return cards.withColumn("_n", n).where("_n = 1").drop("_n")

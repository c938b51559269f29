"""Queries over time series of the fare tables: problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotemill.operators.rolling import distinct_facts, rolling_totals
from quotemill.operators.spikes import implausible_readings, source_scatter
from quotemill.runtime import table

SERIES = ("data_source_id", "route_id", "window_id", "airline_id", "upper(trim(flight_number))", "cabin_class")


def p2_reasons(spark: SparkSession, root: str) -> DataFrame:
    return implausible_readings(
        table(spark, root, "fare_observations"), "observation_id", "data_source_id", "observed_at", "total_fare", SERIES
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_reasons(spark, root).select("observation_id")


def p3_rolling(spark: SparkSession, root: str) -> DataFrame:
    facts = distinct_facts(table(spark, root, "route_daily_summary"), ["route_id", "window_id", "observation_date"], "median_fare", "summary_id")
    return rolling_totals(facts, "route_id", "observation_date", "median_fare", (7, 30))


P3_SQL = """
WITH facts AS (
  SELECT route_id, window_id, observation_date, arg_min(median_fare, summary_id) FILTER (WHERE median_fare IS NOT NULL) AS fare
  FROM route_daily_summary WHERE route_id IS NOT NULL AND observation_date IS NOT NULL GROUP BY ALL),
daily AS (SELECT route_id, observation_date, sum(fare) AS s, count(fare) AS n FROM facts GROUP BY ALL),
days AS (SELECT unnest(generate_series(min(observation_date), max(observation_date), INTERVAL 1 DAY))::DATE AS observation_date FROM facts),
dense AS (
  SELECT r.route_id, d.observation_date, coalesce(s, 0)::DECIMAL(28,2) AS s, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT route_id FROM facts) r CROSS JOIN days d LEFT JOIN daily USING (route_id, observation_date))
SELECT route_id, observation_date, s AS day_total, n::BIGINT AS day_count,
  sum(s) OVER w7 AS total_7, (sum(n) OVER w7)::BIGINT AS count_7, (count(*) FILTER (WHERE n > 0) OVER w7)::BIGINT AS active_days_7,
  sum(s) OVER w30 AS total_30, (sum(n) OVER w30)::BIGINT AS count_30, (count(*) FILTER (WHERE n > 0) OVER w30)::BIGINT AS active_days_30,
  CASE WHEN sum(n) OVER w7 > 0 THEN (sum(s) OVER w7)::DOUBLE / (sum(n) OVER w7) END AS avg_7,
  CASE WHEN sum(n) OVER w30 > 0 THEN (sum(s) OVER w30)::DOUBLE / (sum(n) OVER w30) END AS avg_30
FROM dense
WINDOW w7 AS (PARTITION BY route_id ORDER BY observation_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY route_id ORDER BY observation_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
"""

QUERIES = {"p2_found": p2_found, "p2_reasons": p2_reasons, "p3_rolling": p3_rolling}
SQL = {"p3_rolling": P3_SQL}

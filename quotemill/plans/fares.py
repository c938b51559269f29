"""Queries of the fare tables' own operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import text as X
from quotemill.operators import audit, cleaning, dimensions, index, merge
from quotemill.operators.reconcile import reconcile
from quotemill.runtime import bounded_rows, broadcast_if_small, table

#: The base period of the test tables ends with June 2026.
BASE_END = "2026-07-01"
#: Days begin at midnight where the flights depart.
ZONE = "Asia/Kolkata"
#: Digits of intermediate values, so that only the last rounding shows.
FINE = 10
CODES = ("T+1", "T+7", "T+15", "T+30", "T+45")


def fares(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "fare_observations")


def with_source(spark: SparkSession, root: str) -> DataFrame:
    sources = table(spark, root, "data_sources").select(F.col("source_id").alias("data_source_id"), "source_code", "source_name", "source_type")
    return fares(spark, root).join(broadcast_if_small(sources), "data_source_id", "left").withColumn("is_direct", F.coalesce(F.upper("source_type").contains("DIRECT"), F.lit(False)))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- validation, duplicates, outliers -------------------------------------------------------------------------------

STATUS_CASE = """CASE WHEN route_id IS NULL OR route_id <= 0 OR airline_id IS NULL OR airline_id <= 0 OR window_id IS NULL OR window_id <= 0
  OR trim(coalesce(flight_number, '')) = '' OR travel_date IS NULL OR observed_at IS NULL OR trim(coalesce(cabin_class, '')) = '' THEN 'MISSING'
  WHEN total_fare IS NULL OR total_fare <= 0 OR trim(coalesce(currency, '')) = '' THEN 'INVALID_FARE'
  WHEN is_available = FALSE THEN 'SOLD_OUT' ELSE 'VALID' END"""

CLEAN_CTE = f"""
checked AS (SELECT *, {STATUS_CASE} AS s FROM fare_observations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s = 'VALID', run_id, data_source_id, fingerprint_hash ORDER BY observation_id) AS n FROM checked),
stats AS (
  SELECT route_id, travel_date, window_id, cabin_class, count(total_fare) AS c, quantile_cont(total_fare::DOUBLE, 0.25) AS q1, quantile_cont(total_fare::DOUBLE, 0.5) AS med, quantile_cont(total_fare::DOUBLE, 0.75) AS q3
  FROM numbered WHERE s = 'VALID' AND n = 1 GROUP BY ALL),
bounds AS (
  SELECT *, CASE WHEN c < 5 THEN NULL WHEN q3 - q1 <= 0 THEN greatest(med - greatest(500.0, med * 0.1), 0) ELSE greatest(q1 - 1.5 * (q3 - q1), 0) END AS lo,
    CASE WHEN c < 5 THEN NULL WHEN q3 - q1 <= 0 THEN med + greatest(500.0, med * 0.1) ELSE q3 + 1.5 * (q3 - q1) END AS hi FROM stats),
cleaned AS (
  SELECT f.*, CASE WHEN s <> 'VALID' THEN s WHEN n > 1 THEN 'DUPLICATE' WHEN total_fare < lo OR total_fare > hi THEN 'OUTLIER' ELSE 'VALID' END AS status
  FROM numbered f LEFT JOIN bounds b ON f.route_id = b.route_id AND f.travel_date = b.travel_date AND f.window_id = b.window_id AND f.cabin_class = b.cabin_class)
"""


@query(f"SELECT observation_id, {STATUS_CASE} AS status FROM fare_observations")
def validate_status(spark: SparkSession, root: str) -> DataFrame:
    return fares(spark, root).select("observation_id", cleaning.validity()["status"].alias("status"))


@query(f"WITH {CLEAN_CTE} SELECT observation_id, status FROM cleaned")
def clean_status(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.clean(fares(spark, root)).select("observation_id", F.col("quality_status").alias("status"))


@query(f"""WITH {CLEAN_CTE}, e AS (SELECT unnest(['VALID', 'MISSING', 'INVALID_FARE', 'SOLD_OUT', 'DUPLICATE', 'OUTLIER', 'SCRAPE_ERROR', 'CANCELLED']) AS status),
c AS (SELECT status, count(*) AS rows FROM cleaned GROUP BY ALL)
SELECT e.status, coalesce(c.rows, 0) AS rows, round(100.0::DOUBLE * coalesce(c.rows, 0) / sum(coalesce(c.rows, 0)) OVER (), 4) AS percent FROM e LEFT JOIN c USING (status)""")
def clean_summary(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.status_counts(cleaning.clean(fares(spark, root)))


@query("""SELECT observation_id, row_number() OVER (PARTITION BY run_id, data_source_id, fingerprint_hash ORDER BY observation_id)::INT AS n FROM fare_observations""")
def dedup_flags(spark: SparkSession, root: str) -> DataFrame:
    df = fares(spark, root)
    return df.select("observation_id", cleaning.first_of(df, cleaning.READING, ["observation_id"]).alias("n"))


@query("""SELECT airline_id, upper(trim(flight_number)) AS flight, route_id, travel_date, scheduled_departure_time, upper(trim(cabin_class)) AS cabin, count(*) AS quotes,
  list_sort(list_distinct(list(data_source_id))) AS sources FROM fare_observations GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(DISTINCT data_source_id) > 1""")
def cross_source_groups(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.cross_source_groups(fares(spark, root))


STATS_SQL = """SELECT route_id, travel_date, window_id, cabin_class, count(total_fare) AS "count", min(total_fare)::DOUBLE AS min_fare, max(total_fare)::DOUBLE AS max_fare,
  round(quantile_cont(total_fare::DOUBLE, 0.25), 4) AS q1, round(quantile_cont(total_fare::DOUBLE, 0.5), 4) AS median, round(quantile_cont(total_fare::DOUBLE, 0.75), 4) AS q3
  FROM fare_observations WHERE total_fare > 0 GROUP BY ALL"""


@query(STATS_SQL)
def cohort_stats(spark: SparkSession, root: str) -> DataFrame:
    out = cleaning.cohort_stats(fares(spark, root).where("total_fare > 0"))
    return out.select(*cleaning.COHORT, "count", "min_fare", "max_fare", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("""WITH f AS (SELECT *, total_fare::DOUBLE AS x FROM fare_observations WHERE total_fare > 0),
s AS (SELECT route_id, travel_date, window_id, cabin_class, count(*) AS c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS q3 FROM f GROUP BY ALL)
SELECT observation_id, coalesce(c >= 5 AND CASE WHEN q3 - q1 <= 0 THEN x < greatest(m - greatest(500, 0.1 * m), 0) OR x > m + greatest(500, 0.1 * m)
  ELSE x < greatest(q1 - 1.5 * (q3 - q1), 0) OR x > q3 + 1.5 * (q3 - q1) END, FALSE) AS is_outlier FROM f JOIN s USING (route_id, travel_date, window_id, cabin_class)""")
def outlier_iqr(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.with_outlier_flag(fares(spark, root).where("total_fare > 0")).select("observation_id", "is_outlier")


@query("""WITH f AS (SELECT *, total_fare::DOUBLE AS x FROM fare_observations WHERE total_fare > 0),
s AS (SELECT route_id, travel_date, window_id, cabin_class, count(*) AS c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS q3, mad(x) AS d FROM f GROUP BY ALL)
SELECT observation_id, coalesce(c >= 5 AND CASE WHEN d > 0 THEN x < greatest(m - 3 * d / 0.6745, 0) OR x > m + 3 * d / 0.6745
  WHEN q3 - q1 <= 0 THEN x < greatest(m - greatest(500, 0.1 * m), 0) OR x > m + greatest(500, 0.1 * m)
  ELSE x < greatest(q1 - 1.5 * (q3 - q1), 0) OR x > q3 + 1.5 * (q3 - q1) END, FALSE) AS is_outlier FROM f JOIN s USING (route_id, travel_date, window_id, cabin_class)""")
def outlier_mad(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.with_outlier_flag(fares(spark, root).where("total_fare > 0"), cfg=cleaning.OutlierSettings(method="MAD")).select("observation_id", "is_outlier")


# --- reconciliation -----------------------------------------------------------------------------------------------------

IDENTITY_SQL = "airline_id, upper(trim(flight_number)) AS flight, route_id, travel_date, scheduled_departure_time, upper(trim(cabin_class)) AS cabin"
PICKS = {
    "MIN": ("arg_min(total_fare, (total_fare, observation_id))", "(total_fare, observation_id)"),
    "DIRECT": ("arg_min(total_fare, (NOT direct, total_fare, observation_id))", "(NOT direct, total_fare, observation_id)"),
}


def _reconciled(policy: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        rows = with_source(spark, root).where("total_fare > 0 and is_available")
        return reconcile(rows, policy).drop("sources_represented").withColumn("reconciled_fare", F.col("reconciled_fare").cast("double"))

    return run


_SOURCED = "src AS (SELECT f.*, coalesce(contains(upper(s.source_type), 'DIRECT'), FALSE) AS direct FROM fare_observations f LEFT JOIN data_sources s ON s.source_id = f.data_source_id WHERE total_fare > 0 AND is_available)"
for _policy, (_fare, _order) in PICKS.items():
    QUERIES[f"reconcile_{_policy.lower()}"] = _reconciled(_policy)
    SQL[f"reconcile_{_policy.lower()}"] = f"""WITH {_SOURCED} SELECT {IDENTITY_SQL}, {_fare}::DOUBLE AS reconciled_fare, arg_min(observation_id, {_order}) AS selected_observation_id,
  arg_min(data_source_id, {_order}) AS selected_source_id, count(*) AS all_quotes_count FROM src GROUP BY 1, 2, 3, 4, 5, 6"""


#: s / n in whole cents, half to even, as a fare.
HALF_EVEN = "((s // n + CASE WHEN 2 * (s % n) > n OR (2 * (s % n) = n AND (s // n) % 2 = 1) THEN 1 ELSE 0 END) / 100.0)::DECIMAL(12,2)"
_KEYS = "airline_id, flight, route_id, travel_date, scheduled_departure_time, cabin"
QUERIES["reconcile_mean"] = _reconciled("MEAN")
SQL["reconcile_mean"] = f"""WITH {_SOURCED}, q AS (SELECT {IDENTITY_SQL}, (total_fare * 100)::BIGINT AS cents, observation_id, data_source_id FROM src),
m AS (SELECT {_KEYS}, sum(cents)::BIGINT AS s, count(*) AS n, min(observation_id) AS selected_observation_id, arg_min(data_source_id, observation_id) AS selected_source_id FROM q GROUP BY ALL)
SELECT {_KEYS}, {HALF_EVEN}::DOUBLE AS reconciled_fare, selected_observation_id, selected_source_id, n AS all_quotes_count FROM m"""
QUERIES["reconcile_median"] = _reconciled("MEDIAN")
SQL["reconcile_median"] = f"""WITH {_SOURCED}, q AS (SELECT {IDENTITY_SQL}, total_fare, observation_id, data_source_id FROM src),
l AS (SELECT {_KEYS}, list_sort(list((total_fare * 100)::BIGINT)) AS v, count(*) AS c, list({{'fare': total_fare, 'id': observation_id, 'source': data_source_id}}) AS quotes FROM q GROUP BY ALL),
h AS (SELECT *, v[(c + 1) // 2] + v[c // 2 + 1] AS s, 2 AS n FROM l),
m AS (SELECT *, {HALF_EVEN} AS fare FROM h), e AS (SELECT *, unnest(quotes) AS x FROM m)
SELECT {_KEYS}, fare::DOUBLE AS reconciled_fare, arg_min(x.id, (abs(x.fare - fare), x.id)) AS selected_observation_id, arg_min(x.source, (abs(x.fare - fare), x.id)) AS selected_source_id, c AS all_quotes_count
FROM e GROUP BY {_KEYS}, fare, c"""


# --- the index chain ---------------------------------------------------------------------------------------------------

SUMMARY_CTE = """
usable AS (
  SELECT f.*, CAST(observed_at AT TIME ZONE 'Asia/Kolkata' AS DATE) AS od, CASE window_id WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 15 WHEN 4 THEN 30 WHEN 5 THEN 45
      ELSE CASE WHEN advance_days IN (1, 7, 15, 30, 45) THEN advance_days END END AS td
  FROM fare_observations f WHERE is_available AND total_fare > 0 AND cabin_class = 'ECONOMY'
    AND coalesce(quality_status NOT IN ('MISSING', 'INVALID_FARE', 'SOLD_OUT', 'DUPLICATE', 'SCRAPE_ERROR', 'CANCELLED', 'OUTLIER'), TRUE)),
flights AS (
  SELECT od, window_id, airline_id, upper(trim(flight_number)) AS flight, route_id, travel_date, scheduled_departure_time, upper(trim(cabin_class)) AS cabin, min(total_fare)::DOUBLE AS x
  FROM usable WHERE coalesce(travel_date = od + td::INT, TRUE) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
summary AS (
  SELECT od AS observation_date, route_id, window_id, min(travel_date) AS target_travel_date, count(*) AS observations_count, round(min(x), 4) AS min_fare, round(median(x), 4) AS median_fare,
    round(avg(x), 8) AS mean_fare, round(exp(avg(ln(x))), 4) AS geometric_mean_fare, round(exp(avg(ln(x))), 4) AS representative_fare, count(*) < 3 AS is_imputed
  FROM flights GROUP BY 1, 2, 3 HAVING count(DISTINCT travel_date) = 1)
"""
STORED_CTE = f"""
base AS (SELECT route_id, window_id, median(representative_fare::DOUBLE) AS b FROM route_daily_summary WHERE observation_date < DATE '{BASE_END}' GROUP BY ALL),
one AS (SELECT route_id, window_id, observation_date, arg_min(representative_fare, summary_id)::DOUBLE AS fare FROM route_daily_summary WHERE representative_fare IS NOT NULL GROUP BY ALL),
relatives AS (SELECT observation_date AS index_date, route_id, window_id, fare / b * 100 AS price_relative FROM one JOIN base USING (route_id, window_id) WHERE b > 0),
route_level AS (SELECT index_date, route_id, avg(price_relative) AS index_value, count(*) AS windows_included FROM relatives GROUP BY ALL),
weights AS (SELECT route_id, count(*) AS volume, round((count(*)::DOUBLE / sum(count(*)) OVER ())::DECIMAL(20,16), 8) AS weight FROM fare_observations GROUP BY ALL),
national AS (SELECT index_date, sum(index_value * weight::DOUBLE) / sum(weight::DOUBLE) AS index_value, count(*) AS routes_included FROM route_level JOIN weights USING (route_id) GROUP BY ALL HAVING sum(weight) <> 0)
"""


@query(f"WITH {SUMMARY_CTE} SELECT * FROM summary")
def route_summary(spark: SparkSession, root: str) -> DataFrame:
    out = index.daily_summary(fares(spark, root), zone=ZONE, digits=FINE)
    # a mean of cents has exact ties at four digits
    return out.withColumns({c: F.round(c, 8 if c == "mean_fare" else 4) for c in ("min_fare", "median_fare", "mean_fare", "geometric_mean_fare", "representative_fare")})


def stored_summary(spark: SparkSession, root: str) -> DataFrame:
    """The stored daily summaries, each day once, without missing fares."""
    rows = table(spark, root, "route_daily_summary").where("representative_fare is not null")
    return rows.groupBy("route_id", "window_id", "observation_date").agg(F.min_by("representative_fare", "summary_id").cast("double").alias("representative_fare"))


def relatives(spark: SparkSession, root: str) -> DataFrame:
    base = index.base_fares(table(spark, root, "route_daily_summary"), BASE_END, FINE)
    return index.price_relatives(stored_summary(spark, root), base, FINE)


@query(f"WITH {STORED_CTE} SELECT index_date, route_id, window_id, round(price_relative, 4) AS price_relative FROM relatives")
def price_relative(spark: SparkSession, root: str) -> DataFrame:
    return relatives(spark, root).withColumn("price_relative", F.round("price_relative", 4))


@query(f"WITH {STORED_CTE} SELECT index_date, route_id, round(index_value, 3) AS index_value, windows_included FROM route_level")
def route_index(spark: SparkSession, root: str) -> DataFrame:
    return index.route_index(relatives(spark, root), digits=FINE).withColumn("index_value", F.round("index_value", 3))


@query(f"WITH {STORED_CTE} SELECT index_date, route_id, round(exp(avg(ln(price_relative))), 3) AS index_value, count(*) AS windows_included FROM relatives GROUP BY ALL")
def route_index_jevons(spark: SparkSession, root: str) -> DataFrame:
    return index.route_index(relatives(spark, root), jevons=True, digits=FINE).withColumn("index_value", F.round("index_value", 3))


def national(spark: SparkSession, root: str) -> DataFrame:
    return index.national_index(index.route_index(relatives(spark, root), digits=FINE), index.route_weights(fares(spark, root)), FINE)


@query(f"WITH {STORED_CTE} SELECT index_date, round(index_value, 3) AS index_value, routes_included FROM national")
def national_index(spark: SparkSession, root: str) -> DataFrame:
    return national(spark, root).withColumn("index_value", F.round("index_value", 3))


def _rollup(period: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        return index.rollup(national(spark, root), period, FINE).withColumn("index_value", F.round("index_value", 3))

    return run


for _period, _unit in index.PERIODS.items():
    QUERIES[f"rollup_{_period.lower()}"] = _rollup(_period)
    SQL[f"rollup_{_period.lower()}"] = f"""WITH {STORED_CTE} SELECT CAST(date_trunc('{_unit}', index_date) AS DATE) AS index_date, round(avg(index_value), 3) AS index_value,
  min(routes_included) AS routes_included, count(*) AS days, '{_period}' AS period_type FROM national GROUP BY 1"""

BENCH_SQL = "bench AS (SELECT CAST(date_trunc('month', observation_date) AS DATE) AS period_start, avg(median_fare::DOUBLE) AS benchmark FROM route_daily_summary WHERE month(observation_date) <> 7 GROUP BY 1)"


def monthly_benchmark(spark: SparkSession, root: str) -> DataFrame:
    """A mean fare for every month but July, so that one month of the index has none."""
    rows = table(spark, root, "route_daily_summary").where(F.month("observation_date") != 7)
    return rows.groupBy(F.to_date(F.date_trunc("month", F.col("observation_date"))).alias("period_start")).agg(F.round(F.avg(F.col("median_fare").cast("double")), FINE).alias("benchmark"))


MONTHLY_SQL = "monthly AS (SELECT CAST(date_trunc('month', index_date) AS DATE) AS index_date, avg(index_value) AS index_value FROM national GROUP BY 1)"


@query(f"""WITH {STORED_CTE}, {BENCH_SQL}, {MONTHLY_SQL}, e AS (SELECT abs(index_value - benchmark) / benchmark * 100 AS error_percent FROM monthly m LEFT JOIN bench b ON b.period_start = m.index_date)
SELECT count(*) AS periods, count(error_percent) AS matched, round(avg(error_percent), 3) AS mape, avg(error_percent) <= 5 AS passed FROM e""")
def mape_monthly(spark: SparkSession, root: str) -> DataFrame:
    errors = index.absolute_errors(index.rollup(national(spark, root), "MONTHLY", FINE), monthly_benchmark(spark, root), FINE)
    return index.mean_absolute_error(errors, digits=FINE).withColumn("mape", F.round("mape", 3))


@query(f"""WITH {STORED_CTE}, {BENCH_SQL}, y AS (SELECT CAST(date_trunc('year', index_date) AS DATE) AS index_date, avg(index_value) AS index_value FROM national GROUP BY 1),
b AS (SELECT CAST(date_trunc('year', period_start) AS DATE) AS index_date, avg(benchmark) AS benchmark FROM bench GROUP BY 1)
SELECT count(*) AS periods, count(benchmark) AS matched, round(avg(abs(index_value - benchmark) / benchmark * 100), 3) AS mape, avg(abs(index_value - benchmark) / benchmark * 100) <= 5 AS passed FROM y LEFT JOIN b USING (index_date)""")
def mape_yearly(spark: SparkSession, root: str) -> DataFrame:
    months = monthly_benchmark(spark, root)
    yearly = months.groupBy(F.to_date(F.date_trunc("year", F.col("period_start"))).alias("period_start")).agg(F.round(F.avg("benchmark"), FINE).alias("benchmark"))
    return index.mean_absolute_error(index.absolute_errors(index.rollup(national(spark, root), "YEARLY", FINE), yearly, FINE), digits=FINE).withColumn("mape", F.round("mape", 3))


@query("""WITH one AS (SELECT route_id, window_id, observation_date, arg_min(representative_fare, summary_id)::DOUBLE AS representative_fare FROM route_daily_summary WHERE representative_fare IS NOT NULL GROUP BY ALL),
l AS (SELECT *, lag(representative_fare) OVER (PARTITION BY route_id, window_id ORDER BY observation_date) AS p FROM one)
SELECT route_id, window_id, observation_date, representative_fare, CASE WHEN p <> 0 THEN round((representative_fare - p) / p * 100, 4) END AS change_percent FROM l""")
def day_on_day(spark: SparkSession, root: str) -> DataFrame:
    return audit.day_on_day(stored_summary(spark, root))


@query("""SELECT route_id, count(*) AS volume, round((count(*)::DOUBLE / sum(count(*)) OVER ())::DECIMAL(20,16), 8)::DOUBLE AS weight FROM fare_observations GROUP BY route_id""")
def basket_weights(spark: SparkSession, root: str) -> DataFrame:
    return index.route_weights(fares(spark, root)).withColumn("weight", F.col("weight").cast("double"))


# --- dimensions and tasks ----------------------------------------------------------------------------------------------

@query("""SELECT r.route_id, r.route_code, w.window_id, w.window_code, w.target_advance_days, w.display_order, DATE '2026-07-01' + w.target_advance_days AS travel_date FROM routes r CROSS JOIN booking_windows w WHERE r.is_active AND w.is_active""")
def task_matrix(spark: SparkSession, root: str) -> DataFrame:
    return dimensions.task_matrix(table(spark, root, "routes"), table(spark, root, "booking_windows"), "2026-07-01")


@query("""WITH q AS (SELECT quote_id, greatest(0, travel_date - CAST(observed_at AS DATE))::INT AS advance_days FROM flight_quotes)
SELECT quote_id, advance_days, arg_min(window_id, (abs(advance_days - target_advance_days), display_order)) AS nearest_window_id, arg_min(window_code, (abs(advance_days - target_advance_days), display_order)) AS nearest_window_code
FROM q CROSS JOIN booking_windows GROUP BY ALL""")
def nearest_window(spark: SparkSession, root: str) -> DataFrame:
    quotes = table(spark, root, "flight_quotes").select("quote_id", F.greatest(F.lit(0), F.date_diff("travel_date", X.local_date("observed_at"))).alias("advance_days"))
    return dimensions.nearest_window(quotes, table(spark, root, "booking_windows"))


@query("""SELECT least(origin_city_id, destination_city_id) AS city_a, greatest(origin_city_id, destination_city_id) AS city_b, count(*) AS routes, list_sort(list(route_id)) AS route_ids FROM routes GROUP BY 1, 2""")
def undirected_routes(spark: SparkSession, root: str) -> DataFrame:
    return dimensions.undirected_pairs(table(spark, root, "routes"))


@query("""WITH top AS (SELECT max(source_id) AS m FROM data_sources), asked AS (SELECT DISTINCT upper(trim(cabin_class)) AS source_code FROM flight_quotes WHERE coalesce(cabin_class, '') <> ''),
fresh AS (SELECT * FROM asked WHERE source_code NOT IN (SELECT upper(trim(source_code)) FROM data_sources))
SELECT source_id, source_code FROM data_sources UNION ALL SELECT (m + row_number() OVER (ORDER BY source_code))::INT, source_code FROM fresh CROSS JOIN top""")
def get_or_create(spark: SparkSession, root: str) -> DataFrame:
    codes = table(spark, root, "flight_quotes").select(F.col("cabin_class").alias("source_code"))
    return dimensions.get_or_create(codes, table(spark, root, "data_sources"), "source_code", "source_id").select("source_id", "source_code")


@query("""WITH done AS (SELECT DISTINCT route_id, window_id FROM fare_observations WHERE observed_at < TIMESTAMPTZ '2026-06-02 00:00:00+00')
SELECT r.route_id, w.window_id FROM routes r CROSS JOIN booking_windows w WHERE r.is_active AND w.is_active AND NOT EXISTS (SELECT 1 FROM done d WHERE d.route_id = r.route_id AND d.window_id = w.window_id)""")
def remaining_tasks(spark: SparkSession, root: str) -> DataFrame:
    tasks = dimensions.task_matrix(table(spark, root, "routes"), table(spark, root, "booking_windows"), "2026-06-02")
    done = fares(spark, root).where("observed_at < timestamp '2026-06-02 00:00:00 UTC'")
    return dimensions.remaining_tasks(tasks, done).select("route_id", "window_id")


@query("""SELECT route_id, count(*) AS volume FROM fare_observations GROUP BY route_id ORDER BY volume DESC, route_id LIMIT 10""")
def top_routes(spark: SparkSession, root: str) -> DataFrame:
    return dimensions.top_by(fares(spark, root).groupBy("route_id").agg(F.count("*").alias("volume")), "volume", "route_id", 10)


# --- audits and reports ------------------------------------------------------------------------------------------------

AUDIT_CTE = """
runs AS (SELECT run_id, (SELECT 1) AS x, min(observed_at) AS started_at, max(created_at) AS completed_at, count(*) AS records_scraped FROM fare_observations GROUP BY run_id),
modes AS (SELECT run_id, arg_max(data_source_id, (n, -data_source_id)) AS source_id FROM (SELECT run_id, data_source_id, count(*) AS n FROM fare_observations GROUP BY ALL) GROUP BY run_id),
facts AS (
  SELECT run_id, count(*) AS stored, count(DISTINCT nullif(fingerprint_hash, '')) AS fingerprints, count(*) FILTER (WHERE total_fare IS NULL OR total_fare <= 0) AS bad, count(DISTINCT travel_date) AS travel_dates,
    min(data_source_id) AS lo, max(data_source_id) AS hi, min(total_fare)::DOUBLE AS min_fare, max(total_fare)::DOUBLE AS max_fare FROM fare_observations GROUP BY run_id),
audits AS (
  SELECT run_id, source_id, records_scraped, stored, fingerprints, travel_dates, min_fare, max_fare,
    concat_ws('; ', CASE WHEN fingerprints <> stored THEN 'fingerprints_repeat' END, CASE WHEN bad > 0 THEN 'invalid_fares' END, CASE WHEN lo <> source_id OR hi <> source_id THEN 'source_differs' END, CASE WHEN travel_dates > 1 THEN 'travel_dates_differ' END) AS notes,
    CASE WHEN stored < 5 THEN 'SUCCESS_WITH_LOW_DATA' ELSE 'SUCCESS' END AS health, floor(epoch(completed_at))::BIGINT - floor(epoch(started_at))::BIGINT AS seconds
  FROM runs JOIN modes USING (run_id) JOIN facts USING (run_id))
"""


def audited(spark: SparkSession, root: str) -> DataFrame:
    rows = fares(spark, root)
    return audit.audit_runs(audit.runs_of(rows), rows)


@query(f"WITH {AUDIT_CTE} SELECT *, CASE WHEN notes = '' THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS consistency FROM audits")
def run_audit(spark: SparkSession, root: str) -> DataFrame:
    return audited(spark, root).drop("mean_fare", "travel_date", *audit.TARGETS.values())


@query(f"""WITH {AUDIT_CTE} SELECT count(*) AS runs, count(*) AS successful, 0::BIGINT AS no_inventory, 0::BIGINT AS failed, count(*) FILTER (WHERE notes = '') AS consistent, sum(stored)::BIGINT AS stored, round(avg(seconds), 4) AS mean_seconds,
  100.0::DOUBLE AS successful_rate, 0.0::DOUBLE AS no_inventory_rate, 0.0::DOUBLE AS failed_rate, round(100 * (count(*) FILTER (WHERE notes = ''))::DOUBLE / count(*), 4) AS consistent_rate FROM audits""")
def audit_batch(spark: SparkSession, root: str) -> DataFrame:
    return audit.batch_summary(audited(spark, root))


@query("SELECT fingerprint_hash, count(*) AS n FROM fare_observations GROUP BY 1 HAVING count(*) > 1")
def duplicate_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return audit.repeated(fares(spark, root), ["fingerprint_hash"])


_CELLS = ", ".join(f"count(*) FILTER (WHERE window_id = {i}) AS w_{c[2:]}" for i, c in enumerate(CODES, 1))


@query(f"""WITH c AS (SELECT route_id, {_CELLS} FROM fare_observations GROUP BY 1)
SELECT *, w_1 + w_7 + w_15 + w_30 + w_45 AS total, CASE WHEN least(w_1, w_7, w_15, w_30, w_45) > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS state FROM c""")
def coverage_pivot(spark: SparkSession, root: str) -> DataFrame:
    windows = table(spark, root, "booking_windows")
    return audit.coverage(fares(spark, root), CODES, broadcast_if_small(windows))


@query("""WITH l AS (SELECT route_id, travel_date, airline_id, flight_number, data_source_id, min(total_fare) AS f FROM fare_observations WHERE total_fare > 0 GROUP BY ALL)
SELECT route_id, travel_date, airline_id, flight_number, count(*) AS sources, (max(f) - min(f))::DOUBLE AS delta FROM l GROUP BY ALL HAVING count(*) > 1""")
def price_delta(spark: SparkSession, root: str) -> DataFrame:
    return audit.price_delta(fares(spark, root))


@query("""WITH t AS (SELECT route_id, window_id, run_id, avg(total_fare::DOUBLE) AS f FROM fare_observations WHERE total_fare > 0 AND total_fare < 1000000 GROUP BY ALL),
b AS (SELECT route_id, avg(f) FILTER (WHERE window_id = 1) AS n, avg(f) FILTER (WHERE window_id = 2) AS r FROM t GROUP BY 1)
SELECT route_id, round(n, 7) AS near_fare, round(r, 7) AS far_fare, round(CASE WHEN coalesce(r, 0) = 0 THEN 0 ELSE (n - r) / r * 100 END, 7) AS premium_percent FROM b""")
def window_premium(spark: SparkSession, root: str) -> DataFrame:
    return audit.window_premium(fares(spark, root).where("total_fare < 1000000"), digits=7)


@query("""SELECT s.source_type, s.source_code, count(*) AS rows, count(DISTINCT flight_number) AS flights, grouping_id(s.source_type, s.source_code)::BIGINT AS level
FROM fare_observations f LEFT JOIN data_sources s ON s.source_id = f.data_source_id GROUP BY ROLLUP (s.source_type, s.source_code)""")
def source_rollup(spark: SparkSession, root: str) -> DataFrame:
    return audit.source_rollup(with_source(spark, root)).drop("mean_fare")


@query("SELECT total_fare::DOUBLE AS fare, count(*) AS n FROM fare_observations GROUP BY 1")
def fare_histogram(spark: SparkSession, root: str) -> DataFrame:
    return fares(spark, root).groupBy(F.col("total_fare").cast("double").alias("fare")).agg(F.count("*").alias("n"))


@query("""SELECT route_id, window_id, arg_max(observation_id, (observed_at, observation_id)) AS observation_id, max(observed_at) AS observed_at FROM fare_observations GROUP BY 1, 2""")
def latest_reading(spark: SparkSession, root: str) -> DataFrame:
    return audit.latest(fares(spark, root).select("route_id", "window_id", "observation_id", "observed_at"), ["route_id", "window_id"], ["observed_at", "observation_id"])


@query("""SELECT data_source_id, count(*) AS rows, count(*) FILTER (WHERE total_fare IS NULL OR total_fare <= 0) AS invalid_fares, count(*) FILTER (WHERE travel_date - CAST(observed_at AS DATE) <> advance_days) AS wrong_advance,
  count(DISTINCT flight_number) AS flights, count(DISTINCT route_id) FILTER (WHERE is_available) AS routes_available FROM fare_observations GROUP BY 1""")
def quality_counts(spark: SparkSession, root: str) -> DataFrame:
    return fares(spark, root).groupBy("data_source_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("total_fare").isNull() | (F.col("total_fare") <= 0)).alias("invalid_fares"), F.count_if(F.date_diff("travel_date", X.local_date("observed_at")) != F.col("advance_days")).alias("wrong_advance"),
        F.count_distinct("flight_number").alias("flights"), F.count_distinct(F.when(F.col("is_available"), F.col("route_id"))).alias("routes_available"),
    )


# --- parsing and mapping -----------------------------------------------------------------------------------------------

FINGER_SQL = """concat_ws('|', upper(trim(coalesce(airline, ''))), coalesce({flight}, ''), upper(trim(origin)), upper(trim(destination)), strftime(travel_date, '%Y-%m-%d'),
  coalesce(nullif(upper(trim(departure_time[1:5])), ''), 'NONE'), coalesce(nullif(upper(trim(cabin_class)), ''), 'ECONOMY'), coalesce(nullif(upper(trim(fare_family)), ''), 'NONE'))"""
_UPPER = r"regexp_replace(upper(trim(flight_number)), '\s+', ' ', 'g')"
FLIGHT_SQL = f"CASE WHEN regexp_matches({_UPPER}, '{X.CARRIER}') THEN regexp_replace({_UPPER}, '{X.CARRIER}', '\\1 \\2') ELSE {_UPPER} END"


@query(f"SELECT quote_id, {FLIGHT_SQL} AS flight FROM flight_quotes")
def normal_flight_numbers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "flight_quotes").select("quote_id", X.normal_flight_number("flight_number").alias("flight"))


@query(f"SELECT quote_id, sha256({FINGER_SQL.format(flight=FLIGHT_SQL)}) AS fingerprint FROM flight_quotes")
def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    parts = [F.col(c) for c in ("airline", "flight_number", "origin", "destination", "travel_date", "departure_time", "cabin_class", "fare_family")]
    return table(spark, root, "flight_quotes").select("quote_id", X.fingerprint(*parts).alias("fingerprint"))


@query(r"""SELECT quote_id, CASE WHEN regexp_matches(t, '^([01][0-9]|2[0-3]):[0-5][0-9]$') THEN t END AS departure FROM (
  SELECT quote_id, CASE WHEN c = '' THEN NULL ELSE lpad(c, 5, '0') END AS t FROM (SELECT quote_id, CASE WHEN regexp_extract(trim(departure_time), 'T([0-9]{2}:[0-9]{2})', 1) <> '' THEN regexp_extract(trim(departure_time), 'T([0-9]{2}:[0-9]{2})', 1)
  ELSE regexp_extract(trim(departure_time), '^([0-9]{1,2}:[0-9]{2})(:[0-9]{2})?$', 1) END AS c FROM flight_quotes))""")
def parsed_clocks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "flight_quotes").select("quote_id", X.parse_clock("departure_time").alias("departure"))


@query(r"""WITH alerts AS (SELECT result_id, unnest(alert_texts) AS alert FROM diagnostic_results), lines AS (SELECT result_id, unnest(string_split(alert, chr(10))) AS line FROM alerts),
a AS (SELECT result_id, replace(regexp_replace(trim(line), '^(rs\.?|inr|₹)\s*', '', 'i'), ',', '') AS amount, line FROM lines WHERE regexp_matches(trim(line), '^(?i)(rs\.?|inr|₹)'))
SELECT result_id, line, TRY_CAST(amount AS DECIMAL(10,2))::DOUBLE AS fare FROM a WHERE regexp_matches(amount, '^[0-9]{1,8}(\.[0-9]{1,2})?$') AND TRY_CAST(amount AS DECIMAL(10,2)) > 500""")
def parsed_fares(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "diagnostic_results").select("result_id", F.explode("alert_texts").alias("a")).select("result_id", F.explode(F.split("a", "\n")).alias("line"))
    return lines.where(F.trim("line").rlike(r"(?i)^(rs\.?|inr|₹)")).select("result_id", "line", X.parse_fare("line", 500).cast("double").alias("fare")).where("fare is not null")


@query(r"""SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b'), lambda x: TRY_CAST(x AS DATE))).len()::INT AS dates FROM documents WHERE text IS NOT NULL""")
def iso_dates(spark: SparkSession, root: str) -> DataFrame:
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), F.lit(0)), lambda x: F.try_to_date(x, "yyyy-MM-dd")))
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.size(F.array_compact(found)).alias("dates"))


_MONTH = "CASE left(lower({m}), 3) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)) + " END"
_IS_MONTH = "regexp_matches(lower({m}), '^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?|september|oct(ober)?|nov(ember)?|dec(ember)?)$')"
_FAMILY = "SELECT doc_id, unnest(regexp_extract_all(text, '{p}', {y})) AS y, unnest(regexp_extract_all(text, '{p}', {m})) AS m, unnest(regexp_extract_all(text, '{p}', {d})) AS d FROM documents WHERE text IS NOT NULL"
_FAMILIES = "f AS (" + " UNION ALL ".join(_FAMILY.format(p=p, y=y, m=m, d=d) for p, (y, m, d) in (
    (r"\b([0-9]{1,2})\s+([A-Za-z]{3,9}),?\s+([0-9]{4})\b", (3, 2, 1)), (r"([0-9]{1,2})-?([A-Za-z]{3,4})-?([0-9]{4})\b", (3, 2, 1)),
    (r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\b", (3, 2, 1)), (r"\b([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b", (1, 2, 3)),
)) + ")"


@query(f"""WITH {_FAMILIES}, n AS (SELECT doc_id, y, d, CASE WHEN {_IS_MONTH.format(m="m")} THEN {_MONTH.format(m="m")} ELSE TRY_CAST(m AS INT) END AS m FROM f)
SELECT DISTINCT doc_id, TRY_CAST(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS rendered FROM n WHERE TRY_CAST(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) IS NOT NULL""")
def rendered_dates(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.explode(X.dates_in("text")).alias("rendered"))


@query(r"""SELECT quote_id, greatest(0, travel_date - CAST(observed_at AS DATE))::INT AS advance_days, coalesce(stops, 0) = 0 AS is_non_stop, CAST(observed_at AT TIME ZONE 'Asia/Kolkata' AS DATE) AS local_day,
  CAST(date_trunc('week', travel_date) AS DATE) AS week, CAST(date_trunc('month', travel_date) AS DATE) AS month, regexp_replace(upper(trim(source)), '\s+', '_', 'g') AS source_code FROM flight_quotes""")
def observation_map(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "flight_quotes").select(
        "quote_id", F.greatest(F.lit(0), F.date_diff("travel_date", X.local_date("observed_at"))).alias("advance_days"), (F.coalesce("stops", F.lit(0)) == 0).alias("is_non_stop"), X.local_date("observed_at", "Asia/Kolkata").alias("local_day"),
        F.to_date(F.date_trunc("week", "travel_date")).alias("week"), F.to_date(F.date_trunc("month", "travel_date")).alias("month"), X.source_code("source").alias("source_code"),
    )


# --- sets and merges -----------------------------------------------------------------------------------------------------

@query("""SELECT upper(trim(flight_number)) AS flight FROM fare_observations WHERE data_source_id = 1 INTERSECT SELECT upper(trim(flight_number)) FROM fare_observations WHERE data_source_id = 3""")
def shared_flights(spark: SparkSession, root: str) -> DataFrame:
    of = lambda s: fares(spark, root).where(F.col("data_source_id") == s).select(F.upper(F.trim("flight_number")).alias("flight"))
    return of(1).intersect(of(3))


@query("SELECT DISTINCT CAST(observed_at AS DATE) AS day FROM fare_observations")
def observation_days(spark: SparkSession, root: str) -> DataFrame:
    return fares(spark, root).select(X.local_date("observed_at").alias("day")).distinct()


@query("""SELECT route_id, window_id, observation_date, summary_id FROM route_daily_summary r WHERE summary_id = (SELECT max(summary_id) FROM route_daily_summary s WHERE s.route_id = r.route_id AND s.window_id = r.window_id AND s.observation_date = r.observation_date)""")
def merged_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Days stored again replace what was stored before."""
    keys = ["route_id", "window_id", "observation_date"]
    rows = table(spark, root, "route_daily_summary").select(*keys, "summary_id")
    first = rows.groupBy(*keys).agg(F.min("summary_id").alias("summary_id"))
    last = rows.groupBy(*keys).agg(F.max("summary_id").alias("summary_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return merge.merge_by_key(first, last, keys)


# --- further reports -----------------------------------------------------------------------------------------------------

@query("""WITH f AS (SELECT *, total_fare::DOUBLE AS x FROM fare_observations WHERE total_fare > 0), s AS (SELECT route_id, window_id, quantile_cont(x, 0.5) AS m, mad(x) AS d FROM f GROUP BY ALL)
SELECT observation_id, CASE WHEN d > 0 THEN round(0.6745 * (x - m) / d, 6) END AS modified_z FROM f JOIN s USING (route_id, window_id)""")
def modified_z(spark: SparkSession, root: str) -> DataFrame:
    return audit.modified_z(fares(spark, root).where("total_fare > 0"), ["route_id", "window_id"], "total_fare").select("observation_id", F.round("modified_z", 6).alias("modified_z"))


@query(f"WITH {AUDIT_CTE} SELECT observation_id, run_id, data_source_id FROM fare_observations f JOIN modes m USING (run_id) WHERE f.data_source_id <> m.source_id")
def run_disagreements(spark: SparkSession, root: str) -> DataFrame:
    rows = fares(spark, root)
    return audit.disagreements(audit.runs_of(rows), rows).select("observation_id", "run_id", "data_source_id")


@query("""SELECT run_id, floor(epoch(max(created_at)))::BIGINT - floor(epoch(min(observed_at)))::BIGINT AS seconds FROM fare_observations GROUP BY run_id ORDER BY seconds DESC, run_id LIMIT 5""")
def slowest_runs(spark: SparkSession, root: str) -> DataFrame:
    return dimensions.top_by(audited(spark, root).select("run_id", "seconds"), "seconds", "run_id", 5)


@query("""SELECT route_id, window_id, count(*) AS n FROM fare_observations GROUP BY ALL HAVING count(*) > 0 AND count(*) < 20""")
def thin_cells(spark: SparkSession, root: str) -> DataFrame:
    return fares(spark, root).groupBy("route_id", "window_id").agg(F.count("*").alias("n")).where("n > 0 and n < 20")


@query("""SELECT (SELECT count(*) FROM fare_observations) AS observations, (SELECT count(DISTINCT run_id) FROM fare_observations) AS runs, (SELECT count(*) FROM flight_quotes) AS quotes, (SELECT coalesce(max(summary_id), 0) FROM route_daily_summary) AS last_summary""")
def scalar_totals(spark: SparkSession, root: str) -> DataFrame:
    one = fares(spark, root).agg(F.count("*").alias("observations"), F.count_distinct("run_id").alias("runs"))
    two = table(spark, root, "flight_quotes").agg(F.count("*").alias("quotes"))
    three = table(spark, root, "route_daily_summary").agg(F.coalesce(F.max("summary_id"), F.lit(0)).alias("last_summary"))
    return one.crossJoin(two).crossJoin(three)  # one row each


@query("""SELECT fingerprint_hash, route_id, count(*) AS n, list_sort(list_distinct(list(run_id))) AS members FROM fare_observations WHERE fingerprint_hash IS NOT NULL AND fingerprint_hash <> '' AND route_id IS NOT NULL GROUP BY ALL""")
def representative_groups(spark: SparkSession, root: str) -> DataFrame:
    return audit.representative_groups(fares(spark, root), ["fingerprint_hash", "route_id"], "run_id")


@query("""WITH t AS (SELECT result_id, lower(page_title) AS t FROM diagnostic_results UNION ALL SELECT result_id, lower(unnest(alert_texts)) FROM diagnostic_results)
SELECT result_id, coalesce(bool_or(regexp_matches(t, 'no (direct )?flights (found|available)|sorry, no flights|no available flights|try the closest available date|we could(n''t| not) find any flights|no results found|no inventory available')), FALSE) AS no_inventory,
  coalesce(bool_or(regexp_matches(t, 'timeout|net::|connection|econnre(set|fused)|target closed|(page crash|browser clos)ed|navigating to|unexpected empty result|interrupted|protocol error')), FALSE) AS transient FROM t GROUP BY 1""")
def page_states(spark: SparkSession, root: str) -> DataFrame:
    texts = F.concat(F.array("page_title"), F.coalesce("alert_texts", F.array().cast("array<string>")))
    has = lambda phrases: F.exists(texts, lambda t: X.mentions(t, phrases))
    return table(spark, root, "diagnostic_results").select("result_id", F.coalesce(has(X.NO_INVENTORY), F.lit(False)).alias("no_inventory"), F.coalesce(has(X.TRANSIENT), F.lit(False)).alias("transient"))


@query("""SELECT result_id, coalesce(regexp_matches(upper(page_title), '\\b' || substr(route_code, 1, 3) || '\\b') AND regexp_matches(upper(page_title), '\\b' || substr(route_code, 5, 3) || '\\b'), FALSE) AS names_route,
  'https://' || split_part(split_part(final_url, '//', 2), '/', 1) || '/search?from=' || substr(route_code, 1, 3) || '&to=' || substr(route_code, 5, 3) || '&date=' || strftime(travel_date, '%Y-%m-%d') AS url FROM diagnostic_results""")
def verified_pages(spark: SparkSession, root: str) -> DataFrame:
    a, b = F.substring("route_code", 1, 3), F.substring("route_code", 5, 3)
    host = F.parse_url("final_url", F.lit("HOST"))
    return table(spark, root, "diagnostic_results").select("result_id", (X.names_place("page_title", a) & X.names_place("page_title", b)).alias("names_route"), X.search_url(host, a, b, F.col("travel_date")).alias("url"))


@query("""SELECT quote_id, s.source_code, coalesce(a.airline_code, CASE WHEN trim(coalesce(q.airline, '')) = '' THEN 'Unknown' ELSE trim(q.airline) END) AS airline
FROM flight_quotes q LEFT JOIN data_sources s ON lower(s.source_name) = lower(trim(q.source)) LEFT JOIN airlines a ON upper(a.airline_name) = upper(trim(q.airline))""")
def resolved_dimensions(spark: SparkSession, root: str) -> DataFrame:
    sources = table(spark, root, "data_sources").select(F.lower("source_name").alias("_s"), "source_code")
    rows = bounded_rows(table(spark, root, "airlines").select("airline_name", "airline_code"), 5000)
    if rows is None:
        raise ValueError("the airline table must not exceed 5000 rows")
    names = {r.airline_name: r.airline_code for r in rows}
    quotes = table(spark, root, "flight_quotes").withColumn("_s", F.lower(F.trim("source")))
    return quotes.join(broadcast_if_small(sources), "_s", "left").select("quote_id", "source_code", X.mapped("airline", names).alias("airline"))


WINDOW_WEIGHTS = ((1, 0.1), (2, 0.2), (3, 0.4), (4, 0.2), (5, 0.1))


@query(f"""WITH {STORED_CTE}, w AS (SELECT * FROM (VALUES {", ".join(map(str, WINDOW_WEIGHTS))}) v(window_id, w))
SELECT index_date, route_id, round(sum(price_relative * w) / sum(w), 4) AS index_value, count(*) AS windows_included FROM relatives JOIN w USING (window_id) GROUP BY ALL""")
def route_index_weighted(spark: SparkSession, root: str) -> DataFrame:
    weights = spark.createDataFrame(WINDOW_WEIGHTS, "window_id int, weight double")
    return index.route_index(relatives(spark, root), weights, digits=FINE).withColumn("index_value", F.round("index_value", 4))


@query("""SELECT r.route_id, r.route_code, least(o.n, d.n) AS shared FROM routes r JOIN (SELECT origin_city_id, count(*) AS n FROM routes GROUP BY 1) o USING (origin_city_id) JOIN (SELECT destination_city_id, count(*) AS n FROM routes GROUP BY 1) d USING (destination_city_id) WHERE r.is_active""")
def route_cities(spark: SparkSession, root: str) -> DataFrame:
    routes = table(spark, root, "routes")
    o = routes.groupBy("origin_city_id").agg(F.count("*").alias("o"))
    d = routes.groupBy("destination_city_id").agg(F.count("*").alias("d"))
    return routes.where("is_active").join(o, "origin_city_id").join(d, "destination_city_id").select("route_id", "route_code", F.least("o", "d").alias("shared"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, root: str) -> DataFrame:
    """The batch form of the streamed windowed counts, over the event table."""
    events = table(spark, root, "events")
    return events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")

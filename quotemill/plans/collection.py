"""Queries of ingestion, collection runs, tasks, the basket and published tables, each with its SQL.

The test tables have no table of runs. Here a run is what a collector would have announced for it: RUNS gives the announcements
by rules of the run's number, so that they differ from what was stored, and adds runs that stored nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import text as X
from quotemill.operators import audit, basket, dimensions, index, ingest, merge
from quotemill.plans.fares import BASE_END, FINE, HALF_EVEN, STORED_CTE, ZONE, fares, relatives, stored_summary
from quotemill.runtime import broadcast_if_small, checkpoint, ensure_checkpoint_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- runs with announcements ---------------------------------------------------------------------------------------------

RUNS_CTE = """
seen AS (SELECT run_id, min(data_source_id) AS source_id, min(route_id) AS route, min(window_id) AS win, min(observed_at) AS started_at, max(created_at) AS loaded, count(*) AS n FROM fare_observations GROUP BY run_id),
runs AS (
  SELECT run_id, CASE WHEN run_id % 13 = 0 THEN source_id % 5 + 1 ELSE source_id END AS source_id, CASE WHEN run_id % 2 = 0 THEN route END AS target_route_id, CASE WHEN run_id % 9 = 0 THEN win % 5 + 1 WHEN run_id % 4 <> 3 THEN win END AS target_window_id,
    started_at, CASE WHEN run_id % 17 <> 5 THEN loaded END AS completed_at, CASE WHEN run_id % 17 = 5 THEN 'RUNNING' WHEN run_id % 17 = 7 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    (n + CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS records_scraped, CASE WHEN run_id % 17 = 7 THEN 'page crashed' END AS error_summary FROM seen
  UNION ALL SELECT -route_id, 1, route_id, 1 + route_id % 5, TIMESTAMPTZ '2026-06-05 20:00:00+00', TIMESTAMPTZ '2026-06-05 20:01:00+00' + INTERVAL 1 SECOND * route_id, CASE WHEN route_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END, 0, NULL FROM routes)
"""


def runs(spark: SparkSession, root: str) -> DataFrame:
    seen = fares(spark, root).groupBy("run_id").agg(
        F.min("data_source_id").alias("source_id"), F.min("route_id").alias("route"), F.min("window_id").alias("win"), F.min("observed_at").alias("started_at"), F.max("created_at").alias("loaded"), F.count("*").alias("n"))
    announced = seen.selectExpr(
        "run_id", "if(run_id % 13 = 0, source_id % 5 + 1, source_id) as source_id", "if(run_id % 2 = 0, route, null) as target_route_id", "case when run_id % 9 = 0 then win % 5 + 1 when run_id % 4 <> 3 then win end as target_window_id",
        "started_at", "if(run_id % 17 <> 5, loaded, null) as completed_at", "case when run_id % 17 = 5 then 'RUNNING' when run_id % 17 = 7 then 'FAILED' else 'COMPLETED' end as status",
        "n + if(run_id % 7 = 0, 1, 0) as records_scraped", "if(run_id % 17 = 7, 'page crashed', null) as error_summary",
    )
    empty = table(spark, root, "routes").selectExpr(
        "-cast(route_id as bigint) as run_id", "1 as source_id", "route_id as target_route_id", "1 + route_id % 5 as target_window_id", "timestamp '2026-06-05 20:00:00 UTC' as started_at",
        "timestampadd(second, route_id, timestamp '2026-06-05 20:01:00 UTC') as completed_at", "if(route_id % 3 = 0, 'FAILED', 'COMPLETED') as status", "0L as records_scraped", "cast(null as string) as error_summary",
    )
    return announced.unionByName(empty)


AUDITED_CTE = RUNS_CTE + """,
facts AS (
  SELECT run_id, count(*) AS stored, count(DISTINCT nullif(fingerprint_hash, '')) AS fingerprints, count(*) FILTER (WHERE total_fare IS NULL OR total_fare <= 0) AS bad, count(DISTINCT travel_date) AS days, min(travel_date) AS day,
    min(route_id) AS rlo, max(route_id) AS rhi, min(window_id) AS wlo, max(window_id) AS whi, min(data_source_id) AS slo, max(data_source_id) AS shi FROM fare_observations GROUP BY run_id),
audits AS (
  SELECT r.run_id, source_id, target_route_id, target_window_id, status, records_scraped, coalesce(stored, 0) AS stored, started_at,
    coalesce(day, CAST(started_at AS DATE) + CASE target_window_id WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 15 WHEN 4 THEN 30 WHEN 5 THEN 45 END) AS travel_date,
    concat_ws('; ', CASE WHEN status = 'COMPLETED' AND records_scraped <> coalesce(stored, 0) THEN 'count_differs' END, CASE WHEN fingerprints <> stored THEN 'fingerprints_repeat' END, CASE WHEN bad > 0 THEN 'invalid_fares' END,
      CASE WHEN rlo <> target_route_id OR rhi <> target_route_id THEN 'route_differs' END, CASE WHEN wlo <> target_window_id OR whi <> target_window_id THEN 'window_differs' END,
      CASE WHEN slo <> source_id OR shi <> source_id THEN 'source_differs' END, CASE WHEN days > 1 THEN 'travel_dates_differ' END) AS notes,
    CASE WHEN status = 'FAILED' THEN 'FAILED' WHEN status = 'COMPLETED' AND records_scraped = 0 AND coalesce(stored, 0) = 0 THEN 'NO_INVENTORY' WHEN status = 'COMPLETED' AND stored BETWEEN 1 AND 4 THEN 'SUCCESS_WITH_LOW_DATA'
      WHEN status = 'COMPLETED' AND stored > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS health,
    floor(epoch(completed_at))::BIGINT - floor(epoch(started_at))::BIGINT AS seconds
  FROM runs r LEFT JOIN facts f ON f.run_id = r.run_id)
"""


def audits(spark: SparkSession, root: str) -> DataFrame:
    return audit.audit_runs(runs(spark, root), fares(spark, root))


@query(f"""WITH {AUDITED_CTE} SELECT run_id, source_id, target_route_id, target_window_id, travel_date, records_scraped, stored, notes, health, seconds, CASE WHEN notes = '' THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS consistency,
coalesce(source_code, 'UNKNOWN') AS source_code, coalesce(route_code, 'UNKNOWN') AS route_code, coalesce(window_code, 'UNKNOWN') AS window_code
FROM audits LEFT JOIN data_sources USING (source_id) LEFT JOIN routes ON route_id = target_route_id LEFT JOIN booking_windows ON window_id = target_window_id""")
def audit_targets(spark: SparkSession, root: str) -> DataFrame:
    """Runs against what they announced: every check and every health occurs."""
    named = audit.with_labels(audits(spark, root), *(table(spark, root, t) for t in ("data_sources", "routes", "booking_windows")))
    return named.drop("fingerprints", "travel_dates", "min_fare", "max_fare", "mean_fare")


_COUNTED = ", ".join(f"count(*) FILTER (WHERE health IN ({h})) AS {n}" for n, h in (("successful", "'SUCCESS', 'SUCCESS_WITH_LOW_DATA'"), ("no_inventory", "'NO_INVENTORY'"), ("failed", "'FAILED'")))


@query(f"""WITH {AUDITED_CTE}, c AS (SELECT count(*) AS runs, {_COUNTED}, count(*) FILTER (WHERE notes = '') AS consistent, sum(stored)::BIGINT AS stored, round(avg(seconds), 4) AS mean_seconds FROM audits)
SELECT *, round(100.0::DOUBLE * successful / runs, 4) AS successful_rate, round(100.0::DOUBLE * no_inventory / runs, 4) AS no_inventory_rate, round(100.0::DOUBLE * failed / runs, 4) AS failed_rate, round(100.0::DOUBLE * consistent / runs, 4) AS consistent_rate FROM c""")
def audit_targets_batch(spark: SparkSession, root: str) -> DataFrame:
    return audit.batch_summary(audits(spark, root))


@query(f"""WITH {AUDITED_CTE} SELECT run_id, health, notes FROM audits WHERE started_at >= TIMESTAMPTZ '2026-06-05 18:30:00+00' AND started_at < TIMESTAMPTZ '2026-06-06 18:30:00+00' AND source_id IN (1, 3)""")
def audit_day(spark: SparkSession, root: str) -> DataFrame:
    """The audit of one local day's runs of two sources."""
    picked = audit.runs_on(runs(spark, root), "2026-06-06", ZONE, [1, 3])
    return audit.audit_runs(picked, fares(spark, root)).select("run_id", "health", "notes")


@query(f"""WITH {AUDITED_CTE} SELECT source_id, count(seconds) AS runs, round(avg(seconds), 4) AS mean, median(seconds)::DOUBLE AS median, min(seconds)::DOUBLE AS least, max(seconds)::DOUBLE AS most FROM audits GROUP BY 1""")
def run_durations(spark: SparkSession, root: str) -> DataFrame:
    return audit.durations(audits(spark, root), ["source_id"])


@query(f"""WITH {AUDITED_CTE}, f AS (SELECT source_id, count(*) FILTER (WHERE health = 'FAILED') AS failures FROM audits GROUP BY 1)
SELECT source_id, failures, CASE WHEN failures = 0 THEN 'READY' WHEN failures <= 5 THEN 'READY_WITH_WARNINGS' ELSE 'NOT_READY' END AS readiness FROM f""")
def source_readiness(spark: SparkSession, root: str) -> DataFrame:
    failures = audits(spark, root).groupBy("source_id").agg(F.count_if(F.col("health") == "FAILED").alias("failures"))
    return failures.withColumn("readiness", audit.readiness(F.col("failures")))


@query(f"WITH {RUNS_CTE} SELECT observation_id, f.run_id FROM fare_observations f JOIN runs r USING (run_id) WHERE f.data_source_id <> r.source_id OR observed_at < started_at OR observed_at > completed_at")
def announced_disagreements(spark: SparkSession, root: str) -> DataFrame:
    return audit.disagreements(runs(spark, root), fares(spark, root)).select("observation_id", "run_id")


@query(f"WITH {RUNS_CTE} SELECT run_id, source_id FROM runs WHERE status = 'RUNNING'")
def orphan_runs(spark: SparkSession, root: str) -> DataFrame:
    return ingest.orphans(runs(spark, root)).select("run_id", "source_id")


@query(f"""WITH {RUNS_CTE} SELECT run_id, CASE WHEN status = 'RUNNING' AND started_at < TIMESTAMPTZ '2026-06-09 21:00:00+00' THEN 'FAILED' ELSE status END AS status,
CASE WHEN status = 'RUNNING' AND started_at < TIMESTAMPTZ '2026-06-09 21:00:00+00' THEN 'stuck' ELSE error_summary END AS error_summary FROM runs""")
def stuck_runs(spark: SparkSession, root: str) -> DataFrame:
    return ingest.fail_stuck(runs(spark, root), F.expr("timestamp '2026-06-10 00:00:00 UTC'")).select("run_id", "status", "error_summary")


_TASKS = "tasks AS (SELECT r.route_id, w.window_id, w.window_code FROM routes r CROSS JOIN booking_windows w WHERE r.is_active AND w.is_active)"


@query(f"""WITH {RUNS_CTE}, {_TASKS}, last AS (SELECT target_route_id, target_window_id, arg_max(struct_pack(run_id, status, records_scraped), (started_at, run_id)) AS x FROM runs WHERE target_route_id IS NOT NULL AND target_window_id IS NOT NULL GROUP BY 1, 2)
SELECT route_id, window_id, x.run_id AS run_id, coalesce(x.status, 'NOT_STARTED') AS status, coalesce(x.records_scraped, 0) AS records_scraped FROM tasks LEFT JOIN last ON route_id = target_route_id AND window_id = target_window_id""")
def task_states(spark: SparkSession, root: str) -> DataFrame:
    tasks = dimensions.task_matrix(table(spark, root, "routes"), table(spark, root, "booking_windows"), "2026-06-06").select("route_id", "window_id")
    return ingest.task_states(tasks, runs(spark, root))


SQL["task_counts"] = f"WITH s AS ({SQL['task_states']}), e AS (SELECT unnest(['COMPLETED', 'FAILED', 'RUNNING', 'NOT_STARTED']) AS status) SELECT e.status, count(s.route_id) AS tasks FROM e LEFT JOIN s USING (status) GROUP BY 1"


@query()
def task_counts(spark: SparkSession, root: str) -> DataFrame:
    every = spark.createDataFrame([(s,) for s in ("COMPLETED", "FAILED", "RUNNING", "NOT_STARTED")], "status string")
    counts = task_states(spark, root).groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("tasks"))


@query(f"WITH {_TASKS} SELECT window_code, 3 * count(*) AS tasks, count(DISTINCT route_id) AS routes, 6.0::DOUBLE * count(*) AS pause_seconds FROM tasks WHERE window_code IN ('T+1', 'T+7') GROUP BY 1")
def cycle_plan(spark: SparkSession, root: str) -> DataFrame:
    """What a cycle over three sources and two windows would do, without doing it."""
    tasks = dimensions.task_matrix(table(spark, root, "routes"), table(spark, root, "booking_windows"), "2026-06-06")
    return ingest.cycle_plan(tasks.where(F.upper("window_code").isin("T+1", "T+7")), ["A", "B", "C"])


# --- ingestion -------------------------------------------------------------------------------------------------------------

_FINGER = """sha256(concat_ws('|', upper(trim(coalesce(airline, ''))), coalesce(flight, ''), coalesce(upper(trim(origin)), ''), coalesce(upper(trim(destination)), ''), coalesce(strftime(travel_date, '%Y-%m-%d'), ''),
  coalesce(nullif(upper(trim(departure_time[1:5])), ''), 'NONE'), coalesce(nullif(upper(trim(cabin_class)), ''), 'ECONOMY'), coalesce(nullif(upper(trim(fare_family)), ''), 'NONE')))"""
INGEST_CTE = f"""
named AS (SELECT upper(airline_code) AS k, min(airline_id) AS airline_id FROM (SELECT airline_code, airline_id FROM airlines UNION ALL SELECT airline_name, airline_id FROM airlines) GROUP BY 1),
flights AS (
  SELECT q.*, regexp_replace(upper(trim(flight_number)), '\\s+', ' ', 'g') AS fn, s.source_id, s.source_id * 100000 + (CAST(observed_at AS DATE) - DATE '2026-01-01') AS run_id FROM flight_quotes q LEFT JOIN data_sources s ON s.source_name = q.source),
f AS (SELECT *, CASE WHEN regexp_matches(fn, '{X.CARRIER}') THEN regexp_replace(fn, '{X.CARRIER}', '\\1 \\2') ELSE fn END AS flight FROM flights),
mapped AS (
  SELECT f.*, {_FINGER} AS finger, CASE WHEN a.airline_id IS NULL THEN 'airline' WHEN r.route_id IS NULL THEN 'route' WHEN trim(coalesce(flight_number, '')) = '' THEN 'flight_number' WHEN travel_date IS NULL THEN 'travel_date'
    WHEN observed_at IS NULL THEN 'observed_at' WHEN coalesce(total_fare, 0) <= 0 THEN 'total_fare' END AS error
  FROM f LEFT JOIN named a ON a.k = upper(trim(airline)) LEFT JOIN routes r ON r.route_code = concat_ws('-', upper(trim(origin)), upper(trim(destination)))),
earlier AS (SELECT DISTINCT run_id, source_id, finger FROM mapped WHERE hour(observed_at) < 9),
outcomes AS (
  SELECT m.*, CASE WHEN error IS NOT NULL THEN 'FAILED' WHEN e.finger IS NOT NULL OR row_number() OVER (PARTITION BY m.run_id, m.source_id, m.finger, error IS NULL ORDER BY quote_id) > 1 THEN 'SKIPPED' ELSE 'INSERTED' END AS outcome
  FROM mapped m LEFT JOIN earlier e ON e.run_id = m.run_id AND e.source_id = m.source_id AND e.finger = m.finger)
"""


def ingested(spark: SparkSession, root: str) -> DataFrame:
    """All quotes, as runs of a source and day; what was observed before nine o'clock an earlier attempt has stored."""
    sources = table(spark, root, "data_sources").select(F.col("source_name").alias("source"), "source_id")
    quotes = table(spark, root, "flight_quotes").join(broadcast_if_small(sources), "source", "left")
    quotes = quotes.withColumn("run_id", F.col("source_id").cast("bigint") * 100000 + F.date_diff(X.local_date("observed_at"), F.lit("2026-01-01").cast("date")))
    announced = quotes.select("run_id", "source_id").where("run_id is not null").distinct()
    fingerprint = ingest.observation()["fingerprint_hash"]
    earlier = quotes.where(F.hour("observed_at") < 9).select("run_id", F.col("source_id").alias("data_source_id"), fingerprint.alias("fingerprint_hash"))
    rows = ingest.resolved(quotes.drop("source_id"), table(spark, root, "airlines"), table(spark, root, "routes"))
    return ingest.ingest(rows, announced, earlier)


@query(f"WITH {INGEST_CTE} SELECT quote_id, run_id, finger AS fingerprint_hash, outcome, error FROM outcomes")
def ingest_outcomes(spark: SparkSession, root: str) -> DataFrame:
    return ingested(spark, root).select("quote_id", "run_id", "fingerprint_hash", "outcome", "error")


@query(f"""WITH {INGEST_CTE}, c AS (SELECT run_id, count(*) AS quotes, count(*) FILTER (WHERE outcome = 'INSERTED') AS inserted, count(*) FILTER (WHERE outcome = 'SKIPPED') AS skipped, count(*) FILTER (WHERE outcome = 'FAILED') AS failed FROM outcomes GROUP BY 1)
SELECT *, CASE WHEN failed > 0 AND inserted = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM c""")
def ingest_counts(spark: SparkSession, root: str) -> DataFrame:
    return ingest.ingest_counts(ingested(spark, root))


@query("""SELECT quote_id FROM (SELECT quote_id, row_number() OVER (PARTITION BY source, CAST(observed_at AS DATE), flight_number, departure_time, total_fare, fare_family ORDER BY quote_id) AS n FROM flight_quotes) WHERE n = 1""")
def first_cards(spark: SparkSession, root: str) -> DataFrame:
    """Each flight, departure, fare and family of a source's day once, as a page's cards are stored."""
    quotes = table(spark, root, "flight_quotes").withColumn("day", X.local_date("observed_at"))
    return ingest.first_of_page(quotes, ["source", "day"], ["flight_number", "departure_time", "total_fare", "fare_family"], "quote_id").select("quote_id")


# --- basket ----------------------------------------------------------------------------------------------------------------

BASKET_CTE = """
directed AS (SELECT split_part(route_code, '-', 1) AS o, split_part(route_code, '-', 2) AS d, count(*) AS p FROM fare_observations JOIN routes USING (route_id) GROUP BY 1, 2),
pairs AS (SELECT least(o, d) AS city_a, greatest(o, d) AS city_b, coalesce(sum(p) FILTER (WHERE o < d), 0)::BIGINT AS passengers_to, coalesce(sum(p) FILTER (WHERE o > d), 0)::BIGINT AS passengers_from, sum(p)::BIGINT AS total_traffic FROM directed WHERE o <> d GROUP BY 1, 2),
w AS (SELECT *, (total_traffic::DOUBLE / sum(total_traffic) OVER ())::DECIMAL(20,16) AS weight_raw, round((total_traffic::DOUBLE / sum(total_traffic) OVER ())::DECIMAL(20,16), 8)::DOUBLE AS weight FROM pairs)
"""


def basket_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The observations of each route as the traffic between its two airports."""
    ends = table(spark, root, "routes").select("route_id", F.substring_index("route_code", "-", 1).alias("origin"), F.substring_index("route_code", "-", -1).alias("destination"))
    volume = fares(spark, root).groupBy("route_id").agg(F.count("*").alias("passengers"))
    return basket.weighted(basket.undirected(volume.join(ends, "route_id")))


@query(f"WITH {BASKET_CTE} SELECT city_a, city_b, passengers_to, passengers_from, total_traffic, weight, left(city_a, 2) AS city_a_code, CASE WHEN city_b = 'XXX' THEN 'X' ELSE left(city_b, 3) END AS city_b_code FROM w")
def basket_ingest(spark: SparkSession, root: str) -> DataFrame:
    pairs = basket_pairs(spark, root).drop("weight_raw").withColumn("weight", F.col("weight").cast("double"))
    coded = basket.with_codes(pairs, {"XXX": "X"}, ["city_b"])
    return coded.withColumn("city_a_code", X.short_code("city_a", {}, 2))


@query(f"""WITH {BASKET_CTE}, t AS (SELECT count(*) AS pairs, sum(total_traffic)::BIGINT AS traffic, round(sum(weight_raw)::DOUBLE, 9) AS weight_raw, sum(weight::DECIMAL(10,8))::DOUBLE AS weight, count(*) FILTER (WHERE passengers_to + passengers_from <> total_traffic) AS wrong_totals,
  count(*) FILTER (WHERE abs(weight - total_traffic / (SELECT sum(total_traffic) FROM w)) > 1e-6) AS wrong_weights FROM w)
SELECT *, pairs = (SELECT count(DISTINCT least(split_part(route_code, '-', 1), split_part(route_code, '-', 2)) || greatest(split_part(route_code, '-', 1), split_part(route_code, '-', 2))) FROM routes WHERE route_id IN (SELECT route_id FROM fare_observations))
  AND wrong_totals = 0 AND wrong_weights = 0 AND abs(weight - 1) <= pairs * 1e-8 AS passed FROM t""")
def basket_check(spark: SparkSession, root: str) -> DataFrame:
    pairs = basket_pairs(spark, root)
    return basket.basket_checks(pairs, pairs.count())


@query(f"""WITH {STORED_CTE}, cities AS (SELECT origin_city_id AS city_id, min(split_part(route_code, '-', 1)) AS city_code FROM routes GROUP BY 1 UNION SELECT destination_city_id, min(split_part(route_code, '-', 2)) FROM routes GROUP BY 1),
c AS (SELECT city_id, min(city_code) AS city_code FROM cities GROUP BY 1)
SELECT r.route_id, r.route_code, o.city_code AS origin, d.city_code AS destination, w.weight::DOUBLE AS weight FROM weights w JOIN routes r USING (route_id) JOIN c o ON o.city_id = r.origin_city_id JOIN c d ON d.city_id = r.destination_city_id WHERE r.is_active AND w.volume > 50""")
def active_basket(spark: SparkSession, root: str) -> DataFrame:
    routes = table(spark, root, "routes")
    ends = [routes.select(F.col(f"{side}_city_id").alias("city_id"), F.substring_index("route_code", "-", n).alias("city_code")) for side, n in (("origin", 1), ("destination", -1))]
    cities = ends[0].unionByName(ends[1]).groupBy("city_id").agg(F.min("city_code").alias("city_code"))
    weights = index.route_weights(fares(spark, root)).withColumn("is_active", F.col("volume") > 50)
    return basket.active_basket(weights, routes, cities).withColumn("weight", F.col("weight").cast("double"))


# --- further checks and reports ---------------------------------------------------------------------------------------------

@query("""SELECT window_id, count(*) AS rows, count(*) FILTER (WHERE travel_date = CAST(observed_at AT TIME ZONE 'Asia/Kolkata' AS DATE) + CASE window_id WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 15 WHEN 4 THEN 30 WHEN 5 THEN 45 END) AS right_dates FROM fare_observations GROUP BY 1""")
def window_dates(spark: SparkSession, root: str) -> DataFrame:
    """By window, how many rows have the travel date that it means on their local day."""
    fits = F.col("travel_date") == F.date_add(X.local_date("observed_at", ZONE), index.target_days())
    return fares(spark, root).groupBy("window_id").agg(F.count("*").alias("rows"), F.count_if(fits).alias("right_dates"))


@query("""SELECT observation_id FROM fare_observations WHERE observed_at < TIMESTAMPTZ '2026-06-10 00:00:00+00' AND created_at >= TIMESTAMPTZ '2026-06-11 00:00:00+00'""")
def changed_history(spark: SparkSession, root: str) -> DataFrame:
    """Rows of closed days that were loaded after their close."""
    return fares(spark, root).where("observed_at < timestamp '2026-06-10 00:00:00 UTC' and created_at >= timestamp '2026-06-11 00:00:00 UTC'").select("observation_id")


_SPLIT = """SELECT {key}, count(*) FILTER (WHERE source_type = 'AIRLINE_DIRECT') AS direct, count(*) FILTER (WHERE source_type = 'OTA') AS ota, count(*) AS rows, count(DISTINCT run_id) AS tasks, round(count(*)::DOUBLE / count(DISTINCT run_id), 4) AS rows_per_task
FROM fare_observations LEFT JOIN data_sources ON source_id = data_source_id GROUP BY 1"""


@query(_SPLIT.format(key="route_id"))
def route_split(spark: SparkSession, root: str) -> DataFrame:
    return audit.source_split(fares(spark, root), "route_id", broadcast_if_small(table(spark, root, "data_sources")))


@query(_SPLIT.format(key="window_id"))
def window_split(spark: SparkSession, root: str) -> DataFrame:
    return audit.source_split(fares(spark, root), "window_id", broadcast_if_small(table(spark, root, "data_sources")))


@query("""WITH c AS (SELECT route_id, count(*) FILTER (WHERE window_id = 4) AS w4, count(*) FILTER (WHERE window_id = 5) AS w5 FROM fare_observations WHERE cabin_class = 'BUSINESS' AND observed_at < TIMESTAMPTZ '2026-06-12 00:00:00+00' GROUP BY 1)
SELECT *, CASE WHEN least(w4, w5) >= 5 THEN 'SUCCESS' WHEN w4 + w5 > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS state FROM c""")
def route_states(spark: SparkSession, root: str) -> DataFrame:
    early = fares(spark, root).where("cabin_class = 'BUSINESS' and observed_at < timestamp '2026-06-12 00:00:00 UTC'")
    return audit.route_status(early, [4, 5])


@query("""SELECT quote_id, CASE WHEN upper(trim(origin)) = upper(trim(destination)) THEN 'origin is destination' WHEN NOT coalesce(regexp_matches(upper(trim(origin)), '^[A-Z]{3}$'), FALSE) THEN 'origin' WHEN NOT coalesce(regexp_matches(upper(trim(destination)), '^[A-Z]{3}$'), FALSE) THEN 'destination'
  WHEN travel_date - CAST(observed_at AS DATE) NOT IN (7) THEN 'advance days' END AS error FROM flight_quotes""")
def task_errors(spark: SparkSession, root: str) -> DataFrame:
    """Quotes as tasks of the window T+7: what is wrong with each."""
    return table(spark, root, "flight_quotes").select("quote_id", X.task_error(F.col("origin"), F.col("destination"), X.local_date("observed_at"), F.col("travel_date"), F.lit(7)).alias("error"))


@query("""SELECT result_id, coalesce(contains(lower(page_title), 'flights') AND NOT contains(lower(page_title), 'search results'), FALSE) AS fits, coalesce(regexp_matches(page_title, '\\b' || left(route_code, 3) || '\\b') OR (left(route_code, 3) = 'LNO' AND regexp_matches(page_title, '\\blunekot\\b', 'i')), FALSE) AS names_origin FROM diagnostic_results""")
def airport_checks(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "diagnostic_results")
    return pages.select("result_id", X.airport_fits("page_title", ["flights"], ["search results"]).alias("fits"), X.names_any("page_title", F.substring("route_code", 1, 3), {"LNO": ["Lunekot"]}).alias("names_origin"))


@query("""SELECT source_id, source_code, CASE WHEN (contains(source_code, 'BAZ') OR contains(source_code, 'LOOM') OR source_code LIKE '%\\_OTA' ESCAPE '\\') AND source_type = 'AIRLINE_DIRECT' THEN 'OTA' ELSE source_type END AS source_type,
  CASE WHEN source_id = 1 THEN ['ONE', 'TWO'] ELSE list_distinct(['ONE', upper(source_code)]) END AS listed FROM data_sources""")
def source_types(spark: SparkSession, root: str) -> DataFrame:
    """Types of sources after the correction for agencies, and lists of sources as a cycle would name them."""
    asked = F.when(F.col("source_id") == 1, F.lit(" , ")).otherwise(F.concat(F.lit("uno, "), F.lower("source_code"), F.lit(",UNO")))
    listed = F.sort_array(X.source_list(asked, {"uno": "ONE"}, ["ONE", "TWO"]))
    return table(spark, root, "data_sources").select("source_id", "source_code", X.source_type(F.col("source_code"), F.col("source_type"), ["BAZ", "LOOM"]).alias("source_type"), listed.alias("listed"))


SQL["source_types"] = SQL["source_types"].replace("SELECT source_id, source_code,", "SELECT source_id, source_code,").replace("AS listed", "AS unsorted").join(["SELECT source_id, source_code, source_type, list_sort(unsorted) AS listed FROM (", ")"])


# --- published tables --------------------------------------------------------------------------------------------------------

@query(f"""WITH l AS (SELECT route_id, window_id, list_sort(list((representative_fare * 100)::BIGINT)) AS v, count(representative_fare) AS c FROM route_daily_summary WHERE observation_date < DATE '{BASE_END}' AND representative_fare IS NOT NULL GROUP BY ALL),
h AS (SELECT *, v[(c + 1) // 2] + v[c // 2 + 1] AS s, 2 AS n FROM l), base AS (SELECT route_id, window_id, {HALF_EVEN}::DOUBLE AS b FROM h),
one AS (SELECT route_id, window_id, observation_date, arg_min(representative_fare, summary_id)::DOUBLE AS fare FROM route_daily_summary WHERE representative_fare IS NOT NULL GROUP BY ALL)
SELECT observation_date AS index_date, route_id, window_id, round_even(fare / b * 100, 6) AS price_relative FROM one JOIN base USING (route_id, window_id) WHERE b > 0""")
def published_relatives(spark: SparkSession, root: str) -> DataFrame:
    """Price relatives with the digits of the published tables, half to even."""
    return index.price_relatives(stored_summary(spark, root), index.base_fares(table(spark, root, "route_daily_summary"), BASE_END))


@query(f"""WITH {STORED_CTE}, n AS (SELECT index_date, NULL::INT AS route_id, 'DAILY' AS period, round(index_value, 3) AS index_value, routes_included AS parts FROM national),
r AS (SELECT index_date, route_id::INT, 'DAILY' AS period, round(index_value, 3) AS index_value, windows_included FROM route_level WHERE route_id <> 2)
SELECT * FROM n UNION ALL SELECT * FROM r""")
def published_index(spark: SparkSession, root: str) -> DataFrame:
    """One table of route and national indices, published in three steps, the last two of them twice: nothing is doubled or lost.

    The key of a national row has no route; a first step wrote wrong values, a last one takes a route out.
    """
    routes = index.route_index(relatives(spark, root), digits=FINE)
    national = index.national_index(routes, index.route_weights(fares(spark, root)), FINE)
    value = F.round("index_value", 3).alias("index_value")
    by_route = routes.select("index_date", "route_id", F.lit("DAILY").alias("period"), value, F.col("windows_included").alias("parts"))
    of_all = checkpoint(national.select("index_date", F.lit(None).cast("int").alias("route_id"), F.lit("DAILY").alias("period"), value, F.col("routes_included").alias("parts")))
    path = f"{ensure_checkpoint_dir(spark)}/published-index-{root.strip('/').replace('/', '-')}-{spark.sparkContext.applicationId}"
    keys = ["index_date", "route_id", "period"]
    merge.upsert(of_all.withColumn("index_value", F.lit(0.0)), path, keys)
    for _ in range(2):
        merge.upsert(of_all, path, keys)
        merge.upsert(by_route, path, keys)
    merge.delete_where(path, spark, "route_id = 2")
    return merge.stored(spark, path)

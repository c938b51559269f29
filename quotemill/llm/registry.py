"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import digests, leaks, matching, packing, residue, spans, survivors
from quotemill.runtime import table


def p1_flights(spark: SparkSession, root: str) -> DataFrame:
    return matching.match_quotes(table(spark, root, "flight_quotes"), table(spark, root, "airlines"))


def p1_pairs(spark: SparkSession, root: str) -> DataFrame:
    return matching.matched_pairs(p1_flights(spark, root))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_pairs(spark, root).select("quote_id_a", "quote_id_b")


def p4_golden(spark: SparkSession, root: str) -> DataFrame:
    records, observations, trust = (table(spark, root, t) for t in ("reconciled_flights", "fare_observations", "source_trust"))
    return survivors.flight_survivors(records, observations, trust).withColumn("reconciled_fare", F.col("reconciled_fare").cast("double"))


def p4_undated(spark: SparkSession, root: str) -> DataFrame:
    """The survivors if a third of the records had no time: their place is what the other two thirds teach."""
    records, observations, trust = (table(spark, root, t) for t in ("reconciled_flights", "fare_observations", "source_trust"))
    records = records.withColumn("reconciled_at", F.when(F.col("record_id") % 3 != 0, F.col("reconciled_at")))
    return survivors.flight_survivors(records, observations, trust).select(*survivors.GROUP, "records", "best_record", "scheduled_departure_time", "selected_source_id")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_golden(spark, root).where("best_record is not null").select(F.col("best_record").alias("record_id"))


def p4_precedence(spark: SparkSession, root: str) -> DataFrame:
    rows = survivors.flight_groups(table(spark, root, "reconciled_flights"))
    rows = rows.withColumn("departure", F.substring(survivors.usable_text("scheduled_departure_time"), 1, 5))
    return survivors.precedence(rows, survivors.GROUP, ["departure"], "reconciled_at").select("field", "old", "new", "n")


def p5_percentiles(spark: SparkSession, root: str) -> DataFrame:
    fares = table(spark, root, "fare_observations")
    return digests.certified_percentiles(fares, ["route_id", "window_id"], "total_fare", part=F.to_date("observed_at"))


def p5_digests(spark: SparkSession, root: str) -> DataFrame:
    """The mergeable form: one digest per route, window and day of observation."""
    fares = table(spark, root, "fare_observations")
    return digests.build(fares, ["route_id", "window_id"], "total_fare", F.to_date("observed_at")).withColumnRenamed("part", "day")


def p5_certified(spark: SparkSession, root: str) -> DataFrame:
    return p5_percentiles(spark, root).select("route_id", "window_id", "quantile", "n", "certified")


def p5_by_flight(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of each flight on its route and window: of up to 600 fares by digests, which are exact then, of more by exact ranks."""
    fares = table(spark, root, "fare_observations").withColumn("flight", F.upper(F.trim("flight_number")))
    keys = ["route_id", "window_id", "airline_id", "flight"]
    more = fares.groupBy(*keys).agg(F.count("total_fare").alias("n")).where("n > 600").select(*[F.col(k).alias(f"_{k}") for k in keys])
    small, large = fares, None
    if not more.isEmpty():
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        small, large = fares.join(more, same, "left_anti"), fares.join(more, same, "left_semi")
    out = digests.certified_percentiles(small, keys, "total_fare", part=F.to_date("observed_at"), compression=2000)
    out = out.select(*keys, "quantile", "value", "n", "rank_error")
    return out if large is None else out.unionByName(digests.exact_percentiles(large, keys, "total_fare").withColumn("rank_error", F.lit(0.0)))


P5_BY_FLIGHT_SQL = """
WITH g AS (
  SELECT route_id, window_id, airline_id, upper(trim(flight_number)) AS flight, count(*) AS n, list_sort(list(total_fare::DOUBLE)) AS v FROM fare_observations WHERE total_fare IS NOT NULL GROUP BY ALL)
SELECT route_id, window_id, airline_id, flight, q::DOUBLE AS quantile, v[greatest(1, ceil(q::DOUBLE * n))::INT] AS value, n, 0.0::DOUBLE AS rank_error
FROM g CROSS JOIN (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q) WHERE n <= 600
"""

P5_CERTIFIED_SQL = """
SELECT route_id, window_id, quantile::DOUBLE AS quantile, count(total_fare) AS n, TRUE AS certified
FROM fare_observations CROSS JOIN (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS quantile)
WHERE total_fare IS NOT NULL GROUP BY ALL
"""


def p6_residue(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_records(table(spark, root, "diagnostic_results"), "result_id", "page_title", "alert_texts")


def p6_clean(spark: SparkSession, root: str) -> DataFrame:
    """What is left when the records with residue are excluded."""
    records = table(spark, root, "diagnostic_results").select("result_id", "page_title", "alert_texts")
    return residue.without_residue(records, "result_id", "page_title", "alert_texts").select("result_id")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_residue(spark, root).select("result_id")


def p7_packed(spark: SparkSession, root: str, vocabulary: str = packing.VOCABULARY) -> DataFrame:
    """Packs of each capacity of pack_sizes on its own, and as pack 0 of all capacities jointly."""
    sizes = packing.capacities_of(table(spark, root, "pack_sizes"))
    plans = {pack: [tokens] for pack, tokens in sizes.items()} | ({0: list(sizes.values())} if sizes else {})
    placed = packing.pack_texts(table(spark, root, "documents"), "doc_id", "text", plans, vocabulary)
    return placed.withColumnsRenamed({"pack": "pack_id", "id": "doc_id"})


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill(p7_packed(spark, root).withColumnRenamed("pack_id", "pack"))


def p7_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document lies whole in every pack: all its pieces, once."""
    placed = p7_packed(spark, root).groupBy("pack_id", "doc_id").agg(F.min("first_token").alias("first_token"))
    return placed.select("pack_id", "doc_id", "first_token")


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaked_items(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks(spark, root).select("doc_id", "item_id")


def p8_edited(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold twelve words of an item with at most one character changed."""
    return leaks.leaked_items(
        table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text", leaks.LeakSettings(exact=False)
    ).select("doc_id", "item_id")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_spans(table(spark, root, "documents"), "doc_id", "text").withColumnsRenamed({"a": "doc_id_a", "b": "doc_id_b"})


def p9_classes(spark: SparkSession, root: str) -> DataFrame:
    return spans.linked_classes(table(spark, root, "documents"), "doc_id", "text")


def p9_share(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_share(table(spark, root, "documents"), "doc_id", "text")


P7_DOCUMENTS_SQL = """
SELECT pack_id, doc_id, 0::BIGINT AS first_token
FROM documents CROSS JOIN (SELECT pack_id::BIGINT AS pack_id FROM pack_sizes UNION ALL SELECT 0) WHERE doc_id IS NOT NULL
"""

_GROUPED = """
WITH base AS (
  SELECT *, regexp_split_to_array(flight_identity_key, '\\s*[|;]\\s*') AS k FROM reconciled_flights),
cleaned AS (
  SELECT *, CASE WHEN upper(trim(flight_number)) NOT IN ('', '-', 'N/A', 'NULL', 'NONE', 'TBA') THEN trim(flight_number) END AS fn,
    CASE WHEN upper(trim(cabin_class)) NOT IN ('', '-', 'N/A', 'NULL', 'NONE', 'TBA') THEN upper(trim(cabin_class)) END AS cb,
    CASE WHEN upper(trim(scheduled_departure_time)) NOT IN ('', '-', 'N/A', 'NULL', 'NONE', 'TBA') THEN trim(scheduled_departure_time)[1:5] END AS dep
  FROM base),
grouped AS (
  SELECT *, coalesce(regexp_replace(upper(fn), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(k[2]), '[^A-Z0-9]', '', 'g')) AS g_flight,
    CASE WHEN coalesce(cb, upper(trim(k[6])))[1] IN ('E', 'Y') THEN 'ECONOMY' ELSE 'BUSINESS' END AS g_cabin
  FROM cleaned)
"""

_SCORED = _GROUPED + """,
scored AS (
  SELECT g.*, o.observation_id, t.source_id AS src, CASE WHEN fn IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN dep IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN cb IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN reconciled_fare > 0 THEN 1 ELSE 0 END
      + CASE WHEN o.observation_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN t.source_id IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN len(sources_represented) > 0 THEN 1 ELSE 0 END AS u, coalesce(t.trust_rank, 1000000) AS r
  FROM grouped g LEFT JOIN fare_observations o ON o.observation_id = g.selected_observation_id
  LEFT JOIN source_trust t ON t.source_id = g.selected_source_id)
"""

P4_FOUND_SQL = _SCORED + """,
tops AS (
  SELECT *, count(*) OVER w AS n, max(u) OVER w AS mu, max(reconciled_at) OVER w AS mt, min(r) OVER w AS mr FROM scored
  WINDOW w AS (PARTITION BY airline_id, g_flight, route_id, travel_date, g_cabin)),
great AS (
  SELECT *, count(*) OVER (PARTITION BY airline_id, g_flight, route_id, travel_date, g_cabin) AS c FROM tops
  WHERE n > 1 AND u = mu AND reconciled_at = mt AND r = mr)
SELECT record_id FROM great WHERE c = 1
"""

_NAMED = "airline_id::VARCHAR AS airline_id, g_flight, route_id::VARCHAR AS route_id, strftime(travel_date, '%Y-%m-%d') AS travel_date, g_cabin"


def _latest(value: str, name: str) -> str:
    return f"arg_max({value}, (reconciled_at, -r, u, -record_id)) FILTER (WHERE {value} IS NOT NULL) AS {name}"


P4_GOLDEN_SQL = _SCORED + f""",
facts AS (
  SELECT *, upper(regexp_replace(fn, '^([A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z][A-Za-z])[\\s-]*', '\\1 ')) AS v_flight, CASE WHEN cb IS NOT NULL THEN g_cabin END AS v_cabin,
    CASE WHEN reconciled_fare > 0 THEN reconciled_fare::DOUBLE END AS v_fare, CASE WHEN len(sources_represented) > 0 THEN sources_represented END AS v_sources FROM scored),
tops AS (
  SELECT airline_id, g_flight, route_id, travel_date, g_cabin, count(*) AS n, max(u) AS mu, max(reconciled_at) AS mt, min(r) AS mr, {_latest("v_flight", "flight_number")}, {_latest("dep", "scheduled_departure_time")},
    {_latest("v_cabin", "cabin_class")}, {_latest("v_fare", "reconciled_fare")}, {_latest("observation_id", "selected_observation_id")}, {_latest("src", "selected_source_id")}, {_latest("v_sources", "sources_represented")}
  FROM facts GROUP BY ALL),
great AS (
  SELECT t.airline_id, t.g_flight, t.route_id, t.travel_date, t.g_cabin, min(record_id) AS record_id FROM tops t JOIN scored s ON (t.airline_id, t.g_flight, t.route_id, t.travel_date, t.g_cabin) IS NOT DISTINCT FROM (s.airline_id, s.g_flight, s.route_id, s.travel_date, s.g_cabin)
  WHERE n > 1 AND u = mu AND reconciled_at = mt AND r = mr GROUP BY ALL HAVING count(*) = 1)
SELECT t.airline_id::VARCHAR AS airline_id, t.g_flight, t.route_id::VARCHAR AS route_id, strftime(t.travel_date, '%Y-%m-%d') AS travel_date, t.g_cabin, n AS records, mu AS usable_values, record_id AS best_record,
  flight_number, scheduled_departure_time, cabin_class, reconciled_fare, selected_observation_id, selected_source_id, sources_represented
FROM tops t LEFT JOIN great g ON (t.airline_id, t.g_flight, t.route_id, t.travel_date, t.g_cabin) IS NOT DISTINCT FROM (g.airline_id, g.g_flight, g.route_id, g.travel_date, g.g_cabin)
"""

P4_UNDATED_SQL = _SCORED + f""",
x AS (
  SELECT *, CASE WHEN record_id % 3 <> 0 THEN epoch_us(reconciled_at) END AS ts, dense_rank() OVER (ORDER BY airline_id, g_flight, route_id, travel_date, g_cabin) AS g FROM scored),
steps AS (
  SELECT dep, src::VARCHAR AS s, lag(dep) OVER w AS dep0, lag(src::VARCHAR) OVER w AS s0 FROM x WHERE ts IS NOT NULL
  WINDOW w AS (PARTITION BY g ORDER BY ts, dep NULLS FIRST, src::VARCHAR NULLS FIRST)),
moves AS (SELECT 'dep' AS field, dep0 AS old, dep AS new FROM steps WHERE dep0 <> dep UNION ALL SELECT 'src', s0, s FROM steps WHERE s0 <> s),
net AS (SELECT field, least(old, new) AS a, greatest(old, new) AS b, sum(CASE WHEN old < new THEN 1 ELSE -1 END) AS n FROM moves GROUP BY ALL),
edges AS (SELECT field, CASE WHEN n > 0 THEN a ELSE b END AS old, CASE WHEN n > 0 THEN b ELSE a END AS new, abs(n) AS n FROM net WHERE n <> 0),
v AS (SELECT g, record_id, ts, 'dep' AS field, dep AS value FROM x WHERE dep IS NOT NULL UNION ALL SELECT g, record_id, ts, 'src', src::VARCHAR FROM x WHERE src IS NOT NULL),
held AS (SELECT g, field, value, max(ts) AS held FROM v WHERE ts IS NOT NULL GROUP BY ALL),
among AS (
  SELECT g, field, arg_max(value, (held, value)) AS value, TRUE AS dated FROM held GROUP BY g, field
  UNION ALL SELECT DISTINCT g, field, value, FALSE FROM v WHERE ts IS NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.g = v.g AND h.field = v.field AND h.value = v.value)),
pairs AS (SELECT p.g, p.field, p.value AS old, q.value AS new, e.n FROM among p JOIN edges e ON e.field = p.field AND e.old = p.value JOIN among q ON q.g = p.g AND q.field = p.field AND q.value = e.new),
degrees AS (
  SELECT a.*, coalesce((SELECT sum(n) FROM pairs p WHERE p.g = a.g AND p.field = a.field AND p.old = a.value), 0) AS o,
    coalesce((SELECT sum(n) FROM pairs p WHERE p.g = a.g AND p.field = a.field AND p.new = a.value), 0) AS i FROM among a),
ranked AS (SELECT *, CASE WHEN min(o) OVER w = 0 THEN o = 0 ELSE i - o = max(i - o) OVER w END AS latest FROM degrees WINDOW w AS (PARTITION BY g, field)),
placed AS (
  SELECT v.g, v.record_id, max(h.held) AS held, bool_and(r.latest) AS latest, coalesce(bool_or(b.dated), FALSE) AS beaten FROM v LEFT JOIN held h ON h.g = v.g AND h.field = v.field AND h.value = v.value
  LEFT JOIN ranked r ON r.g = v.g AND r.field = v.field AND r.value = v.value AND NOT r.dated LEFT JOIN ranked b ON b.g = v.g AND b.field = v.field AND b.dated AND NOT b.latest
  WHERE v.ts IS NULL GROUP BY ALL),
ends AS (SELECT g, min(ts) AS lo, max(ts) AS hi FROM x GROUP BY g),
ordered AS (
  SELECT x.*, coalesce(ts, held, CASE WHEN NOT latest THEN coalesce(lo, 0) - 1 WHEN latest AND hi IS NULL THEN 0 WHEN latest AND beaten THEN hi + 1 END) AS ord
  FROM x JOIN ends e USING (g) LEFT JOIN placed p ON p.record_id = x.record_id),
tops AS (
  SELECT g, count(*) AS records, max(u) AS mu, max(ord) AS mt, min(r) AS mr, arg_max(dep, (coalesce(ord, -1e18::BIGINT), -r, u, -record_id)) FILTER (WHERE dep IS NOT NULL) AS scheduled_departure_time,
    arg_max(src, (coalesce(ord, -1e18::BIGINT), -r, u, -record_id)) FILTER (WHERE src IS NOT NULL) AS selected_source_id FROM ordered GROUP BY g),
great AS (SELECT g, min(record_id) AS best_record FROM ordered JOIN tops USING (g) WHERE records > 1 AND u = mu AND r = mr AND coalesce(ord = mt, TRUE) GROUP BY g HAVING count(*) = 1),
names AS (SELECT g, {_NAMED} FROM x GROUP BY ALL)
SELECT airline_id, g_flight, route_id, travel_date, g_cabin, records, best_record, scheduled_departure_time, selected_source_id FROM names JOIN tops USING (g) LEFT JOIN great USING (g)
"""

P4_PRECEDENCE_SQL = _GROUPED + """,
steps AS (
  SELECT dep AS new, lag(dep) OVER (PARTITION BY airline_id, g_flight, route_id, travel_date, g_cabin ORDER BY reconciled_at, dep NULLS FIRST) AS old
  FROM grouped WHERE reconciled_at IS NOT NULL)
SELECT 'departure' AS field, old, new, count(*) AS n FROM steps WHERE old <> new GROUP BY ALL
"""

P8_FOUND_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

_WINDOWS = """
WITH long AS (SELECT text, min(doc_id) AS d, count(DISTINCT doc_id) AS n FROM documents WHERE length(text) >= 400 GROUP BY text),
win AS (SELECT d, unnest(range(1, length(text) - 398)) AS k, unnest(list_transform(range(1, length(text) - 398), lambda k: md5(substr(text, k, 400)))) AS h FROM long),
hot AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT d) > 1), shared AS (SELECT d, k, h FROM win SEMI JOIN hot USING (h))
"""

P9_FOUND_SQL = _WINDOWS + """, own AS (SELECT DISTINCT d, h FROM shared)
SELECT DISTINCT a.d AS doc_id_a, b.d AS doc_id_b FROM own a JOIN own b ON a.h = b.h AND a.d < b.d
UNION SELECT l.d, x.doc_id FROM long l JOIN documents x ON x.text = l.text AND x.doc_id <> l.d
"""

P9_SHARE_SQL = _WINDOWS + """,
steps AS (SELECT d, k, lag(k) OVER (PARTITION BY d ORDER BY k) AS p FROM shared),
held AS (SELECT d, sum(least(400, coalesce(k - p, 400)))::BIGINT AS covered, count(*) FILTER (WHERE p IS NULL OR k > p + 400) AS spans FROM steps GROUP BY d),
found AS (
  SELECT x.doc_id, coalesce(length(x.text), 0)::INT AS chars, coalesce(l.n - 1, 0)::BIGINT AS copies, coalesce(h.spans, 0)::BIGINT AS spans, CASE WHEN l.n > 1 THEN length(x.text) ELSE coalesce(h.covered, 0) END::BIGINT AS shared
  FROM documents x LEFT JOIN long l ON l.text = x.text LEFT JOIN held h ON h.d = l.d)
SELECT *, CASE WHEN chars > 0 THEN shared / chars ELSE 0.0 END::DOUBLE AS share FROM found
"""

QUERIES = {
    "p1_found": p1_found, "p1_pairs": p1_pairs, "p1_flights": p1_flights,
    "p4_found": p4_found, "p4_golden": p4_golden, "p4_undated": p4_undated, "p4_precedence": p4_precedence,
    "p5_percentiles": p5_percentiles, "p5_digests": p5_digests, "p5_certified": p5_certified, "p5_by_flight": p5_by_flight,
    "p6_found": p6_found, "p6_residue": p6_residue, "p6_clean": p6_clean,
    "p7_packed": p7_packed, "p7_fill": p7_fill, "p7_documents": p7_documents,
    "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_edited": p8_edited,
    "p9_found": p9_found, "p9_classes": p9_classes, "p9_share": p9_share,
}
SQL = {"p4_found": P4_FOUND_SQL, "p4_golden": P4_GOLDEN_SQL, "p4_undated": P4_UNDATED_SQL, "p4_precedence": P4_PRECEDENCE_SQL, "p5_certified": P5_CERTIFIED_SQL, "p5_by_flight": P5_BY_FLIGHT_SQL, "p7_documents": P7_DOCUMENTS_SQL, "p8_found": P8_FOUND_SQL, "p9_found": P9_FOUND_SQL, "p9_share": P9_SHARE_SQL}

import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quotemill.functions import numbers as N
from quotemill.functions import text as X
from quotemill.operators import audit, basket, cleaning, dimensions, index, merge, pairs
from quotemill.operators import ingest as ingest_op
from quotemill.operators.reconcile import reconcile
from quotemill.sources import readers
from quotemill.streaming import ingest

NOON = dt.datetime(2026, 9, 8, 12)
OBS = (
    "observation_id long, run_id long, data_source_id int, route_id int, airline_id int, window_id int, flight_number string, observed_at timestamp, travel_date date, advance_days int, "
    "scheduled_departure_time string, cabin_class string, total_fare decimal(10,2), currency string, is_available boolean, quality_status string, fingerprint_hash string"
)


def obs(spark, *changes):
    base = dict(run_id=1, data_source_id=1, route_id=1, airline_id=1, window_id=2, flight_number="SG 162", observed_at=NOON, travel_date=dt.date(2026, 9, 15), advance_days=7, scheduled_departure_time="19:55", cabin_class="ECONOMY", total_fare=Decimal(7000), currency="INR", is_available=True, quality_status="VALID", fingerprint_hash=None)
    rows = []
    for n, change in enumerate(changes, 1):
        row = base | {"observation_id": n, "fingerprint_hash": f"h{n}"} | change
        if row["total_fare"] is not None:
            row["total_fare"] = Decimal(str(row["total_fare"]))
        rows.append(row)
    return spark.createDataFrame(rows, OBS) if rows else spark.createDataFrame([], OBS)


def one(df):
    return df.collect()[0]


def test_validity_takes_the_first_rule_broken(spark):
    df = obs(spark, {}, {"total_fare": 0}, {"total_fare": -5}, {"route_id": None}, {"flight_number": "  "}, {"travel_date": None}, {"is_available": False}, {"total_fare": None}, {"currency": ""}, {"is_available": None}, {"flight_number": "", "total_fare": 0})
    got = [r.s for r in df.orderBy("observation_id").select(cleaning.validity()["status"].alias("s")).collect()]
    assert got == ["VALID", "INVALID_FARE", "INVALID_FARE", "MISSING", "MISSING", "MISSING", "SOLD_OUT", "INVALID_FARE", "INVALID_FARE", "VALID", "MISSING"]


def test_clean_flags_in_order(spark):
    fares = [6800, 6900, 7100, 7250, 7400, 65000, -100]
    changes = [{"total_fare": f} for f in fares] + [{"flight_number": ""}, {"is_available": False}, {"fingerprint_hash": "h1", "total_fare": 6800}]
    got = {r.observation_id: r.quality_status for r in cleaning.clean(obs(spark, *changes)).collect()}
    assert got == {1: "VALID", 2: "VALID", 3: "VALID", 4: "VALID", 5: "VALID", 6: "OUTLIER", 7: "INVALID_FARE", 8: "MISSING", 9: "SOLD_OUT", 10: "DUPLICATE"}
    counts = {r.status: r.rows for r in cleaning.status_counts(cleaning.clean(obs(spark, *changes))).collect()}
    assert counts["VALID"] == 5 and counts["CANCELLED"] == 0


def bounds(spark, fares, **cfg):
    return one(cleaning.cohort_stats(obs(spark, *[{"total_fare": f} for f in fares]), cfg=cleaning.OutlierSettings(**cfg)))


def test_outlier_bounds(spark):
    low = bounds(spark, [6490] * 2 + [6530] * 22)
    assert low.low_dispersion and (low.lower_bound, low.upper_bound) == (5877, 7183)
    assert bounds(spark, [7000, 7100, 9e5]).upper_bound is None
    flagged = lambda fares, **cfg: cleaning.with_outlier_flag(obs(spark, *[{"total_fare": f} for f in fares]), cfg=cleaning.OutlierSettings(**cfg)).where("is_outlier").count()
    assert flagged([5000, 5100, 5200, 5300, 5400, 55000]) == 1
    assert flagged([7000, 7100, 7050, 7200, 7150, 48000], method="MAD") == 1
    assert flagged([6490] * 2 + [6530] * 22, relative=0.001, absolute=10) == 2
    with pytest.raises(ValueError):
        cleaning.cohort_stats(obs(spark), cfg=cleaning.OutlierSettings(method="?"))


def test_reconcile_policies(spark):
    df = obs(spark, {"flight_number": "SG 101", "total_fare": 7800, "data_source_id": 1}, {"flight_number": "sg 101 ", "total_fare": 8100, "data_source_id": 3}, {"flight_number": "SG 102", "total_fare": 8000, "data_source_id": 1}, {"flight_number": "SG 102", "total_fare": 7900, "data_source_id": 3})
    df = df.withColumn("is_direct", F.col("data_source_id") == 1)
    pick = lambda policy: {r.flight: (float(r.reconciled_fare), r.selected_source_id, r.all_quotes_count, list(r.sources_represented)) for r in reconcile(df, policy).collect()}
    assert pick("MIN") == {"SG 101": (7800, 1, 2, [1, 3]), "SG 102": (7900, 3, 2, [1, 3])}
    assert pick("DIRECT")["SG 102"] == (8000, 1, 2, [1, 3])
    assert pick("MEAN")["SG 101"][0] == 7950 and pick("MEDIAN")["SG 102"][:2] == (7950, 1)
    with pytest.raises(ValueError):
        reconcile(df, "?")


def test_daily_summary_and_eligibility(spark):
    df = obs(
        spark, {"flight_number": "A 1", "total_fare": 7000}, {"flight_number": "A 2", "total_fare": 8000}, {"flight_number": "A 3", "travel_date": dt.date(2026, 9, 16)}, {"flight_number": "A 4", "cabin_class": "economy"}, {"flight_number": "A 5", "is_available": None},
        {"flight_number": "A 6", "quality_status": "OUTLIER"}, {"route_id": 2, "window_id": 9, "advance_days": 3, "total_fare": 5000},
    )
    got = {r.route_id: r for r in index.daily_summary(df).collect()}
    assert (got[1].observations_count, got[1].geometric_mean_fare, got[1].median_fare, got[1].is_imputed) == (2, 7483.31, 7500, True)
    assert got[2].observations_count == 1  # an unknown expected date keeps the row


def test_chain_of_indices_against_the_worked_example(spark):
    day = dt.date(2026, 9, 1)
    summary = spark.createDataFrame([(day, 1, 1, 7348.98), (day, 1, 2, 7953.12), (day, 2, 1, 6899.28), (day, 2, 2, 7398.20), (day, 3, 1, 1.0)], "observation_date date, route_id int, window_id int, representative_fare double")
    base = spark.createDataFrame([(1, 1, 5800.0), (1, 2, 6000.0), (2, 1, 6200.0), (2, 2, 6400.0), (3, 1, 0.0)], "route_id int, window_id int, benchmark_fare double")
    rel = index.price_relatives(summary, base)
    assert {(r.route_id, r.window_id): r.price_relative for r in rel.collect()} == {(1, 1): 126.706552, (1, 2): 132.552, (2, 1): 111.27871, (2, 2): 115.596875}
    routes = index.route_index(rel)
    assert {r.route_id: r.index_value for r in routes.collect()} == {1: 129.6293, 2: 113.4378}
    weights = spark.createDataFrame([(1, 0.6), (2, 0.4), (9, 1.0)], "route_id int, weight double")
    national = index.national_index(routes, weights)
    assert [tuple(r) for r in national.collect()] == [(day, 123.1527, 2)]
    assert one(index.rollup(national, "MONTHLY")).index_date == day
    bench = spark.createDataFrame([(day, 6850.0)], "period_start date, benchmark double")
    errors = index.absolute_errors(index.rollup(national, "MONTHLY"), bench)
    report = one(index.mean_absolute_error(errors))
    assert (report.matched, report.mape, report.passed) == (1, 98.2022, False)
    assert one(index.mean_absolute_error(errors.limit(0))).mape is None
    with pytest.raises(ValueError):
        index.rollup(national, "DAILY")
    part = index.national_index(routes.where("route_id = 1"), weights)
    assert one(part).index_value == 129.6293 and index.national_index(routes, weights.where("route_id = 9")).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([(4000.0, 0.5), (9000.0, 0.3)], "x double, w double")
    r = one(df.agg(F.round(N.geometric_mean("x"), 2).alias("g"), N.weighted_mean("x", "w").alias("m")))
    assert r.g == 6000 and abs(r.m - 5875) < 1e-9
    with pytest.raises(Exception, match="not positive"):
        df.union(spark.createDataFrame([(0.0, 1.0)], "x double, w double")).agg(N.geometric_mean("x")).collect()
    assert one(df.select(N.percent_error(F.lit(5.0), F.lit(0.0)).alias("e"), N.share(F.lit(1), F.lit(0)).alias("s")))[:] == (0.0, 0.0)


def table_of(spark, values, f):
    return [r.v for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t")).alias("v")).collect()]


def test_texts(spark):
    assert table_of(spark, ["sg-162", " 6E  204", "IX 1165/1027", "AI2483A", None], X.normal_flight_number) == ["SG 162", "6E 204", "IX 1165/1027", "AI 2483A", None]
    assert table_of(spark, ["AI 2483 / AI 2740", "AI 2483/2740", "x"], X.legs) == [["AI 2483", "AI 2740"], ["AI 2483", "AI 2740"], ["X"]]
    assert table_of(spark, ["Rs. 7,890", "INR 7890.50", "₹650", "19:55", "Save 500", "0", None], X.parse_fare) == [Decimal("7890.00"), Decimal("7890.50"), Decimal("650.00"), None, None, None, None]
    assert table_of(spark, ["9:05", "19:55:00", "2026-09-15T19:55:00+05:30", "25:00", "soon"], X.parse_clock) == ["09:05", "19:55", "19:55", None, None]
    assert table_of(spark, ["Non-stop", "2 stops", "Connecting", "?"], X.parse_stops) == [0, 2, 1, None]
    assert table_of(spark, ["on 2026-09-15 and 16 September 2026, 15/09/2026, 2026-99-99", ""], X.dates_in) == [[dt.date(2026, 9, 16), dt.date(2026, 9, 15)], []]
    assert table_of(spark, ["indigo", " Air X ", ""], lambda c: X.mapped(c, {"IndiGo": "6E"})) == ["6E", "Air X", "Unknown"]
    parts = [F.lit(v) for v in ("SpiceJet", "sg162", "del", "BOM")] + [F.lit("2026-09-15").cast("date"), F.lit("19:55"), F.lit("economy"), F.lit("SpiceSaver")]
    assert one(spark.range(1).select(X.fingerprint_text(*parts).alias("t"))).t == "SPICEJET|SG 162|DEL|BOM|2026-09-15|19:55|ECONOMY|SPICESAVER"
    assert one(spark.range(1).select(X.fingerprint(*parts).alias("t"))).t == "41839f6c5c7e194eb382a3f0375e819515bb73ec06c201bad8856ca062bac87c"
    late = spark.createDataFrame([(dt.datetime(2026, 9, 14, 19),)], "t timestamp")
    assert one(late.select(X.local_date("t", "Asia/Kolkata").alias("d"))).d == dt.date(2026, 9, 15)


def test_dimensions(spark):
    windows = spark.createDataFrame([(i, f"T+{d}", d, i, True) for i, d in enumerate((1, 7, 15, 30, 45), 1)], "window_id int, window_code string, target_advance_days int, display_order int, is_active boolean")
    df = spark.createDataFrame([(4,), (11,), (99,), (7,), (None,)], "advance_days int")
    assert [r.nearest_window_id for r in dimensions.nearest_window(df, windows).collect()] == [1, 2, 5, 2, None]
    routes = spark.createDataFrame([(1, 1, 2, "A-B", True), (2, 2, 1, "B-A", True), (3, 1, 3, "A-C", False)], "route_id int, origin_city_id int, destination_city_id int, route_code string, is_active boolean")
    tasks = dimensions.task_matrix(routes, windows, "2026-09-08")
    assert tasks.count() == 10 and {r.travel_date for r in tasks.where("window_id = 2").collect()} == {dt.date(2026, 9, 15)}
    assert dimensions.remaining_tasks(tasks, tasks.where("route_id = 1")).count() == 5
    assert {(r.city_a, r.city_b): list(r.route_ids) for r in dimensions.undirected_pairs(routes).collect()} == {(1, 2): [1, 2], (1, 3): [3]}
    dim = spark.createDataFrame([(4, "A", "x")], "id int, code string, note string")
    facts = spark.createDataFrame([("a",), (" b",), ("C",), ("b",), (None,), ("",)], "code string")
    assert sorted((r.id, r.code) for r in dimensions.get_or_create(facts, dim, "code", "id").collect()) == [(4, "A"), (5, "B"), (6, "C")]


def test_audit(spark):
    rows = obs(spark, *[{"run_id": 101, "total_fare": 3500 + i} for i in range(6)], *[{"run_id": 103} for _ in range(3)], {"run_id": 106}, {"run_id": 106, "fingerprint_hash": ""}, {"run_id": 107, "data_source_id": 2}).withColumn("created_at", F.col("observed_at"))
    runs = spark.createDataFrame([(r, 1, NOON, NOON + dt.timedelta(seconds=30), n, s) for r, n, s in [(101, 6, "COMPLETED"), (102, 0, "COMPLETED"), (103, 3, "COMPLETED"), (104, 0, "FAILED"), (105, 10, "COMPLETED"), (106, 2, "COMPLETED"), (107, 1, "COMPLETED"), (108, 1, "SUCCESS")]], "run_id long, source_id int, started_at timestamp, completed_at timestamp, records_scraped long, status string")
    audits = audit.audit_runs(runs, rows)
    got = {r.run_id: (r.health, r.consistency, r.notes) for r in audits.collect()}
    assert got[101] == ("SUCCESS", "CONSISTENT", "") and got[102][:2] == ("NO_INVENTORY", "CONSISTENT") and got[103][0] == "SUCCESS_WITH_LOW_DATA" and got[104][0] == "FAILED"
    assert got[105] == ("FAILED", "INCONSISTENT", "count_differs") and got[106][2] == "fingerprints_repeat" and got[107][2] == "source_differs" and got[108][0] == "FAILED"
    batch = one(audit.batch_summary(audits))
    assert (batch.runs, batch.failed, batch.no_inventory, batch.mean_seconds) == (8, 3, 1, 30.0)
    assert one(audit.batch_summary(audits.limit(0))).successful_rate == 0
    assert audit.markdown(audits.select("run_id").orderBy("run_id").limit(2)) == "| run_id |\n| --- |\n| 101 |\n| 102 |\n"
    with pytest.raises(ValueError):
        audit.markdown(audits, 3)


def test_merge_and_publish(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, j int, v string")
    merged = merge.merge_by_key(rows((1, None, "a"), (2, 2, "b")), rows((1, None, "new"), (3, 3, "c")), ["k", "j"])
    assert {tuple(r) for r in merged.collect()} == {(1, None, "new"), (2, 2, "b"), (3, 3, "c")}
    assert tuple(one(merge.merge_counts(rows((1, None, "a")), rows((1, None, "n"), (3, 3, "c")), ["k", "j"]))) == (1, 1)
    path = str(tmp_path / "t")
    for _ in range(2):
        merge.upsert(rows((1, 1, "a"), (2, 2, "b")), path, ["k", "j"])
    merge.upsert(rows((2, 2, "z")), path, ["k", "j"])
    assert {tuple(r) for r in merge.stored(spark, path).collect()} == {(1, 1, "a"), (2, 2, "z")}
    merge.delete_where(path, spark, "k = 1")
    assert merge.stored(spark, path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_upsert_keeps_columns_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "index_daily")
    first = spark.createDataFrame([("d1", None, "NATIONAL", 100.0, "x"), ("d1", 1, "ROUTE", 99.0, "y")], "day string, route int, level string, value double, extra string")
    merge.upsert(first, path, ["day", "route", "level"])
    update = spark.createDataFrame([("d1", None, "NATIONAL", 101.0), ("d2", None, "NATIONAL", 102.0)], "day string, route int, level string, value double")
    for _ in range(2):
        merge.upsert(update, path, ["day", "route", "level"])
    got = {tuple(r) for r in merge.stored(spark, path).collect()}
    assert got == {("d1", 1, "ROUTE", 99.0, "y"), ("d1", None, "NATIONAL", 101.0, None), ("d2", None, "NATIONAL", 102.0, None)}


def test_publishing_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, "a")], "k int, v string")
    merge.publish(good, path)
    bad = good.withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        merge.publish(bad, path)
    assert [tuple(r) for r in merge.stored(spark, path).collect()] == [(1, "a")]
    assert merge.publish(good.withColumn("v", F.lit("b")), path) == 2 and merge.stored(spark, path).first().v == "b"
    with pytest.raises(RuntimeError):  # made from a version that is no longer the current one
        merge.publish(good, path, after=1)
    (tmp_path / "t" / "_claims" / "3").write_text("")
    with pytest.raises(RuntimeError, match="claimed"):
        merge.publish(good, path)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = lambda *x: spark.createDataFrame(list(x), "day string, k int, v string")
    merge.upsert(rows(("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")), path, ["day", "k"], ["day"])
    before = sorted(p.name for p in (tmp_path / "p" / "day=b").iterdir())
    for _ in range(2):
        merge.upsert(rows(("a", 2, "y"), ("c", 1, "z")), path, ["day", "k"], ["day"])
    assert sorted((r.day, r.k, r.v) for r in merge.stored(spark, path).collect()) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, "z")]
    assert sorted(p.name for p in (tmp_path / "p" / "day=b").iterdir()) == before
    with pytest.raises(ValueError):
        merge.upsert(rows(("a", 1, "x")), path, ["k"], ["day"])


def test_pairs_within_groups_of_any_size(spark):
    rows = [(g, i, i % 3) for g, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)] + [(None, 5, 1), (None, 6, 1), (1, None, 2), (2, 0, 1)]
    df = spark.createDataFrame(rows, "g int, id int, s int")
    differ = F.col("a.s") != F.col("b.s")
    want = sorted((x[0], x[1], y[1]) for x in rows for y in rows if None not in (*x, *y) and x[0] == y[0] and x[1] < y[1] and x[2] != y[2])
    for block in (None, 1, 7, 100):
        assert sorted(map(tuple, pairs.pairs_within(df, ["g"], "id", differ, block).select("a.g", "a.id", "b.id").collect())) == want
    assert pairs.largest_group(df, ["g"]) == 51 and pairs.largest_group(df.limit(0), ["g"]) == 0


def test_dense_numbers_over_several_tasks(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = dimensions.numbered(df, ["x"], "n").collect()
    assert sorted((r.x, r.n) for r in got) == [(i, i + 1) for i in range(1000)]


def test_medians_are_exact_in_cents(spark):
    df = obs(spark, {"total_fare": Decimal("9057.99")}, {"total_fare": Decimal("9058.00")})
    assert one(reconcile(df, "MEDIAN")).reconciled_fare == Decimal("9058.00")
    summary = spark.createDataFrame([(dt.date(2026, 1, d), 1, 1, Decimal(f)) for d, f in ((1, "9057.99"), (2, "9058.00"))], "observation_date date, route_id int, window_id int, representative_fare decimal(10,2)")
    assert one(index.base_fares(summary, "2026-02-01")).benchmark_fare == 9058.0
    assert abs(one(index.base_fares(summary, "2026-02-01", 10)).benchmark_fare - 9057.995) < 1e-9


def test_rendered_dates_of_all_families(spark):
    texts = ["19 Sept 2026 and 1 October, 2026", "Thu-01Oct2026 19-Sep-2026", "on 1/10/2026", "2026-10-01, 2026/10/02", "31 Feb 2026, 5 Foo 2026, 2026-13-01", None, "2026-10-01 then 3 May 2026 then 2026-10-01"]
    day = lambda *x: dt.date(*x)
    want = [[day(2026, 9, 19), day(2026, 10, 1)], [day(2026, 10, 1), day(2026, 9, 19)], [day(2026, 10, 1)], [day(2026, 10, 1), day(2026, 10, 2)], [], None, [day(2026, 5, 3), day(2026, 10, 1)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.d for r in df.select("i", X.dates_in("t").alias("d")).orderBy("i").collect()] == want
    shown = df.select("i", X.shows_date(F.concat("t", F.lit("")), F.lit("2026-10-01").cast("date")).alias("s"), X.shows_date(F.concat(F.lit("Sorry, no flights. "), "t"), F.lit("2026-10-01").cast("date")).alias("n"))
    assert [r.s for r in shown.orderBy("i").collect()] == [True, True, True, True, False, False, True] and not any(r.n for r in shown.collect())


def test_dialects(spark):
    df = spark.createDataFrame([("Rs. 7,890 only", "2483 / 2740", "5"), ("400", "ai2483/2740", "2 stops"), (None, None, None)], "fare string, number string, stops string")
    got = df.select(X.fare_digits("fare").alias("f"), F.array_join(X.legs("number", F.lit("ix")), "/").alias("n"), X.parse_stops("stops").alias("s")).collect()
    assert [tuple(r) for r in got] == [(Decimal("7890.00"), "IX 2483/IX 2740", 5), (None, "AI 2483/AI 2740", 2), (None, None, None)]
    places = spark.createDataFrame([("Delhi",), ("new delhi ",), ("Ghaziabad Hindon, Delhi",), ("Leh",), (" ",), (None,)], "p string")
    got = places.select(X.short_code("p", {"Delhi": "DEL", "NEW DELHI": "DEL"}).alias("c"), X.airport_fits("p", ["delhi"], ["hindon"]).alias("f")).collect()
    assert [tuple(r) for r in got] == [("DEL", True), ("DEL", True), ("GHA", False), ("LEH", False), (None, False), (None, False)]


def test_tiers_and_the_standard_fare(spark):
    cards = [(1, ["Xpress Lite", "Rs 4,000", "XPRESS FLEX fare", "15 kg", "Rs 6,000"]), (2, ["AI 12", "Rs 5,000", "Rs 4,500"]), (3, ["no fare"]), (4, None)]
    df = spark.createDataFrame(cards, "id int, lines array<string>")
    tiers = {"Xpress Lite": ("ECONOMY", "7 kg"), "Xpress Flex": ("ECONOMY", "15 kg"), "Xpress Biz": ("BUSINESS", None)}
    got = [tuple(r) for r in readers.tier_fares(df, tiers, "Xpress Value").collect()]
    assert got == [(1, "Xpress Lite", Decimal("4000.00"), "ECONOMY", "7 kg"), (1, "Xpress Flex", Decimal("6000.00"), "ECONOMY", "15 kg"), (2, "Xpress Value", Decimal("4500.00"), "ECONOMY", None)]


def test_basket_sheet(spark):
    row = ("1", "Delhi", "Mumbai", "60", "40", "100", "0.5", "0.5", "2026-07", "org", "layer")
    sheet = lambda *rows: spark.createDataFrame([Row(**dict(zip(basket.COLUMNS, r))) for r in rows])
    good = basket.typed_basket(sheet(row, (*row[:5], "101", *row[6:]), ("x", *row[1:])))
    assert [r.error for r in good.collect()] == [None, "to and from are not the total", "rank is missing or no int"]
    assert basket.require(basket.typed_basket(sheet(row))).count() == 1
    with pytest.raises(Exception, match="not the total"):
        basket.require(good).collect()
    directed = spark.createDataFrame([("B", "A", 40), ("A", "B", 60), ("A", "C", 100), ("A", "A", 9)], "origin string, destination string, passengers long")
    pairs_ = basket.weighted(basket.undirected(directed))
    assert {tuple(r)[:5] for r in pairs_.collect()} == {("A", "B", 60, 40, 100), ("A", "C", 100, 0, 100)} and {float(r.weight) for r in pairs_.collect()} == {0.5}
    assert one(basket.basket_checks(pairs_, 2)).passed and not one(basket.basket_checks(pairs_, 25)).passed
    assert one(basket.basket_checks(pairs_.withColumn("passengers_to", F.lit(1)), 2)).wrong_totals == 2


def test_ingest(spark):
    schema = "quote_id long, run_id long, airline string, airline_id int, route_id int, flight_number string, origin string, destination string, travel_date date, departure_time string, arrival_time string, cabin_class string, fare_family string, stops int, total_fare decimal(10,2), currency string, availability boolean, observed_at timestamp"
    base = ("SpiceJet", 1, 1, "sg-162", "DEL", "BOM", dt.date(2026, 9, 15), "19:55", "21:00", None, None, None, Decimal(7000), "INR", True, NOON)
    names = [f.split()[0] for f in schema.split(", ")]
    make = lambda i, run, **kw: tuple({**dict(zip(names, (i, run, *base))), **kw}[n] for n in names)
    rows = [make(1, 7, total_fare=None), make(2, 7), make(3, 7, total_fare=Decimal(9)), make(4, 7, airline_id=None), make(5, 8), make(6, 9), make(7, 7, flight_number="SG 163")]
    quotes = spark.createDataFrame(rows, schema)
    announced = spark.createDataFrame([(7, 2, 0, "RUNNING"), (8, 3, 4, "RUNNING"), (6, 1, 5, "COMPLETED")], "run_id long, source_id int, records_scraped long, status string")
    none = spark.createDataFrame([], "run_id long, data_source_id int, fingerprint_hash string")
    out = {r.quote_id: r for r in ingest_op.ingest(quotes, announced, none).collect()}
    assert {i: (r.outcome, r.error) for i, r in out.items()} == {1: ("FAILED", "total_fare"), 2: ("INSERTED", None), 3: ("SKIPPED", None), 4: ("FAILED", "airline"), 5: ("INSERTED", None), 6: ("FAILED", "run"), 7: ("INSERTED", None)}
    assert (out[2].data_source_id, out[2].flight_number, out[2].cabin_class, out[2].is_non_stop, out[2].base_fare) == (2, "SG 162", "ECONOMY", True, None)
    again = ingest_op.ingest(quotes, announced, spark.createDataFrame([(7, 2, out[2].fingerprint_hash)], none.schema))
    counts = ingest_op.ingest_counts(again)
    assert {tuple(r) for r in counts.collect()} == {(7, 5, 1, 2, 2, "COMPLETED"), (8, 1, 1, 0, 0, "COMPLETED"), (9, 1, 0, 0, 1, "FAILED")}
    done = {r.run_id: (r.records_scraped, r.status) for r in ingest_op.closed(announced, counts).collect()}
    assert done == {7: (1, "COMPLETED"), 8: (5, "COMPLETED"), 6: (5, "COMPLETED")}


def workbook(rows):
    cells = lambda n, r: "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r) if v is not None)
    body = "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheet(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([("Rank", "City", "To"), ("1", None, "5"), (None, None, None), ("2", "B", "x")]))
    df = readers.spreadsheet(spark, str(tmp_path), ["Rank", "City", "To"]).drop("path")
    assert [tuple(r) for r in df.orderBy("row").collect()] == [(2, "1", None, "5"), (3, "2", "B", "x")]
    assert readers.typed(df.where("row = 2"), {"To": "int"}).first()["To"] == 5
    with pytest.raises(Exception, match="To is not a int"):
        readers.typed(df, {"To": "int"}).collect()
    with pytest.raises(Exception, match="lacks the columns"):
        readers.spreadsheet(spark, str(tmp_path), ["Nope"]).collect()


def test_payloads_cards_and_tiers(spark, tmp_path):
    payload = '{"cards":{"J1":[{"flightId":"f1","fareId":"x"},{"flightId":"gone","fareId":"x"}]},"flights":{"f1":{"airlineCode":"AI","flightNo":"2483","departure":"2026-09-15T10:00:00+05:30","arrival":"12:05","stops":0}},"fares":{"x":{"total":"Rs 5,500","family":"Lite"}},"metaData":{"airlineDetail":{"AI":"Air X"}}}'
    got = readers.quotes_of_payload(spark.createDataFrame([(1, payload), (2, "{}"), (3, "broken"), (4, None)], "id int, payload string")).collect()
    assert [tuple(r) for r in got] == [(1, "Air X", "AI 2483", "10:00", "12:05", 0, Decimal("5500.00"), "Lite")]
    cards = spark.createDataFrame([(1, ["Air X", "AI 2483 / AI 2740", "10:00", "DEL", "12:05", "Rs 5,500"]), (2, [])], "id int, lines array<string>")
    assert [tuple(r) for r in readers.quotes_of_cards(cards).collect()] == [(1, "AI 2483/AI 2740", "10:00", "12:05", Decimal("5500.00")), (2, None, None, None, None)]
    tiers = spark.createDataFrame([(1, ["Lite", "7 kg", "Rs 4,000", "Flex", "15 kg", "20 kg", "Rs 6,000", "Max"])], "id int, lines array<string>")
    kinds = {"Lite": ("ECONOMY", None), "Flex": ("ECONOMY", None), "Max": ("ECONOMY", None)}
    assert [tuple(r)[:3] for r in readers.tier_fares(tiers, kinds).collect()] == [(1, "Lite", Decimal("4000.00")), (1, "Flex", Decimal("6000.00"))]
    path = str(tmp_path / "done")
    tasks = spark.createDataFrame([(1, 1), (1, 2)], "route_id int, window_id int")
    readers.append_tasks(tasks.limit(1), path)
    assert readers.resume(tasks, path, ["route_id", "window_id"]).count() == 1
    assert [tuple(r) for r in readers.json_quotes(spark, path, "route_id int, window_id int").collect()] == [(1, 1, None)]


def test_streams(spark, tmp_path):
    schema = "id long, k string, at timestamp"
    rows = [(1, "a", NOON), (2, "a", NOON), (3, "b", NOON + dt.timedelta(minutes=5)), (4, "b", NOON + dt.timedelta(hours=3))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = ingest.distinct_readings(ingest.file_stream(spark, str(tmp_path / "in"), schema), "at", ["k"])
        ingest.publish_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"]).awaitTermination()
    assert sorted(r.k for r in merge.stored(spark, str(tmp_path / "out")).collect()) == ["a", "b"]
    counts = ingest.windowed_counts(ingest.file_stream(spark, str(tmp_path / "in"), schema), "at", ["k"])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1), ("b", 1)]


def test_reports(spark):
    df = obs(spark, {"flight_number": "A 1", "total_fare": 100, "window_id": 1}, {"flight_number": "A 1", "total_fare": 150, "window_id": 1, "data_source_id": 2}, {"flight_number": "A 2", "window_id": 2})
    assert one(audit.price_delta(df)).delta == 50
    windows = spark.createDataFrame([(1, "T+1"), (2, "T+7")], "window_id int, window_code string")
    r = one(audit.coverage(df, ["T+1", "T+7", "T+15"], windows))
    assert (r.w_1, r.w_7, r.w_15, r.total, r.state) == (2, 1, 0, 3, "PARTIAL")
    assert one(audit.window_premium(df)).premium_percent == round((125 - 7000) / 7000 * 100, 4)
    latest = audit.latest(df.select("route_id", "observation_id", "total_fare"), ["route_id"], ["observation_id"])
    assert one(latest).observation_id == 3

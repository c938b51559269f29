import datetime as dt

from pyspark.sql import functions as F

from quotemill.llm import matching
from quotemill.llm.matching import MISPRINTS, PASSES, carrier_of_name, flight_number, match_quotes, matched_pairs, minutes_of, near, place_of

AIRLINES = [("M4", "Marigold Air"), ("M8", "Marigold Air Express"), ("T9", "Teak Aviation"), ("2L", "Lotusline")]
DAY = dt.date(2026, 6, 1)
SCHEMA = "quote_id long, airline string, flight_number string, origin string, destination string, travel_date date, departure_time string, arrival_time string, source string, rule string"


def airlines(spark):
    return spark.createDataFrame(AIRLINES, "airline_code string, airline_name string")


def quote(i, airline, number, dep="10:00", arr="12:00", source="a", o="AAA", d="BBB", day=DAY):
    return (i, airline, number, o, d, day, dep, arr, source, "x")


def pairs(spark, rows):
    matched = match_quotes(spark.createDataFrame(rows, SCHEMA), airlines(spark))
    return {(r.quote_id_a, r.quote_id_b): r.confidence for r in matched_pairs(matched).collect()}


def test_notations(spark):
    times = ["10:05", "1005", "10.05", "10:05:00", "10:05 hrs", "10:05 AM", "2026-06-01T10:05:00+05:30", "10:05 PM", "--:--", None, "", "99:99", "12:10 AM"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(minutes_of(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [605] * 7 + [1325, None, None, None, None, 10]
    df = spark.createDataFrame([(t,) for t in ["AAA", "aaa", "Velegarh (VBR)", "TZH T2", "", None]], "t string").select(place_of(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == ["AAA", "AAA", "VBR", "TZH", None, None]
    cases = {"M4 123": ("M4", "123"), "m4-0123": ("M4", "123"), "Flight T9 4O7": ("T9", "407"), "1I23": (None, "1123"), "2L8045+2L8056": ("2L", "8045/8056"), "T9 9795 / 10053": ("T9", "9795/10053"), "N/A": (None, None), "": (None, None), "  M8  12 ": ("M8", "12"), "Q1 123": (None, None)}
    c, n = flight_number(F.col("t"), ["M4", "M8", "T9", "2L"])
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", c.alias("c"), n.alias("n")).collect()
    assert {r.t: (r.c, r.n) for r in got} == cases
    names = {"Marigold Air Exp": "M8", "MARIGOLD AIR": "M4", "Margold Air Express": "M8", "Teak Avn": "T9", "t9": "T9", "Lotus-Line Airways": "2L", "Multiple Airlines": None, "": None, "Teak": "T9"}
    got = carrier_of_name(spark.createDataFrame([(t,) for t in names], "airline string"), airlines(spark).collect()).collect()
    assert {r.airline: r.name for r in got} == names
    df = spark.createDataFrame([("4266", "426"), ("4266", "4626"), ("4266", "4266"), ("4266", "4663"), ("4266", "42?6")], "a string, b string")
    assert [r.n for r in df.select(near(F.col("a"), F.col("b")).alias("n")).collect()] == [True, True, False, False, True]


def test_cascade(spark):
    rows = [
        quote(1, "Marigold Air", "M4 4266"), quote(2, "M4", "M4-4266", source="b"), quote(3, "Marigold Air", "4266", source="c"),
        quote(4, None, "4266", source="b"),  # number and time
        quote(5, "Marigold Air", "N/A", "10:05", source="c"),  # carrier and near time
        quote(6, "Marigold Air", "M4 4626", source="d"),  # misprint
        quote(7, "Marigold Air", "M4 4276", "18:00", "20:00", source="d"),  # another flight
        quote(8, "Marigold Air", "M4 4266", source="a", day=DAY + dt.timedelta(1)),
        quote(9, "Marigold Air Express", "M8 4266", "15:00", "17:00", source="e"),
        quote(10, "Teak", "900", "06:00", source="a"), quote(11, "Teak Avn", "900", "06:00", source="b"),
        quote(12, None, None, None, None, source="c", o=None), quote(13, "Marigold Air", "M4 4266"),
        quote(None, "Marigold Air", "M4 4266"), quote(15, "Marigold Air", "M4 4266", source=None),
    ]
    group = {1: "a", 2: "b", 3: "c", 4: "b", 5: "c", 6: "d", 13: "a"}
    expected = {(x, y) for x in group for y in group if x < y and group[x] != group[y]} | {(10, 11)}
    got = pairs(spark, rows)
    assert set(got) == expected
    assert all(0 < c <= 1 for c in got.values()) and got[(1, 2)] >= got[(1, 6)]


def test_misprints_of_flights_without_a_confirmed_number(spark):
    rows = [quote(1, "M4", "M4 731", source="a"), quote(2, "M4", "M4 377", source="b"), quote(3, "M4", "M4 737", source="c"), quote(4, "M4", "M4 99", source="c", d="CCC")]
    assert set(pairs(spark, rows)) == {(1, 2), (1, 3), (2, 3)}


def test_ambiguous_candidates_resolve_nothing(spark):
    rows = [quote(i, n, f"{n} 500", source=s) for i, (n, s) in enumerate([("M4", "a"), ("M4", "b"), ("T9", "a"), ("T9", "b")])]
    rows.append(quote(9, None, "500", source="c"))
    assert set(pairs(spark, rows)) == {(0, 1), (2, 3)}


def test_a_hot_flight_is_paired_in_blocks(spark, monkeypatch):
    rows = [quote(i, "M4", "M4 100", source=f"s{i % 3}") for i in range(60)] + [quote(99, "M4", "M4 200", "20:00", "22:00", source="s1")]
    monkeypatch.setattr(matching, "BLOCK", 9)
    assert set(pairs(spark, rows)) == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3}


def test_every_rule_has_a_measured_precision(spark):
    rows = [quote(i, "Marigold Air" if i % 4 else "Teak", f"M4 {100 + i // 2}", f"{i // 2 % 24:02d}:00", f"{(i // 2 + 2) % 24:02d}:00", source="ab"[i % 2]) for i in range(40)]
    matched = match_quotes(spark.createDataFrame(rows, SCHEMA), airlines(spark))
    names = {r.name for _, rules in PASSES for r in rules} | {r.name for r in MISPRINTS} | {"printed", "printed once", "named"}
    assert {r.rule for r in matched.collect()} <= names and all(r.confidence == 31 / 42 for r in matched.collect())


def test_empty(spark):
    assert pairs(spark, []) == {}
    assert match_quotes(spark.createDataFrame([quote(1, "x", "M4 1")], SCHEMA), airlines(spark).limit(0)).collect() == []


def test_few_jobs_and_no_folded_names(spark):
    """The driver's memory follows the plans: every rule is tested in the join of its pass, and names are cleaned before the plan."""
    known = airlines(spark).collect()
    plan = carrier_of_name(spark.createDataFrame([("M4",)], "airline string"), known)._jdf.queryExecution().analyzed().toString()
    assert not any(f"lower({name}" in plan for _, name in AIRLINES)
    rows = [quote(i, "Marigold Air" if i % 4 else "Teak", f"M4 {100 + i // 2}" if i % 5 else str(100 + i // 2), f"{i // 2 % 24:02d}:00", f"{(i // 2 + 2) % 24:02d}:00", source="ab"[i % 2]) for i in range(40)]
    spark.sparkContext.setJobGroup("matching", "matching")
    try:
        assert pairs(spark, rows)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("matching"))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs <= 88  # 81; a test of the rules on their own took 96

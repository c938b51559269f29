import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from quotemill.operators.rolling import blocks_of, distinct_facts, rolling_totals
from quotemill.operators.spikes import SpikeSettings, _ranked, implausible_readings

D = dt.date(2026, 1, 1)


def test_blocks_cover_the_window():
    for days in range(1, 70):
        covered = [s + i for b, s in blocks_of(days) for i in range(b)]
        assert sorted(covered) == list(range(days))


def rolled(spark, rows, windows=(7, 30)):
    df = spark.createDataFrame(rows, "e int, d date, v decimal(10,2), total_7 string")
    return {(r.e, r.d): r for r in rolling_totals(df, "e", "d", "v", windows).collect()}


def test_rolling_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [
        (int(e), D + dt.timedelta(int(d)), None if rng.random() < 0.1 else Decimal(int(rng.integers(1, 9999))) / 100, "x")
        for e, d in zip(rng.integers(0, 4, 150), rng.integers(0, 90, 150))
    ] + [(None, D, Decimal(1), "x"), (1, None, Decimal(1), "x")]
    got = rolled(spark, rows, (1, 7, 30))
    days = sorted({r[1] for r in rows if r[0] is not None and r[1]})
    span = [days[0] + dt.timedelta(i) for i in range((days[-1] - days[0]).days + 1)]
    assert set(got) == {(e, d) for e in {r[0] for r in rows if r[0] is not None} for d in span}
    for (e, d), r in got.items():
        for w in (1, 7, 30):
            inside = [x for x in rows if x[0] == e and x[1] and x[2] is not None and 0 <= (d - x[1]).days < w]
            assert r[f"total_{w}"] == sum((x[2] for x in inside), Decimal(0))
            assert r[f"count_{w}"] == len(inside) and r[f"active_days_{w}"] == len({x[1] for x in inside})
            assert (r[f"avg_{w}"] is None) == (not inside)


def test_rolling_of_nothing(spark):
    assert rolled(spark, []) == {}


def test_facts_stored_again_count_once(spark):
    df = spark.createDataFrame([(1, "a", 5, 9), (1, "a", None, 3), (1, "a", 5, 4), (2, "b", None, 1)], "k int, j string, v int, id int")
    assert {tuple(r) for r in distinct_facts(df, ["k", "j"], "v", "id").collect()} == {(1, "a", 5), (2, "b", None)}


def readings(spark, series):
    rows, n = [], 0
    for name, fares in series.items():
        for i, f in enumerate(fares):
            n += 1
            rows.append((n, name, 1, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), None if f is None else float(f), "x"))
    return spark.createDataFrame(rows, "id long, s string, src int, at timestamp, fare double, reason string")


def found(df, **cfg):
    return {r.id: (r.impossible, r.spike, r.stuck) for r in implausible_readings(df, "id", "src", "at", "fare", ["s"], SpikeSettings(**cfg)).collect()}


def wobble(n, base=5000, seed=0, scatter=0.03):
    return list(base * np.exp(np.random.default_rng(seed).normal(0, scatter, n)))


def test_spike_level_stuck_and_impossible(spark):
    a = wobble(40)
    a[10] *= 3
    a[20] *= 0.3
    a[21] *= 0.3
    b = wobble(20) + [x * 1.8 for x in wobble(20, seed=1)]
    c = wobble(15, seed=2) + [4444.0] * 8 + wobble(15, seed=3)
    d = wobble(15, seed=4) + [4444.0] * 7 + wobble(15, seed=5)
    e = wobble(10, seed=6) + [0.0, -5.0, 9999999.0, None] + wobble(10, seed=7)
    got = found(readings(spark, {"a": a, "b": b, "c": c, "d": d, "e": e}))
    assert {i for i, r in got.items() if r[1]} == {11, 21, 22}
    assert {i for i, r in got.items() if r[2]} == set(range(40 + 40 + 16, 40 + 40 + 24))
    first = 40 + 40 + 38 + 37
    assert {i for i, r in got.items() if r[0]} == {first + 11, first + 12, first + 13}


def test_loaded_again_counts_once_but_all_rows_come_out(spark):
    df = readings(spark, {"a": wobble(10) + [4000.0] * 7 + wobble(10, seed=1), "b": wobble(10) + [90000.0] + wobble(9, seed=2)})
    again = df.where("s = 'a' and fare = 4000 or fare = 90000").withColumn("id", F.col("id") + 1000)
    assert set(found(df.union(again))) == {38, 1038}


def test_a_long_series_is_cut_without_changing_the_result(spark):
    fares = wobble(3000, seed=9)
    for i in range(50, 3000, 97):
        fares[i] *= 2.5
    df = readings(spark, {"a": fares, "b": wobble(50, seed=8)})
    whole, cut = found(df), found(df, block=256)
    assert whole == cut and set(whole) == {i + 1 for i in range(50, 3000, 97)}


def bursty(spark, fares, burst):
    """The first `burst` readings within a day, the others a day apart."""
    start = dt.datetime(2026, 1, 1)
    times = [start + dt.timedelta(seconds=i) if i < burst else start + dt.timedelta(days=1 + i - burst) for i in range(len(fares))]
    return spark.createDataFrame([(i + 1, "a", 1, t, float(f)) for i, (t, f) in enumerate(zip(times, fares))], "id long, s string, src int, at timestamp, fare double")


def test_stuck_runs_and_spikes_at_the_borders_of_a_bursty_series(spark):
    fares = wobble(1060, seed=11)
    for at in (*range(252, 1000, 256), 1005, 1020, 1035, 1050):
        fares[at : at + 8] = [4444.0 + at] * 8
    for at in range(1000, 1060, 15):
        fares[at] *= 2.5
    df = bursty(spark, fares, 1000)
    whole, cut = found(df), found(df, block=256)
    assert whole == cut and sum(r[2] for r in whole.values()) >= 7 * 8 and sum(r[1] for r in whole.values()) >= 4


def test_impossible_readings_at_a_border_are_no_context(spark):
    fares = wobble(250, seed=12) + [0.0] * 150 + [x * 1.01 for x in wobble(250, seed=13)]
    fares[249] *= 3
    fares[400] *= 3
    df = bursty(spark, fares, 300)
    whole, cut = found(df), found(df, block=128)
    assert whole == cut and whole[250] == whole[401] == (False, True, False) and whole[300] == (True, False, True)


def test_a_long_series_loaded_again_is_cut_by_its_readings(spark):
    fares = wobble(300, seed=14)
    fares[130] *= 3
    df = bursty(spark, fares, 200)
    again = df.union(df.withColumn("id", F.col("id") + 1000)).union(df.withColumn("id", F.col("id") + 2000))
    assert set(found(again, block=128)) == set(found(again)) == {131, 1131, 2131}


def test_ranks_over_several_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 7 % 2).alias("series"), (F.col("id") * 7919 % 5003).alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in _ranked(df).select("series", "at", "rank", F.shiftright("spot", 33)).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r[3] for r in got if r[0] == 0}) > 1
    for series in (0, 1):
        mine = sorted(r[1:3] for r in got if r[0] == series)
        assert [r[1] for r in mine] == list(range(len(mine)))


def test_few_readings_and_empty_table(spark):
    assert found(readings(spark, {"a": [100, 90000], "b": [5], "c": [None, None]})) == {}
    assert found(readings(spark, {"a": [1.0]}).limit(0)) == {}

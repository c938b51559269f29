import math

import numpy as np
from pyspark.sql import functions as F

from quotemill.llm.digests import build, certified_percentiles, exact_percentiles, merge, percentile
from quotemill.llm.registry import p5_by_flight

SCHEMA = "g string, day int, v double, n int"


def frame(spark, groups):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(g, int(rng.integers(0, 5)), float(v), 7) for g, vs in groups.items() for v in vs], SCHEMA)


def exact(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(q * len(v))) - 1]


def test_small_groups_are_exact(spark):
    rng = np.random.default_rng(2)
    groups = {"a": list(map(float, rng.integers(0, 50, 60))), "b": [3.0], "c": [5.0] * 40, None: [1.0, 2.0]}
    got = certified_percentiles(frame(spark, groups), ["g"], "v", (0.0, 0.5, 0.9, 1.0)).collect()
    assert len(got) == 16
    for r in got:
        assert r.value == exact(groups[r.g], r.quantile) and r.rank_error == 0 and r.n == len(groups[r.g])


def test_error_is_bounded_and_counted(spark):
    rng = np.random.default_rng(3)
    groups = {"log": list(np.exp(rng.normal(8, 1, 20000))), "ties": list(map(float, rng.integers(0, 9, 5000))), "two": [1.0] * 3000 + [1e9] * 3000}
    got = certified_percentiles(frame(spark, groups), ["g"], "v", (0.01, 0.5, 0.95), part=F.col("day")).collect()
    for r in got:
        v = np.sort(groups[r.g])
        rank = max(1, math.ceil(r.quantile * len(v)))
        lt, le = np.searchsorted(v, r.value, "left"), np.searchsorted(v, r.value, "right")
        lo, hi = (lt + 1, le) if le > lt else (max(lt, 1), min(lt + 1, len(v)))
        assert abs(r.rank_error - max(lo - rank, rank - hi, 0) / len(v)) < 1e-12
        assert r.certified and r.rank_error <= 0.01


def test_digests_of_days_merge(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, {"a": list(rng.normal(0, 1, 8000))})
    days = build(df, ["g"], "v", F.col("day"), 100)
    assert days.count() == 5 and days.agg(F.max(F.size("centroids"))).first()[0] <= 60
    some = merge(days.where("part < 3"), ["g"], 100)
    both = merge(some.unionByName(days.where("part >= 3").drop("part")), ["g"], 100)
    r = both.select("n", percentile(0.5).alias("m"), "low", "high").first()
    assert r.n == 8000 and abs(r.m) < 0.08 and r.low < -3 and r.high > 3


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1, None, 1), ("b", 1, float("nan"), 1), ("c", 1, 2.0, 1)], SCHEMA)
    assert {r.g for r in certified_percentiles(df, ["g"], "v").collect()} == {"c"}
    assert certified_percentiles(df.limit(0), ["g"], "v").collect() == []


def test_exact_ranks_of_groups_of_any_size(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": list(np.exp(rng.normal(8, 1, 9000))), "ties": list(map(float, rng.integers(0, 9, 3000))), "one": [3.0], None: [1.0, 2.0], "none": [float("nan")]}
    got = exact_percentiles(frame(spark, groups).repartition(7), ["g"], "v", (0.0, 0.05, 0.5, 0.99, 1.0)).collect()
    assert len(got) == 20
    assert all(r.value == exact(groups[r.g], r.quantile) and r.n == len(groups[r.g]) for r in got)
    assert exact_percentiles(frame(spark, groups).limit(0), ["g"], "v").collect() == []


def test_flights_of_more_fares_than_a_digest_holds(spark, tmp_path):
    rng = np.random.default_rng(6)
    fares = {"M4 1": rng.integers(1, 10**6, 2500) / 100, "M4 2": rng.integers(1, 10**6, 601) / 100, "M4 3": rng.integers(1, 10**6, 600) / 100, None: rng.integers(1, 10**6, 900) / 100}
    rows = [(1, 2, None, f, f"2026-06-{i % 9 + 1:02d} 00:00:00", float(v)) for f, vs in fares.items() for i, v in enumerate(vs)] + [(1, 2, None, "M4 3", "2026-06-01 00:00:00", None)] * 5
    df = spark.createDataFrame(rows, "route_id int, window_id int, airline_id int, flight_number string, at string, fare double")
    df.select("*", F.to_timestamp("at").alias("observed_at"), F.col("fare").cast("decimal(10,2)").alias("total_fare")).write.parquet(f"{tmp_path}/fare_observations.parquet")
    got = p5_by_flight(spark, str(tmp_path)).collect()
    assert len(got) == 24
    assert all(r.value == exact(fares[r.flight], r.quantile) and r.n == len(fares[r.flight]) and r.rank_error == 0 for r in got)

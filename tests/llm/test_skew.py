"""A third of all rows under one key, source or text: results stay whole and do not depend on the partitioning."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from quotemill.llm.digests import certified_percentiles
from quotemill.llm.matching import match_quotes, matched_pairs
from quotemill.llm.packing import best_fit
from quotemill.llm.spans import SpanSettings, shared_spans
from quotemill.llm.survivors import best_records

SMALL = SpanSettings(least=60, q=6, window=14, k=2)


def test_boilerplate_below_the_length_links_nothing(spark):
    rng = random.Random(1)
    fresh = lambda k: "".join(rng.choice("abcdefghijkl ") for _ in range(k))
    head = fresh(50)
    docs = [(i, (head if i % 3 == 0 else "") + str(i) + fresh(200)) for i in range(300)]
    docs += [(900, docs[1][1]), (901, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in shared_spans(df, "doc_id", "text", SMALL).collect()} == {(1, 900), (1, 901)}


def test_percentiles_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 50}", rng.randint(0, 30), float(int(rng.lognormvariate(8, 1)))) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    for r in certified_percentiles(df, ["g"], "v", (0.5, 0.95), part=F.col("day")).collect():
        mine = sorted(v for g, _, v in rows if g == r.g)
        assert r.n == len(mine) and r.certified
        at = sum(v < r.value for v in mine), sum(v <= r.value for v in mine)
        assert at[0] - 0.01 * r.n - 1 <= math.ceil(r.quantile * r.n) <= at[1] + 0.01 * r.n + 1


def test_survivor_of_a_hot_group(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i}", start + dt.timedelta(hours=i), 1, f"v{i}") for i in range(1, 900)]
    df = spark.createDataFrame(rows, "id long, g string, at timestamp, trust int, a string").repartition(6)
    got = {r.g: r for r in best_records(df, "id", ["g"], {"a": F.col("a")}, "at", "trust", ["a"]).collect()}
    assert got["hot"].records == 299 and got["hot"].best_record == 897 and got["hot"].a == "v897" and len(got) == 601


def test_one_source_with_a_third_of_the_quotes(spark):
    day = dt.date(2026, 6, 1)
    rows = [(i, "M4", f"M4 {1000 + i // 3}", "AAA", "BBB", day, f"{i // 3 % 24:02d}:{i // 72 * 5 % 60:02d}", None, "hot" if i % 3 == 0 else f"s{i % 3}") for i in range(300)]
    quotes = spark.createDataFrame(rows, "quote_id long, airline string, flight_number string, origin string, destination string, travel_date date, departure_time string, arrival_time string, source string")
    airlines = spark.createDataFrame([("M4", "Marigold Air")], "airline_code string, airline_name string")
    got = {(r.quote_id_a, r.quote_id_b) for r in matched_pairs(match_quotes(quotes, airlines)).collect()}
    assert got == {(a, b) for n in range(0, 300, 3) for a in range(n, n + 3) for b in range(a + 1, n + 3)}


def test_many_equal_sizes():
    packed = best_fit([7] * 3000 + [3] * 1000, [10])
    assert len(packed) == 3000 and sum(len(m) for _, m in packed) == 4000

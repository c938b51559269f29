import datetime as dt
import random

from pyspark.sql import functions as F

from quotemill.llm.survivors import best_records, orders, precedence

T = dt.datetime(2026, 1, 1)
SCHEMA = "id long, g string, at timestamp, trust int, a string, b int, records int"


def best(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    usable = {"a": F.col("a"), "b": F.col("b")}
    return {r.g: r for r in best_records(df, "id", ["g"], usable, "at", "trust", ["a"]).collect()}


def hour(n):
    return T + dt.timedelta(hours=n)


def test_best_and_field_by_field(spark):
    got = best(spark, [
        (1, "x", hour(1), 2, "old", 1, 0), (2, "x", hour(2), 1, "new", 2, 0),
        (3, "y", hour(1), 1, "p", 5, 0), (4, "y", hour(2), 2, "q", None, 0),
        (5, "z", hour(1), 1, "s", 1, 0), (6, "z", hour(1), 1, "s", 1, 0),
        (7, "one", hour(1), 1, "s", 1, 0),
        (8, None, hour(1), None, None, None, 0), (9, None, hour(3), None, "v", 1, 0),
    ])
    assert got["x"].best_record == 2 and (got["x"].a, got["x"].b, got["x"].records) == ("new", 2, 2)
    assert got["y"].best_record is None and (got["y"].a, got["y"].b) == ("q", 5)
    assert got["z"].best_record is None and got["one"].best_record is None
    assert got[None].best_record == 9


def test_missing_times_follow_the_learnt_precedence(spark):
    rows = []
    for i in range(20):  # first -> second everywhere
        rows += [(100 + 2 * i, f"t{i}", hour(1), 1, "first", 1, 0), (101 + 2 * i, f"t{i}", hour(2), 1, "second", 1, 0)]
    rows += [(1, "u", None, 1, "second", 1, 0), (2, "u", None, 1, "first", 2, 0)]
    rows += [(3, "v", hour(1), 1, "first", 1, 0), (4, "v", hour(5), 1, "third", 1, 0), (5, "v", None, 1, "first", 1, 0)]
    got = best(spark, rows)
    assert got["u"].a == "second" and got["u"].best_record == 1
    assert got["v"].a == "third" and got["v"].best_record == 4


def test_precedence_counts_changes_across_months(spark):
    rows = [(1, "g", dt.datetime(2026, 1, 30), 1, "a", 1, 0), (2, "g", dt.datetime(2026, 2, 2), 1, "b", 1, 0), (3, "g", dt.datetime(2026, 2, 3), 1, "b", 1, 0), (4, "g", dt.datetime(2026, 2, 4), 1, "a", 1, 0)]
    learnt = precedence(spark.createDataFrame(rows, SCHEMA), ["g"], ["a"], "at")
    assert {tuple(r) for r in learnt.collect()} == {("a", "a", "b", 1), ("a", "b", "a", 1)}
    assert orders(learnt).collect() == []


def brute(rows):
    """best_records in plain Python, for a group column g, fields a and b, and the order learnt from a."""
    groups, net = {}, {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for g in groups.values():
        dated = sorted((r for r in g if r[2]), key=lambda r: (r[2], r[4] is not None, r[4] or ""))
        for x, y in zip(dated, dated[1:]):
            if x[4] and y[4] and x[4] != y[4]:
                net[x[4], y[4]] = net.get((x[4], y[4]), 0) + 1
    edges = {k: n - net.get(k[::-1], 0) for k, n in net.items() if n > net.get(k[::-1], 0)}
    out = {}
    for name, g in groups.items():
        times = [r[2] for r in g if r[2]]
        held = {}
        for r in g:
            if r[2] and r[4]:
                held[r[4]] = max(r[2], held.get(r[4], r[2]))
        newest = max(held, key=lambda v: (held[v], v)) if held else None
        free = {r[4] for r in g if not r[2] and r[4]} - set(held)
        among = free | ({newest} if held else set())
        away = {v: sum(n for (x, y), n in edges.items() if x == v and y in among) for v in among}
        come = {v: sum(n for (x, y), n in edges.items() if y == v and x in among) for v in among}
        if among and min(away.values()) == 0:
            latest = {v for v in among if away[v] == 0}
        else:
            latest = {v for v in among if come[v] - away[v] == max(come[w] - away[w] for w in among)}

        def place(r):
            second = dt.timedelta(microseconds=1)
            if r[2]:
                return r[2]
            if r[4] in held:
                return held[r[4]]
            if r[4] is None:
                return None
            if r[4] not in latest:
                return (min(times) if times else T) - second
            if not times:
                return T
            return max(times) + second if newest and newest not in latest else None

        facts = [(r, sum(x is not None for x in r[4:6]), place(r), -(r[3] if r[3] is not None else 2**40)) for r in g]
        most, trust = max(f[1] for f in facts), max(f[3] for f in facts)
        last = max((f[2] for f in facts if f[2]), default=None)
        great = [f[0][0] for f in facts if f[1] == most and f[3] == trust and f[2] in (None, last)]
        low = dt.datetime(1, 1, 1)
        value = lambda k: max(((f[2] or low, f[3], f[1], -f[0][0]), f[0][k]) for f in facts if f[0][k] is not None)[1] if any(f[0][k] is not None for f in facts) else None
        out[name] = (great[0] if len(great) == 1 and len(g) > 1 else None, value(4), value(5))
    return out


def test_against_brute_force_with_missing_times(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        at = hour(rng.randint(0, 60) * 24) if rng.random() < 0.6 else None
        rows.append((i, f"g{rng.randrange(150)}", at, rng.choice([None, 1, 2]), rng.choice([None, *"abcdefgh"]), rng.choice([None, 1, 2]), 0))
    got = {k: (r.best_record, r.a, r.b) for k, r in best(spark, rows).items()}
    assert got == brute(rows)
    plain = brute([(*r[:2], r[2] or dt.datetime(2000, 1, 1), *r[3:]) for r in rows])
    assert sum(plain[g][1] != got[g][1] for g in got) > 5  # the learnt order says more than the known times


def test_learnt_edges_go_before_scores(spark):
    rows, n = [], 100
    for old, new, times in (("a", "b", 1), ("z", "a", 10), ("b", "c", 10)):
        for k in range(times):
            rows += [(n, f"{old}{new}{k}", hour(1), 1, old, 1, 0), (n + 1, f"{old}{new}{k}", hour(2), 1, new, 1, 0)]
            n += 2
    rows += [(1, "u", None, 1, "a", 1, 0), (2, "u", None, 1, "b", 1, 0)]
    assert best(spark, rows)["u"].a == "b" and best(spark, rows)["u"].best_record == 2


def test_empty(spark):
    assert best(spark, []) == {}

"""Best representative of each group of duplicate records, by currency reasoning (problem 4).

1. Which value replaces which is learnt from timestamped rows: every change between neighbouring rows of a group is
   a transition old -> new of one field. `precedence` counts them all; `orders` keeps for every two values the way
   that was seen more often.
2. In a group, timestamped rows are ordered by time. A row without a timestamp stands where a timestamped row of its
   group holds its values. Failing that, its values, those of other such rows and the latest timestamped value are partly
   ordered by the learnt edges among them; the topologically latest are those that give way to no other. A row whose values
   are latest, where the timestamped value is not, comes after all timestamped rows; a row with a value that gives way
   comes before them; every other has no known time.
   On a cycle, where each gives way to another, the value that came in most against going out is the latest.
3. The rows of a group are partly ordered by completeness, currency and trust. Each field of the survivor is
   its topologically latest usable value; the best record is the greatest element of the partial order, if there is just one.

Groups are only aggregated (max_by on structs combines before the shuffle), never collected or paired; the learnt order
is joined with the distinct values of groups that have rows without a timestamp.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that stand for a missing value (fixed values of the data).
FILLERS = ("", "-", "N/A", "NULL", "NONE", "TBA")


def usable_text(c: Column | str) -> Column:
    """The trimmed text, null if it is missing in any notation."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~F.upper(text).isin(*FILLERS), text)


def precedence(rows: DataFrame, group: Sequence[str], fields: Sequence[str], at: str) -> DataFrame:
    """(field, old, new, n): how often `old` was followed by a different `new` in a group, over all timestamped rows.

    Groups are cut by month, so that no task sorts an unbounded group; changes across months are counted from the
    last and first row of each month.
    """
    month = F.trunc(F.to_date(at), "month")
    dated = rows.where(F.col(at).isNotNull()).select(*group, F.col(at).alias("_at"), month.alias("_m"), *[F.col(f).cast("string").alias(f) for f in fields])

    def changes(df: DataFrame, w: Window, first: str, last: str) -> DataFrame:
        fields_of = F.array(*[F.struct(F.lit(f).alias("field"), F.col("_b")[f].alias("old"), F.col(first)[f].alias("new")) for f in fields])
        return df.withColumn("_b", F.lag(last).over(w)).select(F.explode(fields_of).alias("x")).select("x.*")

    packed = dated.select(*group, "_m", "_at", F.struct(*fields).alias("_v"))
    inside = changes(packed, Window.partitionBy(*group, "_m").orderBy("_at", "_v"), "_v", "_v")
    months = packed.groupBy(*group, "_m").agg(F.min_by("_v", F.struct("_at", "_v")).alias("_first"), F.max_by("_v", F.struct("_at", "_v")).alias("_last"))
    across = changes(months, Window.partitionBy(*group).orderBy("_m"), "_first", "_last")
    moved = inside.union(across).where("old is not null and new is not null and old <> new")
    return moved.groupBy("field", "old", "new").agg(F.count("*").alias("n"))


def orders(learnt: DataFrame) -> DataFrame:
    """(field, old, new, n): for two values the way that was seen more often, and how much more; none if as often."""
    net = F.sum(F.when(F.col("old") < F.col("new"), F.col("n")).otherwise(-F.col("n")))
    both = learnt.groupBy("field", F.least("old", "new").alias("a"), F.greatest("old", "new").alias("b")).agg(net.alias("net")).where("net <> 0")
    up = F.col("net") > 0
    return both.select("field", F.when(up, F.col("a")).otherwise(F.col("b")).alias("old"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("new"), F.abs("net").alias("n"))


def topological(values: DataFrame, group: Sequence[str], edges: DataFrame) -> DataFrame:
    """values (group, field, value, ...) with latest: no other value of the group and field is its successor by `edges`.

    If every value has a successor, those are latest whose edges among the group's values come in most against going out.
    """
    keys = [*group, "field"]
    known = values.select(*keys, "value")
    steps = known.join(edges, (known.field == edges.field) & (known.value == edges.old)).select(*[known[k] for k in keys], "old", "new", "n")
    inside = steps.join(known.withColumnRenamed("value", "new"), [*keys, "new"], "left_semi")
    ways = F.explode(F.array(F.struct(F.col("old").alias("value"), F.col("n").alias("o"), F.lit(0).cast("bigint").alias("i")), F.struct(F.col("new").alias("value"), F.lit(0).cast("bigint").alias("o"), F.col("n").alias("i"))))
    degrees = inside.select(*keys, ways.alias("x")).groupBy(*keys, "x.value").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i"))
    counted = values.join(degrees, [*keys, "value"], "left").withColumns({"o": F.coalesce("o", F.lit(0)), "i": F.coalesce("i", F.lit(0))})
    ends = counted.groupBy(*keys).agg(F.min("o").alias("_least"), F.max(F.col("i") - F.col("o")).alias("_most"))
    latest = F.when(F.col("_least") == 0, F.col("o") == 0).otherwise(F.col("i") - F.col("o") == F.col("_most"))
    return counted.join(ends, keys).withColumn("latest", latest).drop("o", "i", "_least", "_most")


def place_in_time(rows: DataFrame, key: str, group: Sequence[str], fields: Sequence[str], at: str) -> DataFrame:
    """rows with _order: the time of a row (microseconds), or where its values put it; null if nothing is known.

    A row without a time has the latest time at which a timestamped row of its group holds one of its values. If none
    does, it comes before all of them if one of its values is not topologically latest, else after them if in some field
    the latest timestamped value is not. In a group without any times the rows with the latest values are at 0, others at -1.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    dated = rows.where(F.col(at).isNotNull()).withColumn("_order", micros)
    undated = rows.where(F.col(at).isNull())
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    keys = [*group, "field"]
    asked = undated.select(key, *group, values).select(key, *group, "x.*").where("value is not null")
    concerned = dated.join(undated.select(*group).distinct(), list(group), "left_semi")
    held = concerned.select(*group, "_order", values).select(*group, "_order", "x.*").where("value is not null").groupBy(*keys, "value").agg(F.max("_order").alias("held"))
    newest = held.groupBy(*keys).agg(F.max_by("value", F.struct("held", "value")).alias("value")).withColumn("dated", F.lit(True))
    free = asked.select(*keys, "value").distinct().join(held, [*keys, "value"], "left_anti").withColumn("dated", F.lit(False))
    sorted_values = topological(newest.unionByName(free), group, orders(precedence(rows, group, fields, at)))
    beaten = sorted_values.where("dated and not latest").select(*keys, F.lit(True).alias("beaten"))
    placed = (
        asked.join(held, [*keys, "value"], "left").join(sorted_values.where("not dated").select(*keys, "value", "latest"), [*keys, "value"], "left").join(beaten, keys, "left")
        .groupBy(key).agg(F.max("held").alias("held"), F.bool_and("latest").alias("latest"), F.bool_or("beaten").alias("beaten"))
    )
    ends = concerned.groupBy(*group).agg(F.min("_order").alias("lo"), F.max("_order").alias("hi"))
    beside = F.when(~F.col("latest"), F.coalesce(F.col("lo"), F.lit(0)) - 1).when(F.col("latest") & F.col("hi").isNull(), F.lit(0)).when(F.col("latest") & F.col("beaten"), F.col("hi") + 1)
    guessed = undated.join(ends, list(group), "left").join(placed, key, "left").withColumn("_order", F.coalesce("held", beside)).drop("lo", "hi", "held", "latest", "beaten")
    return dated.unionByName(guessed)


def best_records(rows: DataFrame, key: str, group: Sequence[str], usable: Mapping[str, Column], at: str, trust: str, order_fields: Sequence[str]) -> DataFrame:
    """One survivor per group: group columns, `records`, `best_record`, `usable_values` and the surviving fields.

    `usable` gives for each field its value, null where it is not usable. `trust` is a rank, 1 the best; null is worse
    than any. `best_record` is the key of the record of a group of two or more that no other record exceeds in usable
    values, time or trust and none equals in all three; null if there is none. A record without a known time neither
    exceeds another in time nor is exceeded. A surviving field is the latest usable value, of those without a known time
    only if there is no other, at equal times the more trusted, then of the more complete record, then of the lowest key.

    Nulls in the group columns are equal to each other; a group of one has that record's values and no best
    record. Repeated rows tie and leave no best record. Empty table: no rows. Extra columns are dropped.
    """
    names = list(usable)
    clean = rows.select(
        F.col(key).alias("_key"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(at).alias("_at"), F.col(trust).cast("long").alias("_trust"),
        *[usable[f].alias(f) for f in names],
    )
    keys = [f"_g{i}" for i in range(len(group))]
    filled = clean.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys})
    placed = place_in_time(filled, "_key", keys, order_fields, "_at")
    counted = placed.select(
        "*", sum((F.col(f).isNotNull().cast("int") for f in names), start=F.lit(0)).alias("_usable"), (-F.coalesce("_trust", F.lit(2**40))).alias("_rank"),
    )
    timed = F.col("_order").isNotNull()
    top = lambda among, tie: F.max(F.when(among, F.struct("_usable", "_order", "_rank", tie.alias("k"))))
    agg = counted.groupBy(*keys).agg(
        F.count("*").alias("records"), F.max("_usable").alias("usable_values"), F.max("_order").alias("_latest"), F.max("_rank").alias("_best_rank"),
        *[top(among, tie).alias(f"_{name}_{end}") for name, among in (("timed", timed), ("free", ~timed)) for end, tie in (("hi", F.col("_key")), ("lo", -F.col("_key")))],
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct("_order", "_rank", "_usable", -F.col("_key")))).alias(f) for f in names],
    )

    def great(name: str, latest: Column) -> Column:
        hi = F.col(f"_{name}_hi")
        return F.coalesce((hi["_usable"] == F.col("usable_values")) & latest & (hi["_rank"] == F.col("_best_rank")), F.lit(False))

    single = lambda name: F.when(F.col(f"_{name}_hi")["k"] == -F.col(f"_{name}_lo")["k"], F.col(f"_{name}_hi")["k"])
    one, other = great("timed", F.col("_timed_hi")["_order"] == F.col("_latest")), great("free", F.lit(True))
    best = F.when(one & ~other, single("timed")).when(other & ~one, single("free"))
    return agg.select(
        *[F.when(F.col(k) != "\x00", F.col(k)).alias(g) for k, g in zip(keys, group)], "records",
        F.when(F.col("records") > 1, best).alias("best_record"), "usable_values", *names,
    )


def flight_groups(records: DataFrame) -> DataFrame:
    """reconciled_flights with the parts of its group: g_flight and g_cabin from the fields, else from the key."""
    parts = F.split(F.col("flight_identity_key"), r"\s*[|;]\s*")
    number = lambda c: F.nullif(F.regexp_replace(F.upper(usable_text(c)), "[^A-Z0-9]", ""), F.lit(""))
    # An E or a Y begins every notation of economy, a B or a C every notation of business.
    cabin = lambda c: F.when(F.substring(F.upper(usable_text(c)), 1, 1).isin("E", "Y"), "ECONOMY").when(F.substring(F.upper(usable_text(c)), 1, 1).isin("B", "C"), "BUSINESS").otherwise(F.upper(usable_text(c)))
    return records.select(
        "*", F.coalesce(number(F.col("flight_number")), number(F.get(parts, F.lit(1)))).alias("g_flight"),
        F.coalesce(cabin(F.col("cabin_class")), cabin(F.get(parts, F.lit(5)))).alias("g_cabin"),
    )


GROUP = ("airline_id", "g_flight", "route_id", "travel_date", "g_cabin")


def flight_survivors(records: DataFrame, observations: DataFrame, trust: DataFrame) -> DataFrame:
    """The survivors of reconciled_flights. Observation ids must exist in `observations`, source ids in `trust`."""
    known = observations.select(F.col("observation_id").alias("selected_observation_id"), F.lit(True).alias("_exists"))
    ranks = trust.select(F.col("source_id").alias("selected_source_id"), F.col("trust_rank").alias("_trust_rank"))
    rows = flight_groups(records).join(known, "selected_observation_id", "left").join(ranks, "selected_source_id", "left")
    usable = {
        "flight_number": F.upper(F.regexp_replace(usable_text("flight_number"), r"^([A-Za-z]\d|\d[A-Za-z]|[A-Za-z]{2})[\s-]*", "$1 ")),
        "scheduled_departure_time": F.substring(usable_text("scheduled_departure_time"), 1, 5),
        "cabin_class": F.when(usable_text("cabin_class").isNotNull(), F.col("g_cabin")),
        "reconciled_fare": F.when(F.col("reconciled_fare") > 0, F.col("reconciled_fare")),
        "selected_observation_id": F.when(F.col("_exists"), F.col("selected_observation_id")),
        "selected_source_id": F.when(F.col("_trust_rank").isNotNull(), F.col("selected_source_id")),
        "sources_represented": F.when(F.size("sources_represented") > 0, F.col("sources_represented")),
    }
    return best_records(rows, "record_id", GROUP, usable, "reconciled_at", "_trust_rank", ("scheduled_departure_time", "selected_source_id"))

"""Matching quotes of one flight across sources, by a cascade of deterministic rules (problem 1).

The quotes with a carrier code before their number make the flights (entities). Every other quote is resolved by
successive exact joins on weaker combinations of attributes (PASSES); what a pass resolves leaves the cascade, and a
rule resolves a quote only if all its candidates are one flight. A flight that only one source quotes may be a misprint:
it is first looked for among the flights that several sources quote. The precision of each rule is measured on
labelled quotes (those whose carrier and number are printed and confirmed by another source): the rule is
applied to them as if it saw only its own attributes, and without the times that only their own source gives. A pair's
confidence is the product of its two quotes' precisions, smoothed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.pairs import BLOCK, largest_group, pairs_within
from quotemill.runtime import bounded_rows, checkpoint

#: Characters read in place of digits (fixed values of the data).
MISREAD = ("OIS", "015")
#: Company words that a name may have, lack or abbreviate.
COMPANY = r"\b(limited|ltd|pvt|private|airways?|airlines?|aviation|aviaton|avn)\b"


@dataclass(frozen=True)
class Rule:
    """What a quote and a flight must share besides their pass's join keys."""

    name: str
    carrier: bool = False  #: the airline's name must mean the flight's carrier
    number: str = ""  #: "near", or "none": the quote has no number; "" if the number is a join key
    minutes: int | None = None  #: the departure time may be off by so many minutes; None: it does not count
    arrival: bool = False  #: the arrival time must be equal
    nameless: bool = False  #: only for quotes whose airline is unknown
    other: bool = False  #: the number may be any other


#: The passes: each is one exact join on its keys (with route and day), then its rules from strong to weak. What a pass
#: resolves is anti-joined before the next.
PASSES = (
    ("number", (Rule("number, carrier name, time", carrier=True, minutes=15), Rule("number, time", minutes=15), Rule("number, carrier name", carrier=True), Rule("number", nameless=True))),
    ("carrier", (
        Rule("near number, carrier, time", number="near", minutes=15), Rule("near number, carrier, arrival", number="near", arrival=True),
        Rule("carrier, time, arrival", number="none", minutes=0, arrival=True), Rule("carrier, time", number="none", minutes=0), Rule("carrier, near time", number="none", minutes=15),
        Rule("carrier, arrival", number="none", arrival=True),
    )),
    ("dep", (Rule("near number, time", number="near", minutes=0, arrival=True), Rule("time, arrival", number="none", minutes=0, arrival=True))),
)
#: For flights that only one source prints: their number may be a misprint.
MISPRINTS = (*PASSES[1][1][:2], Rule("other number, carrier, time, arrival", minutes=0, arrival=True, other=True))


def minutes_of(c: Column) -> Column:
    """Minutes after midnight of a clock time in any notation, else null."""
    t = F.upper(F.trim(c))
    iso = F.regexp_extract(t, r"T(\d{2}:\d{2})", 1)
    t = F.when(iso != "", iso).otherwise(t)
    t = F.regexp_replace(t, r"^(\d{2})(\d{2})$", "$1:$2")
    pattern = r"^(\d{1,2})[:.](\d{2})(?::\d{2})?\s*(AM|PM|HRS)?$"
    h, m, half = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    hour = F.try_to_number(h, F.lit("99")).cast("int")
    hour = F.when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour)
    minute = F.try_to_number(m, F.lit("99")).cast("int")
    return F.when((h != "") & (hour < 24) & (minute < 60), hour * 60 + minute)


def place_of(c: Column) -> Column:
    """The three-letter airport code in a place, else null."""
    return F.nullif(F.regexp_extract(F.upper(c), r"(?:^|[^A-Z])([A-Z]{3})(?:[^A-Z]|$)", 1), F.lit(""))


def flight_number(c: Column, codes: list[str]) -> tuple[Column, Column]:
    """(carrier code or null, numbers of all legs joined by / or null), without notation, misreadings and leading zeros."""
    text = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"^FLIGHT\s+", ""), r"\s+", " ")
    legs = F.split(text, r"\s*[/,+]\s*")
    code = "(?:" + "|".join(codes or ["\x00"]) + ")"
    carrier = F.nullif(F.regexp_extract(F.get(legs, F.lit(0)), rf"^({code})[ .\-]*[0-9OIS?]{{2,5}}$", 1), F.lit(""))

    def number(leg: Column) -> Column:
        digits = F.regexp_extract(F.regexp_replace(leg, rf"^{code}[ .\-]*(?=[0-9OIS?]{{2,5}}$)", ""), r"^([0-9OIS?]{2,5})$", 1)
        return F.regexp_replace(F.translate(digits, *MISREAD), "^0+", "")

    numbers = F.transform(legs, number)
    good = (F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n == "")
    return carrier, F.when(good, F.array_join(numbers, "/"))


def carrier_of_name(names: DataFrame, airlines: list) -> DataFrame:
    """(airline, name): the code of the one airline that a written name is nearest to, if it is near enough."""
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    full, short = clean(F.col("airline")), clean(F.regexp_replace(F.lower("airline"), COMPANY, ""))

    def distance(known: str) -> Column:
        # in Python: lower() of a literal is folded on the driver, which costs it all the tables of Spark's collations
        a, b = (re.sub("[^a-z]", "", x) for x in (known.lower(), re.sub(COMPANY, "", known.lower())))
        more = F.length(full) - len(a)
        part = F.when((F.length(full) >= 4) & F.lit(a).startswith(full), -0.25 * more).when(full.startswith(F.lit(a)), 0.5 * more)
        return F.least(F.levenshtein(full, F.lit(a)).cast("double"), F.levenshtein(short, F.lit(b)) + 0.1, part)

    if not airlines:
        return names.select("airline", F.lit(None).cast("string").alias("name"))
    scored = F.array_sort(F.array(*[F.struct(distance(r.airline_name).alias("d"), F.lit(r.airline_code).alias("code"), F.lit(len(r.airline_name)).alias("n")) for r in airlines]))
    best, second = F.get(scored, F.lit(0)), F.get(scored, F.lit(1))
    exact = F.upper(F.trim("airline"))
    near = (F.length(full) >= 3) & (best["d"] <= 0.34 * best["n"]) & (second.isNull() | (second["d"] - best["d"] >= 0.5))
    return names.select("airline", F.when(exact.isin([r.airline_code for r in airlines]), exact).when(near, best["code"]).alias("name"))


def resolved_attributes(quotes: DataFrame, airlines: DataFrame) -> DataFrame:
    """One row per quote: id, source, day, o, d, code (printed before the number), name (from the airline), number, dep, arr."""
    known = bounded_rows(airlines.where("airline_code is not null and airline_name is not null").select("airline_code", "airline_name"), 5000)
    if known is None:
        raise ValueError("the airline table must not exceed 5000 rows")
    code, number = flight_number(F.col("flight_number"), sorted({r.airline_code for r in known}))
    names = carrier_of_name(quotes.select("airline").where("airline is not null").distinct(), known)
    rows = quotes.join(names, "airline", "left").where("quote_id is not null and source is not null")
    return rows.select(
        F.col("quote_id").cast("long").alias("id"), "source", F.col("travel_date").alias("day"), place_of(F.col("origin")).alias("o"), place_of(F.col("destination")).alias("d"),
        code.alias("code"), "name", number.alias("number"), minutes_of(F.col("departure_time")).alias("dep"), minutes_of(F.col("arrival_time")).alias("arr"),
    )


def flight_key(carrier: str) -> Column:
    return F.concat_ws("|", carrier, "number", "o", "d", F.col("day").cast("string"))


def near(a: Column, b: Column) -> Column:
    """One misprint apart: a digit more, less or other, or two digits exchanged."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) == 1) | swapped


def flights(strong: DataFrame) -> DataFrame:
    """The flights that quotes with a printed carrier name, by the times they give: flight, carrier, ..., sources."""
    given = strong.select(flight_key("code").alias("flight"), F.col("code").alias("carrier"), "number", "o", "d", "day", "dep", "arr", "source").distinct()
    given = given.repartition("flight")  # both aggregations and their join keep it
    facts = given.groupBy("flight", "carrier", "number", "o", "d", "day", "dep", "arr").agg(F.count_distinct("source").alias("time_sources"), F.min("source").alias("a_source"))
    sizes = given.groupBy("flight").agg(F.count_distinct("source").alias("sources"))
    return facts.join(sizes, "flight")


def _mistakes(rule: Rule) -> bool:
    """Whether a rule takes a number for a misprint: where it resolves a labelled quote, whose number is right, it is wrong."""
    return rule.other or rule.number == "near"


def _fits(rule: Rule, labelled: bool) -> Column:
    fits = (F.col("their_sources") > 1) & (F.col("flight") != F.col("own")) if labelled and _mistakes(rule) else F.lit(True)
    if rule.carrier:
        fits = fits & (F.col("name") == F.col("their_carrier"))
    if rule.number == "near":
        fits = fits & near(F.col("number"), F.col("their_number"))
    elif rule.number == "none" and not labelled:
        fits = fits & F.col("number").isNull()
    if rule.nameless and not labelled:
        fits = fits & F.col("name").isNull()
    if rule.minutes is not None:
        fits = fits & (F.abs(F.col("dep") - F.col("their_dep")) <= rule.minutes)
        if labelled and not _mistakes(rule):  # a time that only the quote's own source gives proves nothing
            fits = fits & ((F.col("time_sources") > 1) | (F.col("a_source") != F.col("source")))
    if rule.arrival:
        fits = fits & (F.col("arr") == F.col("their_arr"))
    return F.coalesce(fits, F.lit(False))


def candidates(rows: DataFrame, known: DataFrame, key: str, rules: Sequence[Rule], tested: Sequence[Rule] = ()) -> DataFrame:
    """(id, test, f0, f1, ...): for every rule of a pass the flight it resolves a quote to, null if none or several fit.

    One exact join on route, day and the pass's key; a quote meets the flights of its key, each with its times, never
    other quotes. A flight is not resolved to itself unless the rule is only being tested, on labelled quotes (test);
    the rules in `tested` are only tested.
    """
    side = F.coalesce("code", "name") if key == "carrier" else F.col(key)
    left = rows.select("id", "test", "source", "own", "o", "d", "day", "name", "number", "dep", "arr", side.alias("key")).where("key is not null and o is not null and d is not null and day is not null")
    right = known.select("o", "d", "day", F.col(key).alias("key"), "flight", F.col("carrier").alias("their_carrier"), F.col("number").alias("their_number"), F.col("dep").alias("their_dep"), F.col("arr").alias("their_arr"), "time_sources", "a_source", F.col("sources").alias("their_sources"))
    met = left.join(right, ["o", "d", "day", "key"]).where("test or own is null or flight <> own")
    each = [*(F.when(F.col("test"), _fits(r, True)).otherwise(_fits(r, False)) for r in rules), *(F.col("test") & _fits(r, True) for r in tested)]
    fits = met.select("id", "test", "flight", *[c.alias(f"r{i}") for i, c in enumerate(each)]).where(reduce(lambda x, y: x | y, (F.col(f"r{i}") for i in range(len(each)))))
    ends = fits.groupBy("id", "test").agg(*[f(F.when(F.col(f"r{i}"), F.col("flight"))).alias(f"{n}{i}") for i in range(len(each)) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return ends.select("id", "test", *[F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).alias(f"f{i}") for i in range(len(each))])


def resolve(rows: DataFrame, known: DataFrame, key: str, rules: Sequence[Rule], tested: Sequence[Rule] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that a pass resolves, with flight and rule, the rows that remain, and (resolved, right) of each labelled row: a bit a rule; written once."""
    found = candidates(rows, known, key, rules, tested)
    first = F.coalesce(*[F.when(F.col(f"f{i}").isNotNull(), F.struct(F.col(f"f{i}").alias("flight"), F.lit(r.name).alias("rule"))) for i, r in enumerate(rules)])
    bits = [sum(((F.coalesce(c, F.lit(False))).cast("int") * (1 << i) for i, c in enumerate(each)), F.lit(0)) for each in (
        [F.col(f"f{i}").isNotNull() for i in range(len(rules) + len(tested))], [F.col(f"f{i}") == F.col("own") for i in range(len(rules) + len(tested))]
    )]
    joined = rows.join(found, ["id", "test"], "left").select(*rows.columns, first.alias("x"), bits[0].alias("resolved"), bits[1].alias("right"))
    tagged = checkpoint(joined.select(*rows.columns, "x.flight", "x.rule", "resolved", "right"))
    mine = tagged.where("not test").drop("resolved", "right")
    return mine.where("flight is not null"), mine.where("flight is null").drop("flight", "rule"), tagged.where("test").select("resolved", "right")


def _one_name(single: DataFrame, lone: DataFrame) -> DataFrame:
    """(own, flight): one name for flights that are each printed by one source and are misprints of each other.

    Flights of one carrier and route that leave and arrive together are one; so are near numbers at nearly one time.
    """
    timed = single.where("dep is not null and arr is not null").groupBy("code", "o", "d", "day", "dep", "arr").agg(F.min("own").alias("a"), F.collect_set("own").alias("owns"))
    together = timed.select("a", F.explode("owns").alias("own")).groupBy("own").agg(F.min("a").alias("a"))
    beside = single.select("id", "own").join(candidates(single, lone, "carrier", MISPRINTS[:1]), "id").groupBy("own").agg(F.min("f0").alias("b"))
    first = single.select("own").distinct().join(together, "own", "left").join(beside, "own", "left").select("own", F.least("own", F.coalesce("a", "own"), F.coalesce("b", "own")).alias("flight"))
    again = first.select(F.col("own").alias("flight"), F.col("flight").alias("name"))  # the other's name may have another
    return first.join(again, "flight").select("own", F.col("name").alias("flight"))


def _precisions(strong: DataFrame, tests: Sequence[tuple[Sequence[Rule], DataFrame]], smoothing: float) -> dict[str, float]:
    """By rule: (right + s) / (n + 2 s) over labelled quotes. tests: the rules of a pass, and what they resolve. A row of counts comes to the driver per pass.

    printed: the airline's name means the printed carrier; printed once: the same among the flights of one source, as
    none of them is labelled; named: the number and the name, with the printed carrier hidden, name the quote's own flight.
    A rule for misprints is wrong where it takes a labelled quote for another flight that several sources quote.
    """
    smooth = lambda right, n: ((right or 0) + smoothing) / (n + 2 * smoothing)
    label, name = F.col("sources") > 1, F.col("name").isNotNull()
    agree = F.col("name") == F.col("code")
    c = strong.agg(
        F.count_if(label).alias("total"), F.count_if(label & name).alias("n"), F.count_if(label & agree).alias("r"), F.count_if(label & (flight_key("name") == F.col("own")) & name).alias("k"),
        F.count_if(~label & name).alias("n1"), F.count_if(~label & agree).alias("r1"),
    ).first()
    out = {"printed": smooth(c.r, c.n), "named": smooth(c.k, c.n), "printed once": smooth(c.r1, c.n1)}
    most = max(len(rules) for rules, _ in tests)
    bits = reduce(DataFrame.unionByName, (rows.select(F.lit(p).alias("pass"), "resolved", "right") for p, (_, rows) in enumerate(tests)))
    sums = [F.count_if(F.getbit(F.col(side), F.lit(i)) == 1).alias(f"{n}{i}") for i in range(most) for side, n in (("right", "r"), ("resolved", "n"))]
    counts = {row["pass"]: row for row in bits.groupBy("pass").agg(*sums).collect()}
    for p, (rules, _) in enumerate(tests):
        for i, rule in enumerate(rules):
            right, n = (counts[p][f"r{i}"], counts[p][f"n{i}"]) if p in counts else (0, 0)
            if _mistakes(rule):
                right, n = c.total - n, c.total
            out[rule.name] = smooth(right, n)
    return out


def match_quotes(quotes: DataFrame, airlines: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(quote_id, source, flight, rule, confidence): the flight of every quote that names or resolves to one.

    confidence is the measured precision of the rule, (right + s) / (labelled quotes it resolves + 2 s) with s =
    `smoothing`. Nulls: a quote without id or source is left
    out; missing attributes only exclude the rules that use them; a quote that no rule resolves has no flight and does
    not come out. Repeated quotes resolve alike; ties (candidates of several flights) resolve nothing. Empty tables
    give no rows; extra columns are ignored.

    Every pass is written to the checkpoint folder, so that no plan holds more than one.
    """
    rows = checkpoint(resolved_attributes(quotes, airlines))
    printed = F.col("code").isNotNull() & F.col("number").isNotNull() & F.col("o").isNotNull() & F.col("d").isNotNull() & F.col("day").isNotNull()
    known = checkpoint(flights(rows.where(printed)))
    confirmed = known.where("sources > 1")
    sizes = known.groupBy(F.col("flight").alias("own")).agg(F.first("sources").alias("sources"))
    strong = checkpoint(rows.where(printed).withColumn("own", flight_key("code")).join(sizes, "own").withColumn("test", F.col("sources") > 1))
    labelled = strong.where("test")
    done = [labelled.select("id", "source", F.col("own").alias("flight"), F.lit("printed").alias("rule"))]

    # flights of one source: misprints of confirmed flights, then of each other
    fixed, single, _ = resolve(strong.where("sources = 1"), confirmed, "carrier", MISPRINTS)
    lone = known.join(single.select(F.col("own").alias("flight")).distinct(), "flight", "left_semi")
    names = checkpoint(_one_name(single, lone))
    done += [fixed, single.join(names, "own").withColumn("rule", F.lit("printed once"))]
    known = checkpoint(confirmed.unionByName(lone.withColumnRenamed("flight", "own").join(names, "own").drop("own")))

    # quotes without a printed carrier or number
    left, tests = rows.where(~printed).withColumns({"own": F.lit(None).cast("string"), "test": F.lit(False)}), []
    for key, rules in PASSES:  # the rules are tested on the labelled quotes in the same join
        tested = [r for r in MISPRINTS if r.other and key == "carrier"]
        found, left, test = resolve(left.unionByName(labelled.select(left.columns)), known, key, rules, tested)
        done.append(found)
        tests.append(((*rules, *tested), test))
    # what is left names its own flight by the airline and a number
    named = left.where("name is not null and number is not null and o is not null and d is not null and day is not null")
    done.append(named.withColumns({"flight": flight_key("name"), "rule": F.lit("named")}))

    out = checkpoint(reduce(DataFrame.unionByName, (d.select(F.col("id").alias("quote_id"), "source", "flight", "rule") for d in done)))
    precision = _precisions(strong, tests, smoothing)
    return out.withColumn("confidence", F.element_at(F.create_map(*[F.lit(x) for pair in precision.items() for x in pair]), F.col("rule")))


def matched_pairs(matched: DataFrame) -> DataFrame:
    """(quote_id_a, quote_id_b, confidence): quotes of one flight from different sources, smaller id first.

    match_quotes is the form that grows with the quotes (a quote and its flight); pairs grow with the square of a
    flight's quotes. A flight of more than BLOCK quotes is paired block by block, over many tasks.
    """
    hot = largest_group(matched, ["flight"]) > BLOCK
    pairs = pairs_within(matched.select("flight", "quote_id", "source", "confidence"), ["flight"], "quote_id", F.col("a.source") != F.col("b.source"), BLOCK if hot else None)
    return pairs.select(F.col("a.quote_id").alias("quote_id_a"), F.col("b.quote_id").alias("quote_id_b"), (F.col("a.confidence") * F.col("b.confidence")).alias("confidence"))

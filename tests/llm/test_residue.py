from quotemill.llm.residue import EXEMPLARS, residue_records, residue_scores, without_residue

RESIDUE = [
    "{{origin}} to {{ destination }} flights", "Only ${seats} seats left", "Fares from Rs <%= paxCount %> - Site", "x {% site.title %} y", "[[a]] z", "@@ROUTE_CODE@@", "__TOCITY__ to X", "%DEPTIME%", "$ORIGIN$ not available",
    "Sorry #{user}, no flights", "{travel_date}", "Only [PAGETITLE] seats left", "%s to %s on %d", "Fare from Rs %.2f not available", "search.results.noFlights.heading", "i18n:alerts.body", "[object Object]", "&lt;title&gt; x", "<noscript> x </noscript>",
    "Rs undefined onwards, A to B", "undefined to undefined | Site", "Site | undefined", "null - null flights on null", "Rs NaN\nNot Available", "Sorry, None flights for None", "TypeError: cannot read property of undefined",
    "Lorem ipsum dolor", "AENEAN EGET RISUS", "TODO: write title for A-B", "Title TBD", "asdf asdf", "यहाँ शीर्षक लिखें", "Oops, the search service crashed - code 52", "UH OH, THE FARE SERVICE WAS REFUSED", "404 - page not found | Site", "HTTP 503",
    "Please turn on JS to view fares", "You must unblock client scripts for this page", "कृपया जावास्क्रिप्ट चालू करें", "Verify you are human - Site",
]
REAL = [
    "Undefined gate: see the board at X, flight M4 12", "Promo FLY9 not available with fare [Lite]", "PROMO FLY9 NOT AVAILABLE WITH FARE [LITE]", "Server pantry meals unavailable on T9 1", "Temporarily unavailable: extra bags on K7 2", "Weekend fares for the X JavaScript Days conference - Site",
    "Template for group bookings, A to B - Site", "Sample itineraries: A to B in 5 days", "Site | 504 seats released on AAA-BBB", "Site | Error fares from X: what to know before you book", "Sorry, access to the lounge at X is closed until 2026-07-01", "Not Available", "N/A\nNot Available",
    "Sorry - 20% off with FARE20 has ended", "Seat map is being loaded onto M4 1 after check-in", "Your session lounge pass at X T2 is sold out", "A से B उड़ानें - Site", "Cookies and tea unavailable on flights under 2 hours", "Visit www.example.test.org today", "",
]


def test_residue_and_look_alikes(spark):
    texts = [(i, t) for i, t in enumerate(RESIDUE + REAL + [f"{n} flights Abc > Def - Site to on the is not available seats" for n in range(300)])]
    got = {r.k for r in residue_scores(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()}
    assert [t for i, t in texts[: len(RESIDUE)] if i not in got] == []
    assert [t for i, t in texts[len(RESIDUE) :] if i in got] == []


def test_records(spark):
    schema = "id long, page_title string, alerts array<string>, score string"
    rows = [
        (1, "{{x}}", None, "s"), (2, None, [], "s"), (3, None, None, "s"), (4, "Fine", ["Fine", None, "Rs NaN", "Rs NaN"], "s"), (5, "", [""], "s"), (None, "{{x}}", None, "s"),
        (6, "word " * 3000 + "lorem ipsum " + "word " * 10, ["ok"], "s"), (1, "{{x}}", None, "s"),
    ]
    got = residue_records(spark.createDataFrame(rows, schema), "id", "page_title", "alerts").collect()
    assert sorted(r.id for r in got) == [1, 4, 6] and all(0.8 <= r.score <= 1.0001 for r in got)
    kept = without_residue(spark.createDataFrame(rows, schema), "id", "page_title", "alerts")
    assert kept.columns == ["id", "page_title", "alerts", "score"] and sorted((r.id or 0) for r in kept.collect()) == [0, 2, 3, 5]
    assert residue_records(spark.createDataFrame([], schema), "id", "page_title", "alerts").collect() == []
    assert residue_scores(spark.createDataFrame([(1, "{{x}}")], "k int, t string"), "k", "t", exemplars=()).collect() == []


def test_exemplars_are_distinct():
    assert len(set(EXEMPLARS)) == len(EXEMPLARS) and len(EXEMPLARS) < 200

"""Column expressions for quote texts: flight numbers, fares, times, stops, dates and fingerprints. All run in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A designator is three letters, or two letters or digits of which one is a letter; a number has up to four digits and a suffix.
DESIGNATOR = "[A-Z]{3}|[A-Z][A-Z0-9]|[0-9][A-Z]"
NUMBER = "[0-9]{1,4}[A-Z]?"
CARRIER = f"^({DESIGNATOR}) ?-? ?({NUMBER})$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null, empty or white space."""
    return F.coalesce(F.trim(_c(c)), F.lit("")) == ""


def normal_flight_number(c: Column | str) -> Column:
    """'sg-162' -> 'SG 162'; anything else is only trimmed, upper-cased and freed of repeated blanks."""
    text = F.regexp_replace(F.upper(F.trim(_c(c))), r"\s+", " ")
    return F.when(text.rlike(CARRIER), F.concat_ws(" ", F.regexp_extract(text, CARRIER, 1), F.regexp_extract(text, CARRIER, 2))).otherwise(text)


def legs(c: Column | str, carrier: Column | None = None) -> Column:
    """array<string>: the normal flight numbers of a connection; bare ones take the carrier of the first, else `carrier`."""
    parts = F.transform(F.split(_c(c), r"\s*[/,+]\s*"), lambda p: normal_flight_number(p))
    first = F.regexp_extract(F.get(parts, F.lit(0)), r"^(\S+) ", 1)
    first = first if carrier is None else F.when(first != "", first).otherwise(F.coalesce(F.upper(F.trim(carrier)), F.lit("")))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^[0-9]{1,4}$") & (first != ""), F.concat_ws(" ", first, p)).otherwise(p))


def fingerprint_text(airline: Column, flight: Column, origin: Column, destination: Column, day: Column, departure: Column, cabin: Column, family: Column) -> Column:
    """Eight fields joined by pipes; price, time of observation and source do not count."""
    up = lambda c, missing: F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit(missing))
    return F.concat_ws(
        "|", up(airline, ""), F.coalesce(normal_flight_number(flight), F.lit("")), up(origin, ""), up(destination, ""), F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")),
        up(F.substring(departure, 1, 5), "NONE"), up(cabin, "ECONOMY"), up(family, "NONE"),
    )


def fingerprint(*parts: Column) -> Column:
    return F.sha2(fingerprint_text(*parts), 256)


def fare_digits(c: Column | str, least: float = 500.0) -> Column:
    """decimal(10,2) from all digits of a text, whatever stands between them, if above `least`; the dialect of pages with fares alone."""
    digits = F.regexp_replace(_c(c), "[^0-9]", "")
    value = F.when(F.length(digits).between(1, 8), digits).try_cast("decimal(10,2)")
    return F.when(value > least, value)


def parse_fare(c: Column | str, least: float = 0.0) -> Column:
    """decimal(10,2) from 'Rs. 7,890', 'INR 7890.50' or a bare amount above `least`; texts with other words give null."""
    text = F.regexp_replace(F.trim(_c(c)), r"(?i)^(rs\.?|inr|₹)\s*", "")
    amount = F.regexp_replace(text, ",", "")
    value = F.when(amount.rlike(r"^[0-9]{1,8}(\.[0-9]{1,2})?$"), amount).try_cast("decimal(10,2)")
    return F.when(value > least, value)


def parse_clock(c: Column | str) -> Column:
    """'HH:mm' from clock times and ISO timestamps (wall clock, offset ignored); invalid ones give null."""
    text = F.trim(_c(c))
    clock = F.coalesce(F.nullif(F.regexp_extract(text, r"T([0-9]{2}:[0-9]{2})", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^([0-9]{1,2}:[0-9]{2})(:[0-9]{2})?$", 1), F.lit("")))
    padded = F.lpad(clock, 5, "0")
    return F.when(padded.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]$"), padded)


def parse_stops(c: Column | str) -> Column:
    """0 for non-stop or direct, N for 'N stop(s)', 1 for connecting or halt, else the first digits, else null."""
    text = F.lower(F.trim(_c(c)))
    count = F.regexp_extract(text, r"([0-9]+)\s*[- ]?\s*stop", 1)
    return F.when(text.rlike(r"non[- ]?stop|direct"), 0).when(count != "", count.try_cast("int")).when(text.rlike("connecting|halt"), 1).otherwise(F.regexp_extract(text, "([0-9]+)", 1).try_cast("int"))


#: English month names and their short forms.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: The families of rendered dates: pattern, and which of its groups are year, month and day.
DATE_FORMS = (
    (r"\b([0-9]{1,2})\s+([A-Za-z]{3,9}),?\s+([0-9]{4})\b", (3, 2, 1)),
    (r"([0-9]{1,2})-?([A-Za-z]{3,4})-?([0-9]{4})\b", (3, 2, 1)),
    (r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\b", (3, 2, 1)),
    (r"\b([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b", (1, 2, 3)),
)


def month_number(c: Column) -> Column:
    """1 to 12 of an English month's name, its first three letters, 'sept', or a number; else null."""
    names = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(c)), c.try_cast("int"))


def dates_in(c: Column | str) -> Column:
    """array<date>: the dates rendered in a text, family by family in order, each once; impossible dates are none."""

    def of(pattern: str, groups: tuple[int, int, int]) -> Column:
        def day(x: Column) -> Column:
            y, m, d = (F.regexp_extract(x, pattern, g) for g in groups)
            return F.try_to_date(F.format_string("%s-%02d-%02d", y, month_number(m), d.try_cast("int")), "yyyy-MM-dd")

        return F.transform(F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(0)), day)

    return F.array_distinct(F.array_compact(F.concat(*[of(*x) for x in DATE_FORMS])))


def shows_date(c: Column | str, day: Column) -> Column:
    """Whether a page's text renders the day and has no notice that there are no flights; a null text does not."""
    return F.coalesce(F.array_contains(dates_in(c), day) & ~mentions(c, ("no flights found", "sorry, no flights")), F.lit(False))


def mapped(c: Column | str, names: Mapping[str, str]) -> Column:
    """The value of the upper-cased, trimmed text in `names`, else the trimmed text; blank -> Unknown."""
    if not names:
        return F.when(blank(c), "Unknown").otherwise(F.trim(_c(c)))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in (pair[0].upper(), pair[1])])
    return F.when(blank(c), "Unknown").otherwise(F.coalesce(F.try_element_at(table, F.upper(F.trim(_c(c)))), F.trim(_c(c))))


def first_line(lines: Column | str, pattern: str) -> Column:
    """The first of an array of lines that matches, else null."""
    return F.get(F.filter(_c(lines), lambda x: x.rlike(pattern)), F.lit(0))


def local_date(c: Column | str, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(_c(c), zone))


def source_code(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.trim(_c(c))), r"\s+", "_")


#: Phrases of pages without flights (fixed values).
NO_INVENTORY = (
    "no flights found", "sorry, no flights", "no flights available", "no available flights", "try the closest available date", "we couldn't find any flights",
    "we could not find any flights", "no direct flights available", "no direct flights found", "no results found", "no inventory available",
)
#: Phrases of errors that a second attempt may cure (fixed values).
TRANSIENT = (
    "timeout", "timeoutexceeded", "net::", "connection", "econnreset", "econnrefused", "target closed", "page crashed", "browser closed", "navigating to",
    "unexpected empty result", "interrupted", "protocol error",
)


def mentions(c: Column | str, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases, in any case; null holds none."""
    low = F.lower(_c(c))
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(low, F.lit(phrase))
    return F.coalesce(found, F.lit(False))


def error_category(c: Column | str) -> Column:
    low = F.lower(_c(c))
    return F.when(F.contains(low, F.lit("net::")), "NETWORK").when(low.rlike("time[d ]?[ -]?out"), "TIMEOUT").when(F.coalesce(low, F.lit("")) == "", None).otherwise("PAGE")


def names_place(text: Column | str, code: Column | str) -> Column:
    """Whether a text names a place code as a whole word."""
    return F.coalesce(F.regexp_like(F.upper(_c(text)), F.concat(F.lit(r"\b"), F.upper(_c(code)), F.lit(r"\b"))), F.lit(False))


def search_url(host: Column, origin: Column, destination: Column, day: Column) -> Column:
    return F.format_string("https://%s/search?from=%s&to=%s&date=%s", host, origin, destination, F.date_format(day, "yyyy-MM-dd"))


def short_code(c: Column | str, names: Mapping[str, str], size: int = 3) -> Column:
    """The code of a name or alias in `names` (case and outer blanks aside), else the first letters of the text; blank -> null."""
    text = F.upper(F.trim(_c(c)))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in (pair[0].upper(), pair[1])]) if names else F.create_map().cast("map<string,string>")
    return F.when(~blank(c), F.coalesce(F.try_element_at(table, text), F.substring(text, 1, size)))


def source_type(code: Column, declared: Column, agencies: Sequence[str] = ()) -> Column:
    """OTA if a source declared as the airline's own names one of the agencies or ends with _OTA, else what is declared."""
    ota = code.endswith("_OTA")
    for name in agencies:
        ota = ota | F.contains(code, F.lit(name.upper()))
    return F.when(ota & (F.coalesce(declared, F.lit("AIRLINE_DIRECT")) == "AIRLINE_DIRECT"), "OTA").otherwise(F.coalesce(declared, F.lit("AIRLINE_DIRECT")))


def source_list(c: Column | str, canonical: Mapping[str, str], default: Sequence[str]) -> Column:
    """array<string>: the canonical source codes of a comma-separated list in order, each once; `default` if it names none."""
    table = F.create_map(*[F.lit(x) for pair in canonical.items() for x in (pair[0].lower(), pair[1])]) if canonical else F.create_map().cast("map<string,string>")
    names = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    found = F.array_distinct(F.transform(names, lambda x: F.coalesce(F.try_element_at(table, x), F.upper(x))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(x) for x in default]))


def task_error(origin: Column, destination: Column, observed: Column, travel: Column, advance: Column) -> Column:
    """What is wrong with a collection task, null if nothing: same place, codes that are not three letters, or another advance."""
    o, d = F.upper(F.trim(origin)), F.upper(F.trim(destination))
    code = "^[A-Z]{3}$"
    return (
        F.when(o == d, "origin is destination").when(~F.coalesce(o.rlike(code), F.lit(False)), "origin").when(~F.coalesce(d.rlike(code), F.lit(False)), "destination")
        .when(~F.coalesce(F.date_diff(travel, observed) == advance, F.lit(False)), "advance days")
    )


def airport_fits(name: Column | str, accepted: Sequence[str], rejected: Sequence[str] = ()) -> Column:
    """Whether an airport's written name is one of the accepted ones and none of the rejected secondary airports; any case."""
    low = F.lower(F.trim(_c(name)))
    hit = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)) if words else F.lit(False)
    return F.coalesce(hit(accepted) & ~hit(rejected), F.lit(False))


def names_any(text: Column | str, code: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Whether a text names a place by its code (as written) or by one of the code's aliases, as whole words."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]) if aliases else F.create_map().cast("map<string,array<string>>")
    word = lambda w, flag: F.regexp_like(_c(text), F.concat(F.lit(flag + r"\b\Q"), w, F.lit(r"\E\b")))
    known = F.coalesce(F.try_element_at(table, F.upper(F.trim(code))), F.array().cast("array<string>"))
    return F.coalesce(word(F.upper(F.trim(code)), "") | F.exists(known, lambda a: word(a, "(?i)")), F.lit(False))

"""Template residue, filler and error-page text in short passages, by exemplars (problem 6).

Labelled exemplars of residue are kept as token sets behind an inverted index. Texts become tokens in which every
notation of a template slot, format code, message key, markup or raw object is one marker. A text and an exemplar are
compared only if the text has one of the exemplar's rarest tokens, so rare that without all of them the rest cannot
reach the threshold (prefix filter, exact). The score is the share of the exemplar's TF-IDF weight that a window of
its length, with some slack, contains; inverse document frequencies are counted over all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from itertools import product
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.runtime import checkpoint

THRESHOLD = 0.8
SLACK = 2  #: words that a passage may have between those of an exemplar

#: Markers of what no page should show (pattern, marker), in order. The patterns are valid in Java and in Python.
MARKERS = (
    (r"\[object Object\]", " rawvalue "),
    (r"\{\{[^{}]*\}\}|[$#]\{[^{}]*\}|<%=?[^%]*%>|\{%[^%]*%\}|\[\[[^\[\]]*\]\]", " templateslot "),
    (r"@@[A-Za-z_.]+@@|__[A-Za-z][A-Za-z_.]*?__|%[A-Za-z][A-Za-z_.]{2,}%|\$[A-Za-z][A-Za-z_.]{2,}\$|\{[A-Za-z][A-Za-z0-9_.]*\}", " templateslot "),
    (r"\[(?!(?:LITE|SAVER|FLEXI|COMFORT|MAX|ECONOMY|BUSINESS)\])[A-Z][A-Z_.]{2,}\]", " templateslot "),
    (r"(?<![0-9A-Za-z%])%(?:\.[0-9]+)?[sdfSDF](?![A-Za-z0-9])", " formatcode "),
    (r"</?[A-Za-z][^<>]*>|&(?:lt|gt|amp|quot|nbsp);", " markup "),
    (r"\b[iI]18[nN]:[A-Za-z0-9_.]+|(?<![A-Za-z0-9./@])(?![wW]{3}\.)[A-Za-z]{2,}(?:\.[A-Za-z]{2,}){2,}\b", " messagekey "),
    (r"[0-9]+", " # "),
)
TOKEN = r"[#\p{L}\p{M}]+"

#: Ends of a text, for exemplars that stand alone or at an end; in the tokens of a text they bear the word beside them.
BEGIN, END = "textbegin", "textend"

_SUBJECTS = ("the page you wanted", "this page", "the request", "our server", "the search service", "the fare service")
_FAILURES = ("crashed", "failed", "is offline", "was refused", "could not be loaded", "returned an error", "did not respond in time", "is temporarily unavailable")
_SWITCH = ("enable", "allow", "activate", "turn on", "unblock")
_SCRIPTS = ("javascript", "js", "scripts", "scripting", "client scripts")

#: Labelled residue. Each line is one exemplar.
EXEMPLARS = (
    # slots, keys and code
    "templateslot", "formatcode", "messagekey", "markup", "rawvalue", "missing key",
    "undefined to undefined", "to undefined flights", "rs undefined onwards", f"undefined {END}", "null flights on null", "null to null", "only nan seats left", "rs nan",
    "none flights for none", "none to none", "cannot read property of undefined", "is not a function", "typeerror", "keyerror", "nullpointerexception", "traceback", "stack trace", "ora # table not available",
    # filler and drafts
    "lorem", "ipsum", "dolor sit", "sit amet", "magna vel", "eget risus", "lacinia ut", "tempor quam", "posuere urna", "felis non", "adipis elit", "consec", "praes", "curab", "aenean", "nullam", "vivam",
    "todo write title for", "sample text replace before launch", "copy to come from marketing", "add alert copy here", "insert page title", "heading # heading #", "untitled document",
    "dummy text dummy text", "your headline goes here", "placeholder banner", "placeholder text", "text goes here", "asdf", "xxxx", f"{BEGIN} test test", "test test unavailable test", f"{BEGIN} title tbd {END}", f"{BEGIN} title tba {END}", f"{BEGIN} title tbc {END}",
    "यहाँ शीर्षक लिखें",
    # error, block, robot-check, session and outage pages
    "we are down for maintenance", "your session has expired sign in again", "something broke on our side", "request blocked ref", "upstream gateway timed out", "unexpected error stopped this page",
    f"# service down {END}", "service unavailable error", f"{BEGIN} http # {END}", "too many requests slow down", "access refused your address has been limited", "access denied", "checking that you are not a robot", "verify you are human", "# internal failure", "internal server error",
    "error # upstream did not answer", "# page not found", "connection reset while loading", "this site cannot be reached", "we lost that page", "bad gateway", "पृष्ठ नहीं मिला",
    *(f"{s} {f}" for s, f in product(_SUBJECTS, _FAILURES)),
    # scripts or another browser needed
    *(f"{s} {n}" for s, n in product(_SWITCH, _SCRIPTS)),
    "needs javascript enabled", "does not work without js", "does not work without javascript", "your browser does not run scripts", "scripts are required to show this page", "javascript is required",
    "unsupported browser", "scripting is switched off", "not available with scripts blocked", "allow scripts and cookies", "javascript is disabled", "जावास्क्रिप्ट चालू करें",
)


def with_tokens(texts: DataFrame, text: str, name: str = "t") -> DataFrame:
    """texts with the array of a text's tokens, its first and last also as tokens of the ends; null stays null."""
    marked = F.col(text)
    for pattern, marker in MARKERS:
        marked = F.regexp_replace(marked, pattern, marker)
    # a column of its own: used several times below, it would else be computed as often
    words = texts.withColumn("_words", F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0)))
    ends = F.concat(F.lit(BEGIN), F.get("_words", F.lit(0))), F.concat(F.lit(END), F.get("_words", F.size("_words") - 1))
    return words.withColumn(name, F.array_compact(F.concat(F.array(ends[0]), "_words", F.array(ends[1])))).drop("_words")


def _among(tokens: str, words: Sequence[str]) -> Column:
    """The distinct tokens that are among words: one probe of a fixed hash set each."""
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(list(words))))


def exemplar_tokens(exemplar: str) -> list[str]:
    words = re.findall(r"[#\wऀ-ॿ]+", exemplar.lower())
    if words[-1] == END:
        words[-1] += words[-2]
    if words[0] == BEGIN:
        words[0] += words[1]
    return words


def residue_scores(texts: DataFrame, key: str, text: str, exemplars: Sequence[str] = EXEMPLARS, threshold: float = THRESHOLD) -> DataFrame:
    """(key, exemplar, score): the best-matching exemplar of every text that reaches the threshold.

    Null texts are no texts; empty ones have no residue. A repeated key comes out once, with the best score of its
    texts; ties go to the exemplar that comes first in the alphabet. No texts or exemplars: no rows. Extra columns are
    ignored. Very long texts are compared window by window like short ones.
    """
    spark = texts.sparkSession
    parsed = {" ".join(exemplar_tokens(x)): Counter(exemplar_tokens(x)) for x in exemplars}
    vocabulary = sorted({t for x in parsed.values() for t in x})
    rows = with_tokens(texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("_x")), "_x").drop("_x")
    if not vocabulary:
        return rows.select(F.col("k").alias(key), F.lit("").alias("exemplar"), F.lit(0.0).alias("score")).limit(0)
    # texts are tokenised once and written; a filter before that would be pushed down and tokenise them twice
    words = rows.withColumn("v", _among("t", vocabulary)).select("k", "v", F.when(F.size("v") > 0, F.array_join("t", " ")).alias("s"))
    rows = checkpoint(words).withColumn("t", F.split("s", " "))
    # document frequencies over all texts, of the exemplars' tokens only
    counted = {r.w: r.n for r in rows.select(F.explode("v").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most one row per exemplar token
    total = texts.where(F.col(text).isNotNull()).count()
    idf = {v: log((total + 1) / (counted.get(v, 0) + 1)) + 1 for v in vocabulary}
    index, known = [], []
    for name, bag in parsed.items():
        weight = {t: n * idf[t] for t, n in bag.items()}
        full = sum(weight.values())
        words_of = sorted(weight)
        known.append((name, words_of, [bag[t] for t in words_of], [idf[t] / full for t in words_of], sum(bag.values()) + SLACK))
        rest = full
        for t in sorted(weight, key=lambda t: (-weight[t], t)):  # without any of these the rest is below the threshold
            index.append((t, name))
            rest -= weight[t]
            if rest < threshold * full:
                break
    asked = spark.createDataFrame(index, "w string, exemplar string")
    about = spark.createDataFrame(known, "exemplar string, ws array<string>, times array<int>, idfs array<double>, width int")
    hits = rows.select("k", "t", F.explode(F.array_intersect("v", F.lit(sorted({t for t, _ in index})))).alias("w"))
    # both tables are as small as the list of exemplars
    pairs = hits.join(F.broadcast(asked), "w").select("k", "t", "exemplar").join(F.broadcast(about), "exemplar")

    def contained(start: Column) -> Column:
        passage = F.slice("t", start, F.col("width"))
        parts = F.transform("ws", lambda w, i: F.least(F.size(F.filter(passage, lambda p: p == w)), F.get("times", i)) * F.get("idfs", i))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    # a window that matters begins with a token of the exemplar
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.array_contains("ws", F.element_at("t", i)))
    scored = pairs.select("k", "exemplar", F.array_max(F.transform(starts, contained)).alias("score")).where(F.col("score") >= threshold - 1e-9)
    best = scored.groupBy("k").agg(F.max(F.struct("score", "exemplar")).alias("b"))
    return best.select(F.col("k").alias(key), "b.exemplar", F.col("b.score").alias("score"))


def residue_records(records: DataFrame, key: str, title: str, alerts: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, exemplar, score): records whose title or an alert holds residue. Null and empty arrays hold none."""
    texts = F.concat(F.array(F.col(title)), F.coalesce(F.col(alerts), F.array().cast("array<string>")))
    return residue_scores(records.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.explode(F.array_distinct(texts)).alias("_text")), "_key", "_text", threshold=threshold).withColumnRenamed("_key", key)


def without_residue(records: DataFrame, key: str, title: str, alerts: str, threshold: float = THRESHOLD) -> DataFrame:
    """records without those that residue_records finds; all columns, repeated rows and rows with a null key stay."""
    found = residue_records(records, key, title, alerts, threshold).select(F.col(key).alias("_residue"))
    return records.join(found, F.col(key) == F.col("_residue"), "left_anti")

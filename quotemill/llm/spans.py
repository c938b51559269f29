"""Long stretches of text shared between records, by compaction of a De Bruijn graph (problem 9).

Tokens are cut by content: among every `window` consecutive q-grams the one with the least hash is an anchor, and
a token reaches from one anchor to the next, so equal stretches have equal tokens wherever they stand. k tokens in a
row are an edge; any stretch of `least` characters that two records share holds at least one whole edge.

1. Edges are counted; those of two different texts are repeated, and only they go on (a few percent).
2. An edge whose occurrences all have the same next edge, which in turn always has it before, does not branch.
   Joining these facts to the occurrences compacts every nonbranching path of the graph into one node
   (unitig); all texts that touch a unitig hold the whole of it.
3. Source coordinates verify: around the first anchor of each unitig, windows of 9/10 of `least` characters are
   digested; texts with an equal window agree on the missing tenth if the characters beside it say so. With
   l characters shared before the anchor and r behind it, l + r >= least, one of the ten windows fits.

Copies of one text are one class from the start: a task handles each text once, however often it stands there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.leaks import codes_of, gram_hashes
from quotemill.operators.pairs import BLOCK, largest_group, pairs_within
from quotemill.runtime import checkpoint

BASE = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class SpanSettings:
    least: int = 400  #: characters of a shared stretch
    q: int = 32  #: characters of an anchor
    window: int = 90  #: of so many anchors in a row one is chosen
    k: int = 2  #: tokens of an edge
    chunk: int = 400_000  #: characters handled at once

    def __post_init__(self):
        if self.least - self.q + 2 < (self.k + 2) * self.window or self.least % 10:
            raise ValueError("a shared stretch must hold a whole edge; least must be a multiple of ten")


class _Powers:
    """BASE**i and its inverse modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b), dtype=np.uint64)])) for b in (BASE, pow(BASE, -1, 2**64)))
        return self.up, self.down


_POWERS = _Powers()


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in linear time."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, dtype=x.dtype)
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def edges_of(texts: list[str], cfg: SpanSettings) -> tuple[np.ndarray, ...]:
    """(text number, first character, second anchor, end, hash) of every edge of the texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    codes = codes_of("".join(texts))
    grams = gram_hashes(codes, cfg.q)
    ranked = (grams & ~LOW) | (LOW - np.arange(len(grams), dtype=np.uint64))  # of equal hashes the last is least
    least = sliding_minimum(ranked, cfg.window)
    text = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(least))
    inside = start + cfg.window + cfg.q - 1 <= ends[text[: len(least)]]
    at = (LOW - (least[inside] & LOW)).astype(np.int64)
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    k = cfg.k
    if len(at) <= k:
        return (np.empty(0, dtype=np.int64),) * 4 + (np.empty(0, dtype=np.uint64),)
    owner = text[at]
    same = owner[:-k] == owner[k:]
    lo, mid, hi = at[:-k][same], at[1 : len(at) - k + 1][same], at[k:][same] + cfg.q
    up, down = _POWERS.upto(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])
    h = (sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    n = owner[:-k][same]
    base = (ends - sizes)[n]
    return n, lo - base, mid - base, hi - base, h


def pieces(text: str, cfg: SpanSettings) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text in parts of cfg.chunk characters, which overlap so that every edge is whole in one.

    An anchor of a part is one of the text, and between two neighbouring ones of a part the text has no other: a window
    that reaches out of the part and holds both holds nothing that the part's outermost window does not.
    """
    step = max(cfg.chunk, 4 * cfg.least)
    for lo in range(0, max(1, len(text)), step):
        yield lo, text[lo : lo + step + (cfg.k + 2) * cfg.window + cfg.q]
        if lo + step >= len(text):
            break


def _edges(batches: Iterator[pd.DataFrame], cfg: SpanSettings) -> Iterator[pd.DataFrame]:
    seen: set[int] = set()

    def flush(parts: list[tuple[int, int, str]]) -> pd.DataFrame:
        n, lo, mid, hi, h = edges_of([t for _, _, t in parts], cfg)
        classes, offsets = np.array([c for c, _, _ in parts], dtype=np.int64)[n], np.array([o for _, o, _ in parts], dtype=np.int64)[n]
        return pd.DataFrame({"e": h.view(np.int64), "c": classes, "lo": (lo + offsets).astype(np.int32), "step": (mid - lo).astype(np.int32), "size": (hi - lo).astype(np.int32)})

    for batch in batches:
        parts: list[tuple[int, int, str]] = []
        size = 0
        for c, t in zip(batch["c"].tolist(), batch["t"]):
            if c in seen:
                continue
            seen.add(c)
            for offset, part in pieces(t, cfg):
                parts.append((c, offset, part))
                size += len(part)
                if size >= cfg.chunk:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)


def text_classes(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(d, c): the class of each record whose text has at least `least` characters; copies share a class."""
    return docs.where(F.col(key).isNotNull() & (F.length(F.col(text)) >= least)).select(F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("c"))


def repeated_edges(docs: DataFrame, text: str, cfg: SpanSettings) -> DataFrame:
    """(e, c, lo, mid, hi): occurrences of the edges that stand in at least two different texts; the next edge begins at mid."""
    long = docs.where(F.length(F.col(text)) >= cfg.least).select(F.xxhash64(text).alias("c"), F.col(text).alias("t"))
    edges = long.mapInPandas(lambda it: _edges(it, cfg), "e long, c long, lo int, step int, size int")
    # partial minima and maxima: a hot edge sends one row per task
    shared = edges.select("e", "c").groupBy("e").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("e")
    found = edges.join(shared, "e").dropDuplicates(["c", "lo"])
    return checkpoint(found.select("e", "c", "lo", (F.col("lo") + F.col("step")).alias("mid"), (F.col("lo") + F.col("size")).alias("hi")))


def unitigs(repeated: DataFrame) -> DataFrame:
    """(u, c, lo, hi, edges): occurrences of the maximal nonbranching paths of repeated edges; u: the first edge."""
    w = Window.partitionBy("c").orderBy("lo")
    near = repeated.select(
        "*", F.when(F.lead("lo").over(w) == F.col("mid"), F.lead("e").over(w)).alias("next"), F.when(F.lag("mid").over(w) == F.col("lo"), F.lag("e").over(w)).alias("last"),
    )
    one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    facts = near.groupBy("e").agg(F.when(one("next"), F.min("next")).alias("only_next"), F.when(one("last"), F.min("last")).alias("only_last"))
    ahead = facts.select(F.col("e").alias("x"), F.col("only_next").alias("x_next"))
    # an edge goes on its predecessor's path if each is the only neighbour of the other
    joined = facts.join(ahead, facts.only_last == ahead.x, "left").select("e", F.coalesce(F.col("x_next") == F.col("e"), F.lit(False)).alias("goes_on"))
    runs = near.join(joined, "e").select("c", "e", "lo", "hi", F.sum(F.when(F.col("goes_on") & F.col("last").isNotNull(), 0).otherwise(1)).over(w).alias("run"))
    return runs.groupBy("c", "run").agg(F.min_by("e", "lo").alias("u"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("edges")).drop("run")


def _windows(batches: Iterator[pd.DataFrame], cfg: SpanSettings) -> Iterator[pd.DataFrame]:
    step, size = cfg.least // 10, cfg.least - cfg.least // 10
    for batch in batches:
        rows = []
        for c, text, starts in zip(batch["c"].tolist(), batch["t"], batch["starts"]):
            for s in starts:
                for x in range(s, s - cfg.least, -step):
                    if x < 0:
                        break
                    if x + size <= len(text):
                        digest = hashlib.blake2b(text[x : x + size].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        rows.append((digest, c, text[max(0, x - step) : x], text[x + size : x + size + step]))
        yield pd.DataFrame(rows, columns=["w", "c", "before", "behind"])


def shared_classes(docs: DataFrame, key: str, text: str, cfg: SpanSettings, repeated: DataFrame) -> DataFrame:
    """(ca, cb): classes of different texts that share a stretch of cfg.least characters; ca < cb.

    Windows that more than BLOCK texts may hold are joined block by block: the same pairs, over many tasks.
    """
    step = cfg.least // 10
    wanted = unitigs(repeated).groupBy("c").agg(F.collect_set("lo").alias("starts"))  # bounded by the length of one text
    first = text_classes(docs, key, text, cfg.least).groupBy("c").agg(F.min("d").alias("d")).join(wanted, "c")
    texts = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).where(F.length("t") >= cfg.least)
    windows = texts.join(first, "d").select("c", "t", "starts").mapInPandas(lambda it: _windows(it, cfg), "w binary, c long, before string, behind string")
    windows = windows.dropDuplicates(["w", "c", "before", "behind"])
    meets = F.exists(
        F.sequence(F.lit(0), F.lit(step)),
        lambda k: (F.length("a.before") >= k) & (F.length("b.before") >= k) & (F.length("a.behind") >= step - k) & (F.length("b.behind") >= step - k)
        & (F.right(F.col("a.before"), k) == F.right(F.col("b.before"), k)) & (F.left(F.col("a.behind"), step - k) == F.left(F.col("b.behind"), step - k)),
    )
    hot = largest_group(repeated, ["e"]) > BLOCK
    pairs = pairs_within(windows, ["w"], "c", meets, BLOCK if hot else None)
    return pairs.select(F.col("a.c").alias("ca"), F.col("b.c").alias("cb")).distinct()


def shared_spans(docs: DataFrame, key: str, text: str, cfg: SpanSettings = SpanSettings()) -> DataFrame:
    """(a, b): records whose texts hold an identical stretch of cfg.least characters; a < b.

    Copies of one text are a class, and its lowest record speaks for it: it is linked with every copy (the membership of
    the class) and with the speakers of the classes that share a stretch with it, however many copies there are. No link
    between different texts is lost, and copies do not multiply links. `linked_classes` has the same by record.
    Null, empty and short texts share nothing; rows with a null key are left out; a repeated key counts once.
    Empty table: no rows. Extra columns are ignored.
    """
    members = text_classes(docs, key, text, cfg.least).distinct()
    speakers = members.groupBy("c").agg(F.min("d").alias("first"), F.count("*").alias("n"))
    pairs = shared_classes(docs, key, text, cfg, repeated_edges(docs, text, cfg))
    copies = speakers.where("n > 1").join(members, "c").where("d <> first").select(F.col("first").alias("a"), F.col("d").alias("b"))
    between = (
        pairs.join(speakers.select(F.col("c").alias("ca"), F.col("first").alias("x")), "ca").join(speakers.select(F.col("c").alias("cb"), F.col("first").alias("y")), "cb")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return between.union(copies)


def linked_classes(docs: DataFrame, key: str, text: str, cfg: SpanSettings = SpanSettings()) -> DataFrame:
    """(key, class, copies, links): for each record the lowest record with its text, how many other records have that
    text, and with how many different texts it shares a stretch of cfg.least characters.

    One row for every record whose text is long enough, by distinct keys; nulls and empty tables as in shared_spans.
    """
    members = text_classes(docs, key, text, cfg.least).distinct()
    speakers = members.groupBy("c").agg(F.min("d").alias("class"), (F.count("*") - 1).alias("copies"))
    pairs = shared_classes(docs, key, text, cfg, repeated_edges(docs, text, cfg))
    both = pairs.select("ca").union(pairs.select("cb")).groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("links"))
    rows = members.join(speakers, "c").join(both, "c", "left")
    return rows.select(F.col("d").alias(key), "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _stretch_windows(batches: Iterator[pd.DataFrame], cfg: SpanSettings) -> Iterator[pd.DataFrame]:
    """(w, c, lo, hi): digest and place of each whole unitig, and of every window of cfg.least characters in the zones of a text that lies in no unitig."""
    seen: set[int] = set()
    columns = ["w", "c", "lo", "hi"]
    for batch in batches:
        rows: list[tuple[bytes, int, int, int]] = []
        for c, text, zones, whole in zip(batch["c"].tolist(), batch["t"], batch["zones"], batch["whole"]):
            if c in seen:
                continue
            seen.add(c)

            def add(lo: int, hi: int) -> None:
                rows.append((hashlib.blake2b(text[lo:hi].encode("utf-8", "surrogatepass"), digest_size=16).digest(), c, lo, hi))

            held = sorted((u["lo"], u["hi"]) for u in (whole if whole is not None else ()))
            for lo, hi in held:
                add(lo, hi)
            x = k = 0
            for lo, hi in sorted((z["lo"], z["hi"]) for z in zones):
                x, last = max(x, lo), min(len(text), hi) - cfg.least
                while x <= last:
                    while k < len(held) and held[k][1] - cfg.least < x:
                        k += 1
                    if k < len(held) and held[k][0] <= x:
                        x = held[k][1] - cfg.least + 1
                        continue
                    add(x, x + cfg.least)
                    x += 1
                    if len(rows) >= cfg.chunk // 4:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)


def shared_stretches(docs: DataFrame, key: str, text: str, cfg: SpanSettings) -> DataFrame:
    """(c, covered, spans): characters of each class that lie in stretches of cfg.least characters or more which a
    different text holds too, and the number of such stretches (those that overlap or touch are one).

    Whatever two texts share from a to b, their anchors agree from a + window - 1 to b - window + 1: a path of repeated
    edges reaches at least that far. So every window of cfg.least characters that goes no further beyond a path is
    digested at source coordinates, and those that two texts hold are shared. Windows within a unitig lie within it in
    every text that holds them: the unitig is digested in their place. A hot window sends one row per task.
    """
    w = Window.partitionBy("c").orderBy("lo")
    repeated = repeated_edges(docs, text, cfg)
    steps = repeated.withColumn("new", F.when(F.lag("mid").over(w) == F.col("lo"), 0).otherwise(1))
    paths = steps.withColumn("path", F.sum("new").over(w)).groupBy("c", "path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    margin = cfg.window - 1
    long = paths.where(F.col("hi") - F.col("lo") + 2 * margin >= cfg.least)
    zone = F.struct(F.greatest(F.col("lo") - margin, F.lit(0)).alias("lo"), (F.col("hi") + margin).alias("hi"))
    zones = long.groupBy("c").agg(F.collect_list(zone).alias("zones"))  # bounded by the length of one text
    whole = unitigs(repeated).where(F.col("hi") - F.col("lo") >= cfg.least).groupBy("c").agg(F.collect_list(F.struct("lo", "hi")).alias("whole"))
    wanted = zones.join(whole, "c", "left")
    first = text_classes(docs, key, text, cfg.least).groupBy("c").agg(F.min("d").alias("d")).join(wanted, "c")
    texts = docs.where(F.length(F.col(text)) >= cfg.least).select(F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("c"), F.col(text).alias("t"))
    windows = texts.join(first, ["d", "c"]).select("c", "t", "zones", "whole").mapInPandas(lambda it: _stretch_windows(it, cfg), "w binary, c long, lo int, hi int")
    shared = windows.groupBy("w").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("w")
    past = F.max("hi").over(Window.partitionBy("c").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    found = windows.join(shared, "w").select("c", "lo", "hi").distinct().withColumn("past", past)
    return found.groupBy("c").agg(
        F.sum(F.greatest(F.col("hi") - F.greatest("lo", "past"), F.lit(0))).alias("covered"), F.sum(F.when(F.col("lo") <= F.col("past"), 0).otherwise(1)).alias("spans")
    )


def shared_share(docs: DataFrame, key: str, text: str, cfg: SpanSettings = SpanSettings()) -> DataFrame:
    """(key, chars, copies, spans, shared, share): for each record, how much of its text is found in other records.

    A text with copies is shared as a whole. Else `shared` counts the characters that lie in a stretch of cfg.least
    characters or more which a different text holds too, each once; `spans` counts these stretches. Null texts have 0
    characters and share 0. Rows with a null key are left out, also as holders of a stretch.
    """
    docs = docs.where(F.col(key).isNotNull())
    covered = shared_stretches(docs, key, text, cfg)
    rows = docs.select(F.col(key).cast("long").alias("d"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.xxhash64(text).alias("c"))
    copies = text_classes(docs, key, text, cfg.least).groupBy("c").agg((F.count("*") - 1).alias("copies"))
    shared = F.when(F.col("copies") > 0, F.col("chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
    return rows.join(copies, "c", "left").join(covered, "c", "left").select(
        F.col("d").alias(key), "chars", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("spans", F.lit(0)).alias("spans"), shared.alias("shared"),
        F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(0.0).alias("share"),
    )

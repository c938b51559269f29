"""Evaluation passages inside training texts, by q-gram lemma filtering and banded alignment (problem 8).

A passage is a run of `words` consecutive words of an item. If a text holds a passage of n characters with at most e
edits, the two share at least n - q + 1 - q e character q-grams on diagonals no more than e apart (q-gram lemma).
So the q-grams of every text are looked up in an index of the items' q-grams, hits are counted in overlapping
bands of diagonals, and bands that reach the bound of the item's shortest passage are kept, in them the passages
that reach their own bound. A banded alignment, of all passages of an Arrow batch at once, then decides which of them
the text holds within the edit budget. p8_edited reports these; for p8_found the regions that hold one are compared
word by word, and only unchanged passages count.

Both sides are compared as words (runs of letters or digits) in lower case, joined by single blanks. Texts are
never shuffled: items are few, and go to every task in blocks of proven size; with more items there are more
blocks, not larger ones. The look-up is one pass of vectorised arithmetic over all characters of an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakSettings:
    words: int = 12  #: words in a row that make a passage
    q: int = 11  #: characters of a q-gram
    edits: int = 1  #: edit budget of a passage
    exact: bool = True  #: of the passages within the budget only unchanged ones count
    block_chars: int = 2_000_000  #: characters of items that a task holds at once
    bits: int = 22  #: size of the first look-up table, as a power of two


def normal(text: str | None) -> str:
    """The words of a text in lower case, joined by single blanks."""
    return " ".join(WORD.findall(text.lower())) if text else ""


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q consecutive characters; q >= 1."""
    done, h = 1, codes.astype(np.uint64) + np.uint64(1)
    step = h
    while done < q:  # hashes of 2, 4, ... characters; the last step overlaps
        take = min(done, q - done)
        n = len(step) - take
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        step = step[:n] * FACTOR + step[take : take + n]
        step ^= step >> np.uint64(29)
        done += take
    return step


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def aligned(passages: list[np.ndarray], texts: list[np.ndarray], budget: int, reach: int) -> np.ndarray:
    """For each passage whether it occurs in its text with at most `budget` edits, beginning among the first reach + 1 places.

    Dynamic programming over the band of diagonals that these beginnings and edits allow, a row of all passages at once.
    """
    n, width, over = len(passages), reach + 2 * budget + 1, budget + 1
    done = np.zeros(n, dtype=bool)
    if not n:
        return done
    sizes, ends = (np.array([len(x) for x in side], dtype=np.int64) for side in (passages, texts))
    order = np.argsort(-sizes, kind="stable")  # those still open are a prefix
    longest = int(sizes.max())
    a = np.full((n, longest), -1, dtype=np.int64)
    b = np.full((n, longest + width + budget + 2), -2, dtype=np.int64)  # column j - 1 of a text is at j + budget
    for row, k in enumerate(order.tolist()):
        a[row, : sizes[k]] = passages[k]
        m = min(int(ends[k]), b.shape[1] - budget - 1)
        b[row, budget + 1 : budget + 1 + m] = texts[k][:m]
    sizes, ends = sizes[order], ends[order]
    d = np.arange(width)
    first = d - budget  # cell d of row i is column i - budget + d
    cells = np.where((first >= 0) & (first <= np.minimum(reach, ends)[:, None]), 0, over)
    cells = np.where((first >= 0) & (first <= ends[:, None]), np.minimum(np.minimum.accumulate(cells - d, axis=1) + d, over), over)
    open_rows = n
    for i in range(1, longest + 1):
        while open_rows and sizes[open_rows - 1] < i:
            open_rows -= 1
        row = cells[:open_rows]
        column = i - budget + d
        there = (column >= 0) & (column <= ends[:open_rows, None])
        new = row + (a[:open_rows, i - 1, None] != b[:open_rows, i : i + width])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.where(there, new, over)
        new = np.minimum.accumulate(new - d, axis=1) + d
        cells[:open_rows] = np.where(there, np.minimum(new, over), over)
    done[order] = cells.min(axis=1) <= budget
    return done


class Index:
    """The q-grams of a block of items: where each occurs, behind a bit table that most grams of a text fail."""

    def __init__(self, items: list[tuple[int, str]], cfg: LeakSettings):
        self.cfg = cfg
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.tokens = [t.split(" ") for t in self.texts]
        self.codes = [codes_of(t) for t in self.texts]
        self.starts: list[np.ndarray] = []  # of the passages of each item
        self.ends: list[np.ndarray] = []
        for words in self.tokens:
            after = np.cumsum([len(w) + 1 for w in words])
            n = max(0, len(words) - cfg.words + 1)
            self.starts.append(np.concatenate([[0], after])[:n].astype(np.int64))
            self.ends.append(after[cfg.words - 1 :].astype(np.int64) - 1)
        sizes = [e - s for s, e in zip(self.starts, self.ends)]
        self.widest = [int(x.max()) if len(x) else 0 for x in sizes]
        self.bounds = np.array([max(1, (int(x.min()) if len(x) else 0) - cfg.q + 1 - cfg.q * cfg.edits) for x in sizes], dtype=np.int64)
        hashes, item, place = [], [], []
        for n, text in enumerate(self.texts):
            if self.widest[n]:
                h = gram_hashes(codes_of(text), cfg.q)
                hashes.append(h)
                item.append(np.full(len(h), n, dtype=np.int64))
                place.append(np.arange(len(h), dtype=np.int64))
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = np.concatenate(item)[order] if item else np.empty(0, dtype=np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, dtype=np.int64)
        self.table = np.zeros(1 << cfg.bits, dtype=bool)
        self.table[(self.hash >> np.uint64(64 - cfg.bits)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(item, positions, places, least diagonal) of the bands of a text whose hits reach the item's bound."""
        cfg = self.cfg
        h = gram_hashes(codes, cfg.q)
        at = np.nonzero(self.table[(h >> np.uint64(64 - cfg.bits)).astype(np.int64)])[0]
        if not len(at):
            return
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        count = hi - lo
        at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
        if not len(at):
            return
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        pos, item, place = np.repeat(at, count), self.item[where], self.place[where]
        diagonal = pos - place
        width = cfg.edits + 1  # bands of 2 e + 2 diagonals, each overlapping the next by half
        for shift in (0, 1) if cfg.edits else (0,):
            band = np.floor_divide(diagonal + shift * width, 2 * width) if cfg.edits else diagonal
            order = np.lexsort((pos, band, item))
            i, b = item[order], band[order]
            new = np.concatenate([[True], (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
            start = np.nonzero(new)[0]
            end = np.concatenate([start[1:], [len(i)]])
            enough = end - start >= self.bounds[i[start]]
            for s, e in zip(start[enough].tolist(), end[enough].tolist()):
                mine = order[s:e]
                yield int(i[s]), pos[mine], place[mine], int(diagonal[mine].min())

    def passages(self, item: int, places: np.ndarray) -> list[tuple[int, int]]:
        """(first character, end) of the item's passages that have as many of their q-grams among `places` as the lemma asks."""
        cfg, start, end = self.cfg, self.starts[item], self.ends[item]
        hit = np.zeros(len(self.texts[item]) + 1, dtype=np.int64)
        hit[places + 1] = 1
        hits = np.cumsum(hit)
        grams = np.maximum(end - start - cfg.q + 1, 0)
        good = hits[start + grams] - hits[start] >= np.maximum(grams - cfg.q * cfg.edits, 1)
        return list(zip(start[good].tolist(), end[good].tolist()))

    def longest(self, item: int, words: str) -> int:
        """The most words in a row of an item that a region holds, if at least cfg.words."""
        cfg, own = self.cfg, self.tokens[item]
        padded, best = f" {words} ", 0
        for k in range(len(own) - cfg.words + 1):
            n = max(cfg.words, best + 1)
            while k + n <= len(own) and f" {' '.join(own[k : k + n])} " in padded:
                best = n
                n += 1
        return best

    def pieces(self, text: str, piece: int) -> Iterator[str]:
        """A text in pieces that overlap by more than any item, so that each run is whole in one."""
        if len(text) <= piece:
            yield text
            return
        overlap = 2 * max(map(len, self.texts), default=0) + 4 * self.cfg.q
        for lo in range(0, len(text), piece):
            first = text.rfind(" ", 0, lo) + 1 if lo else 0
            last = text.find(" ", min(len(text), lo + piece + overlap))
            yield text[first : last if last >= 0 else len(text)]

    def search(self, texts: Sequence[str], piece: int = 1_000_000) -> dict[tuple[int, int], int]:
        """(number of the text, item) -> words of the longest run; with an edit budget and not exact, of a passage."""
        cfg = self.cfg
        found: dict[tuple[int, int], int] = {}
        regions: list[tuple[int, int, str, int, int]] = []  # text, item, piece, first and last hit
        tasks: list[int] = []
        ours: list[np.ndarray] = []
        theirs: list[np.ndarray] = []
        reach = 4 * cfg.edits + 2

        def decide() -> None:
            held = aligned(ours, theirs, cfg.edits, reach)
            for r in sorted({r for r, good in zip(tasks, held.tolist()) if good}):
                n, item, part, first, last = regions[r]
                words = cfg.words
                if cfg.exact:
                    beyond = self.widest[item] + 1
                    lo = part.rfind(" ", 0, max(0, first - beyond)) + 1
                    hi = part.find(" ", min(len(part), last + cfg.q + beyond))
                    words = self.longest(item, part[lo : hi if hi >= 0 else len(part)])
                if words > found.get((n, item), 0):
                    found[n, item] = words
            regions.clear(), tasks.clear(), ours.clear(), theirs.clear()

        for n, text in enumerate(texts):
            if not len(self.hash) or len(text) < cfg.q:
                continue
            for part in self.pieces(text, piece):
                codes = codes_of(part)
                for item, pos, places, diagonal in self.regions(codes):
                    own = self.codes[item]
                    for start, end in self.passages(item, places):
                        lo = max(0, start + diagonal - cfg.edits)
                        tasks.append(len(regions))
                        ours.append(own[start:end])
                        theirs.append(codes[lo : lo + end - start + reach + cfg.edits])
                    regions.append((n, item, part, int(pos.min()), int(pos.max())))
                    if len(tasks) >= 20_000:
                        decide()
        decide()
        return found


def _blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most `most` characters (an item above that is a block), read partition by partition."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    for r in rows.toLocalIterator():
        t = normal(r.t)
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append((r.k, t))
        size += len(t)
    if block:
        yield block


def leaked_items(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, cfg: LeakSettings = LeakSettings()) -> DataFrame:
    """(doc, item, words): texts that hold a passage of an item, with the longest run of its words they hold.

    If cfg.exact is off, passages with at most cfg.edits characters changed count too, and `words` is their length. Null and blank texts hold nothing, items of fewer
    than cfg.words words have no passage, rows with a null key are left out; a repeated key comes out once per
    item, with its longest run. Empty tables give no rows. Extra columns are ignored.
    """
    if cfg.q * (cfg.edits + 1) > 2 * cfg.words - 1:
        raise ValueError("q-grams must be short enough for the shortest passage")
    texts = docs.where(F.col(doc).isNotNull() & (F.length(F.col(text)) >= cfg.q)).select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t"))
    found = []
    for block in _blocks(items, item, item_text, cfg.block_chars):

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            index = Index(block, cfg)
            for batch in batches:
                keys = batch["d"].tolist()
                rows = [(keys[k], index.ids[i], n) for (k, i), n in index.search([normal(t) for t in batch["t"]]).items()]
                yield pd.DataFrame(rows, columns=["d", "i", "n"])

        found.append(texts.mapInPandas(run, "d long, i long, n int"))
    if not found:
        return texts.select(F.col("d").alias(doc), F.lit(None).cast("long").alias(item), F.lit(None).cast("int").alias("words")).limit(0)
    merged = reduce(DataFrame.union, found)
    return merged.groupBy(F.col("d").alias(doc), F.col("i").alias(item)).agg(F.max("n").alias("words"))

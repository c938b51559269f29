"""Filling containers of fixed capacity with whole texts, by variable-capacity best fit (problem 7).

Texts are measured in tokens where they are read and packed in the same task, with no shuffle: a task holds two
numbers per text of its part of the input (spark.sql.files.maxPartitionBytes), and its containers depend on that part
alone, so a lost task gives the same ones again. Per task at most a container or two stay badly filled.

The largest item left opens a container, and the container takes, again and again, the item that leaves it the least
room. Which of the permitted sizes is opened is decided by trying them all on the items left: the least cost per
token that the container would really hold. The cost of a container of p tokens is p (1 + p / REACH), as attention
costs the square of the length, and WASTE for each token of room: no size is taken that leaves more room than another
can spare. At the end every container shrinks to the smallest permitted size that holds its contents.
Only an item above the largest size is split: into full containers and a remainder, which is packed like an item.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.runtime import bounded_rows

#: The vocabulary's folder is a parameter of the queries; the file is never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits text before its merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OUT = "pack bigint, container string, capacity int, used int, id bigint, piece int, first_token bigint, tokens int"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Longest stretch given to the tokenizer at once; longer texts are cut after white space, where no token reaches across.
STRETCH = 100_000


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """text in parts whose tokens are those of the whole: cut before the last space followed by a letter or digit."""
    lo = 0
    while len(text) - lo > most:
        cut = lo + most
        while cut > lo + 1 and not (text[cut] == " " and text[cut - 1] > " " and not text[cut - 1].isspace() and cut + 1 < len(text) and text[cut + 1].isalnum()):
            cut -= 1
        if cut <= lo + 1:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a text; null and empty texts have none. Special tokens' strings are ordinary text."""
    encode = tokenizer(vocabulary).encode_ordinary
    return sum(len(encode(part)) for part in stretches(text)) if text else 0


#: Length at which attention costs as much as all the rest.
REACH = 24_576
#: Cost of a token of room, in tokens.
WASTE = 64.0


class _Stock:
    """Items left by size; the largest size of at most x is found in nearly constant time, as sizes only run out."""

    def __init__(self, sizes: Sequence[int], largest: int):
        self.items: dict[int, list[int]] = {}
        for i in range(len(sizes) - 1, -1, -1):
            self.items.setdefault(sizes[i], []).append(i)
        self.below = list(range(-1, largest))  # by size + 1: a size that is there, or one to go on from
        for s in self.items:
            self.below[s + 1] = s + 1
        self.below[0] = 0

    def fit(self, x: int) -> int:
        """The largest size of at most x, -1 if there is none."""
        at, below = x + 1, self.below
        root = at
        while below[root] != root:
            root = below[root]
        while below[at] != root:
            below[at], at = root, below[at]
        return root - 1

    def fill(self, room: int) -> list[tuple[int, int]]:
        """[(size, number)]: what a container takes that always takes the item that leaves the least room."""
        took = []
        s = self.fit(room)
        while s > 0:
            n = min(len(self.items[s]), room // s)
            took.append((s, n))
            room -= n * s
            s = self.fit(min(s - 1, room))
        return took

    def take(self, size: int) -> int:
        items = self.items[size]
        i = items.pop()
        if not items:
            del self.items[size]
            self.below[size + 1] = size
        return i


def cost(capacity: int, held: int) -> float:
    """Cost of a container by token it holds."""
    return (capacity * (1 + capacity / REACH) + WASTE * (capacity - held)) / held


def best_fit(sizes: Sequence[int], capacities: Sequence[int]) -> list[tuple[int, list[int]]]:
    """[(capacity, items)]: a packing of items (by index, each at most the largest capacity) into permitted containers.

    Items of equal size keep their order; items without a token lie in the first container, in one of the least
    capacity if there is no other. Of containers that cost the same the smaller one is opened.
    """
    permitted = sorted(set(capacities))
    if max(sizes, default=0) > permitted[-1]:
        raise ValueError("an item is larger than every container")
    stock = _Stock(sizes, permitted[-1] + 1)
    empty = stock.items.pop(0, [])[::-1]
    stock.below[1] = 0
    out: list[tuple[int, list[int]]] = []
    while (largest := stock.fit(permitted[-1])) > 0:
        trials = [stock.fill(p) for p in permitted if p >= largest]
        held = [sum(s * n for s, n in trial) for trial in trials]
        best = min(range(len(trials)), key=lambda i: (cost(permitted[len(permitted) - len(trials) + i], held[i]), i))
        items = [stock.take(s) for s, n in trials[best] for _ in range(n)]
        out.append((min(p for p in permitted if p >= held[best]), items))
    if empty:
        if not out:
            out.append((permitted[0], []))
        out[0][1].extend(empty)
    return out


def _pack_rows(ids: list[int], tokens: list[int], pack: int, capacities: Sequence[int], task: str) -> pd.DataFrame:
    top = max(capacities)
    units: list[tuple[int, int, int, int]] = []  # id, piece, first token, size
    rows: list[tuple] = []
    serial = 0
    for doc, n in zip(ids, tokens):
        full = (n - 1) // top if n > top else 0
        for k in range(full):
            rows.append((pack, f"{task}-{serial}", top, top, doc, k, k * top, top))
            serial += 1
        units.append((doc, full, full * top, n - full * top))
    for cap, members in best_fit([u[3] for u in units], capacities):
        name, held = f"{task}-{serial}", sum(units[i][3] for i in members)
        serial += 1
        rows += [(pack, name, cap, held, *units[i]) for i in members]
    return pd.DataFrame(rows, columns=["pack", "container", "capacity", "used", "id", "piece", "first_token", "tokens"])


def pack_texts(df: DataFrame, key: str, text: str, plans: dict[int, Sequence[int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per placed piece of text: OUT. plans: permitted capacities (in tokens) by pack number.

    `container` is unique within a pack, `used` the tokens in it, `piece` the number of the part of a split text and
    `first_token` where it begins. Null and empty texts have no tokens and lie in a container like others, without
    taking room; rows with a null key are left out; repeated keys are packed row by row. Equal sizes keep their
    order. No texts: no rows. Extra columns are ignored.
    """
    if any(c < 1 for caps in plans.values() for c in caps) or not all(plans.values()):
        raise ValueError("every pack needs capacities of at least one token")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids: list[int] = []
        tokens: list[int] = []
        for batch in batches:
            ids += batch["key"].tolist()
            tokens += [count_tokens(t, vocabulary) for t in batch["text"]]
        if ids:
            for pack, capacities in plans.items():
                yield _pack_rows(ids, tokens, pack, capacities, str(TaskContext.get().partitionId()))

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(run, OUT)


def capacities_of(packs: DataFrame) -> dict[int, int]:
    """max_tokens by pack_id; the table of container sizes is proven small."""
    rows = bounded_rows(packs.where("max_tokens > 0").select("pack_id", "max_tokens"), 1000)
    if rows is None:
        raise ValueError("more than 1000 container sizes")
    return {int(r.pack_id): int(r.max_tokens) for r in rows}


def fill(placed: DataFrame) -> DataFrame:
    """pack, capacity, containers, used, room (share unused) of a packing."""
    each = placed.groupBy("pack", "container").agg(F.first("capacity").alias("capacity"), F.sum("tokens").alias("used"))
    return each.groupBy("pack", "capacity").agg(
        F.count("*").alias("containers"), F.sum("used").alias("used"), (1 - F.sum("used") / F.sum("capacity")).alias("room")
    )

import os
import random

import pytest
from pyspark.sql import functions as F

from quotemill.llm import packing
from quotemill.llm.packing import best_fit, count_tokens, pack_texts, stretches, tokenizer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary here")


def test_best_fit_holds_everything_and_is_near_the_bound():
    rng = random.Random(3)
    for capacities in ([512], [512, 1024, 2048, 8192]):
        sizes = [min(int(rng.expovariate(1 / 300)), max(capacities)) for _ in range(3000)]
        packed = best_fit(sizes, capacities)
        assert sorted(i for _, m in packed for i in m) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in m) <= c and c in capacities for c, m in packed)
        assert sum(sizes) / sum(c for c, _ in packed) > 0.985


def test_sizes_are_optimised_jointly():
    rng = random.Random(4)
    sizes = [min(int(rng.lognormvariate(6, 1)) + 1, 8192) for _ in range(4000)]
    room = lambda packed: 1 - sum(sizes) / sum(c for c, _ in packed)
    joint = best_fit(sizes, [512, 1024, 2048, 8192])
    opened = {c: sum(x for x, _ in joint if x == c) / sum(x for x, _ in joint) for c in (512, 1024, 2048, 8192)}
    assert all(share > 0.03 for share in opened.values())
    assert room(joint) <= room(best_fit(sizes, [8192]))
    # a container takes the item that leaves the least room; a size that leaves none is worth it
    assert best_fit([6, 4, 3, 3], [10, 12]) == [(10, [0, 1]), (10, [2, 3])]
    assert best_fit([6, 3, 3], [10, 12]) == [(12, [0, 1, 2])]


def test_small_cases():
    assert best_fit([], [5]) == []
    assert best_fit([5, 5], [5]) == [(5, [0]), (5, [1])]
    assert best_fit([3, 2, 2, 3], [5]) == [(5, [0, 1]), (5, [3, 2])]
    assert best_fit([4], [5, 10, 100]) == [(5, [0])]
    assert best_fit([0, 0], [5]) == [(5, [0, 1])]
    with pytest.raises(ValueError):
        best_fit([11], [5, 10])


@needs_vocabulary
def test_long_texts_are_counted_in_parts():
    text = "Fares rose again, by 4.7 percent.  A new line\n follows " * 300
    encode = tokenizer(packing.VOCABULARY).encode_ordinary
    for most in (50, 777, 10**6):
        assert "".join(stretches(text, most)) == text
        assert sum(len(encode(p)) for p in stretches(text, most)) == len(encode(text))
    assert sum(map(len, stretches("x" * 5000, 100))) == 5000
    assert count_tokens(None) == count_tokens("") == 0 and count_tokens("<|endoftext|>") > 1


@needs_vocabulary
def test_pack_texts(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 700, "x"), (5, "a b c", "x"), (5, "a b c", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc long, text string, container string").repartition(2)
    got = pack_texts(df, "doc", "text", {1: [16], 2: [8, 64]}).collect()
    for pack, top in ((1, 16), (2, 64)):
        mine = [r for r in got if r.pack == pack]
        by_container = {}
        for r in mine:
            by_container.setdefault(r.container, []).append(r)
        assert all(sum(r.tokens for r in x) == x[0].used <= x[0].capacity for x in by_container.values())
        assert {r.capacity for r in mine} <= {16} if pack == 1 else {8, 64}
        long = sorted((r.piece, r.first_token, r.tokens) for r in mine if r.id == 4)
        total = count_tokens("word " * 700)
        assert sum(x[2] for x in long) == total and [x[1] for x in long] == [i * top for i in range(len(long))]
        assert sum(1 for r in mine if r.id == 5) == 2 and {r.id for r in mine} == {1, 2, 3, 4, 5}
    assert pack_texts(df.where(F.lit(False)), "doc", "text", {1: [16]}).collect() == []
    with pytest.raises(ValueError):
        pack_texts(df, "doc", "text", {1: []})

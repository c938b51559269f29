import random

import numpy as np
import pytest

from quotemill.llm import spans
from quotemill.llm.spans import SpanSettings, edges_of, linked_classes, pieces, repeated_edges, shared_share, shared_spans, sliding_minimum, unitigs

SMALL = SpanSettings(least=60, q=6, window=14, k=2)


def brute(docs, least):
    grams = {}
    for d, t in docs:
        for k in range(len(t or "") - least + 1):
            grams.setdefault(t[k : k + least], set()).add(d)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def spoken(docs, least):
    """The links of brute force between the lowest records of each text, and of each of these with its copies."""
    first = {}
    for d, t in docs:
        if t and len(t) >= least:
            first[t] = min(d, first.get(t, d))
    text = dict(docs)
    links = {(a, b) for a, b in brute(docs, least) if text[a] != text[b] and {a, b} <= set(first.values())}
    return links | {(first[t], d) for d, t in docs if t in first and d != first[t]}


def texts(rng, n):
    letters = "abcdefghij ज"
    fresh = lambda k: "".join(rng.choice(letters) for _ in range(k))
    docs = [fresh(rng.randint(80, 400)) for _ in range(n)]
    for _ in range(n):
        a, b = rng.randrange(n), rng.randrange(n)
        size = rng.choice([40, 58, 59, 60, 61, 75, 120])
        k = rng.randint(0, max(0, len(docs[a]) - size))
        at = rng.randint(0, len(docs[b]))
        docs[b] = docs[b][:at] + docs[a][k : k + size] + docs[b][at:]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, c string")


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 99, 1000).astype(np.uint64)
    for w in (1, 2, 7, 100, 1000):
        assert np.array_equal(sliding_minimum(x, w), np.lib.stride_tricks.sliding_window_view(x, w).min(axis=1))
    assert len(sliding_minimum(x, 1001)) == 0


def test_edges_do_not_depend_on_neighbours():
    rng = random.Random(4)
    docs = texts(rng, 10)
    n, *columns = edges_of(docs, SMALL)
    for k, t in enumerate(docs):
        _, *alone = edges_of([t], SMALL)
        assert all(np.array_equal(a[n == k], b) for a, b in zip(columns, alone))


def test_pieces_of_a_long_text_have_its_edges():
    text = "".join(random.Random(6).choice("abcdef") for _ in range(5000)) + "ab" * 500
    _, *whole = edges_of([text], SMALL)
    cut = SpanSettings(least=60, q=6, window=14, k=2, chunk=300)
    found = set()
    for offset, part in pieces(text, cut):
        _, lo, mid, hi, h = edges_of([part], cut)
        found |= set(zip((lo + offset).tolist(), (mid + offset).tolist(), (hi + offset).tolist(), h.tolist()))
    assert len(list(pieces(text, cut))) > 10 and found == set(zip(*(x.tolist() for x in whole)))


def test_against_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        docs = list(enumerate(texts(rng, 60)))
        docs += [(500, docs[3][1]), (501, docs[3][1]), (502, None), (503, ""), (504, "x" * 200), (505, "x" * 100), (None, docs[5][1]), (7, docs[7][1])]
        df = frame(spark, docs).repartition(3)
        got = [tuple(r) for r in shared_spans(df, "doc_id", "text", SMALL).collect()]
        known = [(d, t) for d, t in docs if d is not None]
        assert len(got) == len(set(got)) and set(got) == spoken(known, 60)
        links = brute(known, 60)
        text, own = dict(known), {r.doc_id: r for r in linked_classes(df, "doc_id", "text", SMALL).collect()}
        assert set(own) == {d for d, t in known if t and len(t) >= 60}
        for d, r in own.items():
            with_it = {x for x in own if text[x] == text[d]}
            assert r["class"] == min(with_it) and r.copies == len(with_it) - 1
            assert r.links == len({text[b] if a == d else text[a] for a, b in links if d in (a, b)} - {text[d]})
        assert len(got) > 20


def test_unitigs_are_equal_stretches(spark):
    docs = list(enumerate(texts(random.Random(8), 40)))
    df = frame(spark, docs)
    by_hash = {r.c: r.t for r in df.selectExpr("xxhash64(text) c", "text t").collect()}
    seen = {}
    for r in unitigs(repeated_edges(df, "text", SMALL)).collect():
        seen.setdefault(r.u, []).append((r.c, by_hash[r.c][r.lo : r.hi]))
    assert seen and all(len({t for _, t in x}) == 1 and len({c for c, _ in x}) > 1 for x in seen.values())


def test_copies_do_not_multiply_links(spark):
    t = "".join(random.Random(2).choice("abcdefgh") for _ in range(200))
    for n in (2, 3, 10, 300):
        docs = [(i, t) for i in range(n)] + [(900, "0123" + t[:80])]
        got = [tuple(r) for r in shared_spans(frame(spark, docs), "doc_id", "text", SMALL).collect()]
        assert sorted(got) == [(0, i) for i in range(1, n)] + [(0, 900)]


def test_a_footer_of_many_texts_is_joined_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    fresh = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    footer = fresh(70)
    docs = [(i, fresh(90) + (footer if i % 3 else footer[:55])) for i in range(120)]
    whole = {tuple(r) for r in shared_spans(frame(spark, docs), "doc_id", "text", SMALL).collect()}
    monkeypatch.setattr(spans, "BLOCK", 7)
    cut = [tuple(r) for r in shared_spans(frame(spark, docs), "doc_id", "text", SMALL).collect()]
    assert len(cut) == len(set(cut)) and set(cut) == whole == {(a, b) for a in range(120) for b in range(a + 1, 120) if a % 3 and b % 3}


def test_share(spark):
    rng = random.Random(9)
    fresh = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    common = fresh(300)
    docs = [(1, fresh(100) + common + fresh(100)), (2, common), (3, fresh(300)), (4, common[::-1]), (5, common[::-1]), (6, None)]
    got = {r.doc_id: r for r in shared_share(frame(spark, docs), "doc_id", "text", SMALL).collect()}
    assert 300 - 40 <= got[1].shared <= 300 and 260 <= got[2].shared <= 300 and got[3].shared == 0
    assert got[4].share == 1.0 and got[4].copies == 1 and (got[6].chars, got[6].share) == (0, 0.0)


def covered(docs, least):
    """Characters and stretches of each text that other texts hold, by all windows of `least` characters."""
    holders, out = {}, {}
    for t in {t for _, t in docs if t}:
        for k in range(len(t) - least + 1):
            holders.setdefault(t[k : k + least], set()).add(t)
    for d, t in docs:
        inside = set()
        for k in range(len(t or "") - least + 1):
            if len(holders[t[k : k + least]]) > 1:
                inside |= set(range(k, k + least))
        out[d] = (len(inside), sum(i - 1 not in inside for i in inside))
    return out


def test_a_window_repeated_in_one_text_keeps_every_context(spark):
    rng = random.Random(40)
    fresh = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    docs = []
    for n in range(12):
        common = fresh(60)
        near = "".join(fresh(40) + "-" + common[:59] + "+" for _ in range(6))
        docs += [(2 * n, near + fresh(30) + common + fresh(30)), (2 * n + 1, fresh(40) + common + fresh(40))]
    got = {tuple(r) for r in shared_spans(frame(spark, docs), "doc_id", "text", SMALL).collect()}
    assert got == brute(docs, 60) == {(2 * n, 2 * n + 1) for n in range(12)}


def test_share_against_brute_force(spark):
    for seed in range(3):
        docs = list(enumerate(texts(random.Random(20 + seed), 60)))
        docs += [(500, "x" * 200), (501, "x" * 100), (502, None), (503, "short"), (504, docs[3][1]), (505, docs[7][1][:55] + "!")]
        want = covered(docs, 60)
        copied = {d for d, t in docs if t and len(t) >= 60 and sum(t == u for _, u in docs) > 1}
        got = {r.doc_id: r for r in shared_share(frame(spark, docs + [(None, docs[9][1] + "-")]).repartition(3), "doc_id", "text", SMALL).collect()}
        assert set(got) == {d for d, _ in docs} and copied >= {3, 504}
        for d, t in docs:
            assert (got[d].shared, got[d].spans) == (len(t) if d in copied else want[d][0], want[d][1])
        assert sum(r.shared > 0 for r in got.values()) > 20


def test_texts_that_share_too_little_have_no_share(spark):
    rng = random.Random(30)
    fresh = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    common = [fresh(399 + n % 2) for n in range(4)]
    docs = [(i, fresh(500) + "CD"[i % 2] + common[i // 2] + "AB"[i % 2] + fresh(500)) for i in range(8)]
    got = {r.doc_id: (r.shared, r.spans) for r in shared_share(frame(spark, docs), "doc_id", "text").collect()}
    assert got == {d: (400, 1) if d // 2 % 2 else (0, 0) for d, _ in docs}


def test_empty_and_settings(spark):
    assert shared_spans(frame(spark, []), "doc_id", "text", SMALL).collect() == []
    with pytest.raises(ValueError):
        SpanSettings(window=200)

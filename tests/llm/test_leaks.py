import random

import numpy as np
import pytest

from quotemill.llm.leaks import Index, LeakSettings, aligned, codes_of, gram_hashes, leaked_items, normal

VOCABULARY = [f"w{i}" for i in range(30)] + ["ñandú", "x", "ज"]


def brute(doc, item, words=12):
    a, b = normal(item).split(" "), f" {normal(doc)} "
    return any(f" {' '.join(a[k:k + words])} " in b for k in range(len(a) - words + 1)) if item else False


def leaks(spark, docs, items, **cfg):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, words string")
    return {(r.doc_id, r.item_id): r.words for r in leaked_items(d, "doc_id", "text", i, "item_id", "text", LeakSettings(**cfg)).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(VOCABULARY)
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 40))), "x") for i in range(20)]
    docs = [(900, None, "x"), (901, "", "x"), (902, "  \n ", "x"), (None, items[0][1], "x")]
    for d in range(150):
        own = rng.choice(items)[1].split(" ")
        n = rng.choice([11, 12, 13, 30])
        k = rng.randint(0, max(0, len(own) - n))
        piece = [w.upper() if rng.random() < 0.3 else w for w in own[k : k + n]]
        glue = rng.choice([" ", ", ", "\n", "-", "  "])
        docs.append((d, " ".join(word() for _ in range(rng.randint(0, 30))) + " " + glue.join(piece) + rng.choice(["", "x", ".", " y"]) + " " + " ".join(word() for _ in range(5)), "x"))
    want = {(d, i) for d, t, _ in docs for i, u, _ in items if d is not None and t and brute(t, u)}
    got = leaks(spark, docs, items)
    assert set(got) == want and len(want) > 40
    assert set(leaks(spark, docs, items, block_chars=300)) == want


def test_longest_run_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = [(1, "head " + " ".join(f"word{i}" for i in range(5, 25)), "x"), (1, text, "x"), (2, " ".join(f"Word{i}!" for i in range(12)), "x"), (3, " ".join(f"word{i}" for i in range(11)), "x")]
    assert leaks(spark, docs, [(7, text, "x"), (8, None, "x"), (None, text, "x"), (9, "too short", "x")]) == {(1, 7): 40, (2, 7): 12}
    assert leaks(spark, docs, []) == {} and leaks(spark, [], [(7, text, "x")]) == {}


def test_edit_budget(spark):
    text = " ".join(f"passage{i}" for i in range(14))
    changed = text.replace("passage5 ", "pasage5 ")
    docs = [(1, "before " + changed + " after", "x"), (2, text[: len(text) // 2], "x")]
    assert leaks(spark, docs, [(7, text, "x")]) == {}
    assert leaks(spark, docs, [(7, text, "x")], exact=False) == {(1, 7): 12}
    with pytest.raises(ValueError):
        leaks(spark, docs, [], edits=5)


def test_long_texts_are_searched_in_pieces():
    rng = random.Random(5)
    items = [(i, normal(" ".join(f"t{rng.randrange(50)}" for _ in range(30)))) for i in range(5)]
    index = Index(items, LeakSettings())
    text = " ".join(f"n{rng.randrange(999)}" for _ in range(2000))
    for i, t in items:
        at = rng.randrange(len(text))
        text = f"{text[:at]} {' '.join(t.split(' ')[3 : 3 + 14 + i])} {text[at:]}"
    whole = index.search([text])
    assert len(whole) == 5 and all(index.search([text], size) == whole for size in (100, 333, 1000))


def test_parts():
    assert normal("A_b, C-3\nज़") == "a b c 3 ज"
    h = gram_hashes(codes_of("abcdefgh" * 3), 5)
    assert len(h) == 20 and np.array_equal(h[:8], h[8:16]) and len(set(h[:8].tolist())) == 8
    assert len(gram_hashes(codes_of("abc"), 5)) == 0


def within(a, b, budget, reach):
    """Whether a occurs in b with at most `budget` edits, beginning at one of the first reach + 1 places: the whole table."""
    best = False
    for s in range(min(reach, len(b)) + 1):
        row = list(range(len(b) - s + 1))
        for i, ch in enumerate(a, 1):
            new = [i]
            for j, other in enumerate(b[s:], 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ch != other)))
            row = new
        best = best or min(row) <= budget
    return best


def anywhere(a, b, budget):
    """Whether a occurs in b with at most `budget` edits: the whole table, with a free beginning."""
    row = np.zeros(len(b) + 1, dtype=int)
    j = np.arange(len(b) + 1)
    codes = codes_of(b)
    for ch in codes_of(a):
        new = np.minimum(row + 1, np.concatenate([[len(a)], row[:-1] + (codes != ch)]))
        row = np.minimum.accumulate(new - j) + j
    return row.min() <= budget


def test_banded_alignment_against_the_whole_table():
    rng = random.Random(7)
    cases = []
    for _ in range(3000):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        cases.append((a, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 3))) + "".join(b) + rng.choice(["", "a", "ba "])))
    for budget in (0, 1, 2):
        for reach in (0, 2, 5):
            got = aligned([codes_of(a) for a, _ in cases], [codes_of(b) for _, b in cases], budget, reach)
            assert got.tolist() == [within(a, b, budget, reach) for a, b in cases]
    assert aligned([], [], 1, 2).tolist() == []


def test_edited_passages_against_brute_force():
    """Every passage with at most e edits is found, and nothing farther away: recall and precision are 1."""
    rng = random.Random(9)
    for edits, q in ((1, 11), (2, 7)):
        items = [(i, normal(" ".join(rng.choice(VOCABULARY) + str(rng.randrange(9)) for _ in range(rng.randint(12, 18))))) for i in range(8)]
        texts = []
        for _ in range(120):
            own = rng.choice(items)[1].split(" ")
            k = rng.randint(0, len(own) - 12)
            piece = list(" ".join(own[k : k + 12]))
            for _ in range(rng.randint(0, edits + 2)):
                at = rng.randrange(len(piece))
                piece[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
            texts.append(normal("lead in " + "".join(piece) + " and out"))
        cfg = LeakSettings(q=q, edits=edits, exact=False)
        got = set(Index(items, cfg).search(texts))
        want = set()
        for n, t in enumerate(texts):
            for i, (_, u) in enumerate(items):
                own = u.split(" ")
                if any(anywhere(" ".join(own[k : k + 12]), t, edits) for k in range(len(own) - 11)):
                    want.add((n, i))
        assert got == want and 60 < len(want) < 120

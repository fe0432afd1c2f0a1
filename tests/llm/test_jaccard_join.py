import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import jaccard_join as J


def sets_of(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, t):
    sets = [sets_of(x, n) for _, x in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and t.denominator * both >= t.numerator * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=str)


def joined(df, n, t):
    return sorted((tuple(r) for r in J.join(df, n, t).collect()), key=str)


def near(rng, base, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in base]


def corpus(seed, words, families=6, copies=14):
    rng, rows = random.Random(seed), []
    shared = words(40)
    for f in range(families):
        base = words(rng.choice([3, 6, 30, 90, 200]))
        for _ in range(copies):
            w = near(rng, base, rng.choice([0, 0.005, 0.02, 0.05, 0.1]))
            if rng.random() < 0.2:
                w = w + shared
            rows.append(" ".join(w))
    rows += [" ".join(words(rng.randint(1, 120)) + shared) for _ in range(40)]
    rows += [None, "", " \t ", "one", "ONE", "one two", "two one", "a b c", "A\x0bb\x0cc", "a b d"]
    rng.shuffle(rows)
    return [(3 * i - 40, x) for i, x in enumerate(rows)]


@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_against_all_pairs(docs, words, n, t):
    rows = corpus(n, words) + [(None, "a b c"), (10_000, "x " * 30_000)]
    assert joined(docs(rows), n, t) == brute(rows, n, t)


def test_chains_across_groups(docs, monkeypatch):
    # neighbours are linked, ends aren't: only links between many small groups make the one component
    monkeypatch.setattr(J, "GROUPS", (2, 3))
    monkeypatch.setattr(J, "QUERIES", 2)
    rows = [(i, " ".join(f"w{k}" for k in range(2 * i, 2 * i + 60))) for i in range(40)]
    assert joined(docs(rows), 3, Fraction(9, 10)) == brute(rows, 3, Fraction(9, 10))


def test_small_groups_lose_no_link(docs, words, monkeypatch):
    monkeypatch.setattr(J, "GROUPS", (2, 2))
    monkeypatch.setattr(J, "QUERIES", 1)
    rows = corpus(11, words, 4, 10)
    assert joined(docs(rows), 3, Fraction(4, 5)) == brute(rows, 3, Fraction(4, 5))


def test_more_tokens_than_bit_tables_hold_and_short_rows(docs, words, monkeypatch):
    monkeypatch.setattr(J.frequency, "MAX_KEYS", 0)
    monkeypatch.setattr(J, "ROW", 2)
    monkeypatch.setattr(J, "GROUPS", (2, 4))
    rows = corpus(12, words, 4, 12) + [(None, "a b c")]
    assert joined(docs(rows), 3, Fraction(4, 5)) == brute(rows, 3, Fraction(4, 5))


def test_the_bound_opens_no_hopeless_group():
    a = np.arange(10, dtype=np.uint64)
    g = J.Group([1, 2], [a, a + np.uint64(2)])
    t = Fraction(9, 10)
    assert g.linked(a, t) == [0] and g.linked(a + np.uint64(50), t) == [] and g.linked(a[:0], t) == []
    assert J.Group([], []).linked(a, t) == []
    assert J.needed(10, t) == 9 and J.needed(11, t) == 10


def test_equal_rows_many_copies_and_shared_ids(docs, words):
    text = " ".join(words(50))
    rows = [(i, text) for i in range(300)] + [(7, text)] * 3 + [(500, text + " tail")]
    got = joined(docs(rows), 3, Fraction(9, 10))
    assert {g[2] for g in got} == {0} and len(got) == 304


def test_empty_table_and_other_columns(docs):
    assert J.join(docs([]), 3, Fraction(9, 10)).count() == 0
    df = docs([(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y")], "doc_id long, text string, n long, token string")
    assert {r["component_id"] for r in J.join(df, 3, Fraction(9, 10)).collect()} == {1}


def test_no_pairs_are_made_of_plain_copies(spark, docs):
    df = docs([(i, "the same few words in every row of it") for i in range(500)])
    out = J.join(df, 3, Fraction(9, 10))
    assert out.agg(F.count_distinct("component_id")).first()[0] == 1 and out.count() == 500


def test_ids_that_come_with_several_texts(docs, words):
    rows = [(2, "x y z w"), (5, "x y z w"), (5, "a b c d")]
    assert [g[2] for g in joined(docs(rows), 3, Fraction(9, 10))] == [2, 2, 2]
    # all texts of an id are compared, in every order of ids
    a, b, c = (" ".join(words(60)) for _ in range(3))
    rows = [(9, a), (9, b), (9, c), (9, ""), (3, a + " tail"), (4, "tail " + b), (7, c.upper()), (8, "alone it is"), (3, "none has this"), (1, "none has that"), (1, "none has that"), (None, a), (None, b)]
    assert joined(docs(rows), 3, Fraction(9, 10)) == brute(rows, 3, Fraction(9, 10))
    for top in (2**63 - 1, 5):
        far = [(i if i != 9 else top, x) for i, x in rows]
        assert joined(docs(far), 3, Fraction(9, 10)) == brute(far, 3, Fraction(9, 10))


def test_repeated_ids_against_all_pairs(docs, words):
    rows = [(i % 50, x) for i, x in corpus(5, words, 4, 10)]
    assert joined(docs(rows), 3, Fraction(4, 5)) == brute(rows, 3, Fraction(4, 5))

import random

import pytest
import xxhash

from helixframe.llm import ranking
from helixframe.llm import suffix_dedup as D


def brute(rows, length):
    """(id, bytes, spans) with every string's first place in a table. Null ids come last, texts of one id by their hash."""
    hashed = {t: (xxhash.xxh64(t.encode(), seed=42).intdigest() if t is not None else 42) for _, t in rows}
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    of = lambda i, t: (i is None, i or 0, signed(hashed[t]))
    first, out = {}, []
    for doc_id, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            key, at = data[p : p + length], (of(doc_id, text), p)
            first[key] = min(first.get(key, at), at)
    for doc_id, text in rows:
        data, hit = (text or "").encode(), set()
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < (of(doc_id, text), p):
                hit |= set(range(p, p + length))
        spans = []
        for b in sorted(hit):
            if spans and spans[-1][1] == b:
                spans[-1][1] = b + 1
            else:
                spans.append([b, b + 1])
        out.append((doc_id, len(data), [tuple(s) for s in spans], bytes(c for k, c in enumerate(data) if k not in hit)))
    return sorted(out, key=str)


def found(df, length):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in D.dedup(df, length).collect()), key=str)


def text(rng, n, alphabet="abcdefghij klmno é"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def corpus(seed, length):
    rng, rows = random.Random(seed), []
    passages = [text(rng, length + k) for k in (-1, 0, 1, 7, length // 2, 3 * length)]
    for i in range(60):
        parts = [text(rng, rng.randint(0, 2 * length))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            parts += [p[a : len(p) - rng.randint(0, 5)], text(rng, rng.randint(0, length))]
        rows.append("".join(parts))
    near = text(rng, 6 * length)
    for _ in range(6):  # edits at close distances
        s = list(near)
        for _ in range(rng.randint(0, 8)):
            s[rng.randrange(len(s))] = "#"
        rows.append("".join(s))
    rows += ["x" * (3 * length), "xy" * (2 * length), "", None, "é" * length, text(rng, length), passages[5], passages[5], passages[5] * 3]
    rng.shuffle(rows)
    return [(7 * i - 60, r) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "length"), [(1, 16), (2, 40), (3, 100)])
def test_against_all_strings(docs, seed, length):
    rows = corpus(seed, length)
    assert found(docs(rows), length) == brute(rows, length)


def test_segments_of_long_texts(docs, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 64)
    rows = corpus(4, 32)
    assert found(docs(rows), 32) == brute(rows, 32)


def test_crowded_bit_tables_change_nothing(docs, monkeypatch):
    class Full:
        def has(self, keys):
            return keys == keys

    monkeypatch.setattr(D, "bit_table", lambda *a, **k: Full())
    rows = corpus(5, 24)
    assert found(docs(rows), 24) == brute(rows, 24)


def test_more_places_than_bit_tables_hold(docs, monkeypatch):
    monkeypatch.setattr(D.frequency, "MAX_KEYS", 0)
    rows = corpus(7, 40)
    assert found(docs(rows), 40) == brute(rows, 40)


@pytest.mark.parametrize("rows_a_part", [40, 700])
def test_classes_that_go_over_many_partitions(docs, monkeypatch, rows_a_part):
    monkeypatch.setattr(ranking, "ROWS", rows_a_part)
    rng = random.Random(8)
    one, two = text(rng, 300), text(rng, 90)
    rows = [(i, text(rng, 20) + one + two * (i % 3) + text(rng, 9)) for i in range(60)] + [(100 + i, one[:150] + str(i) + one[150:]) for i in range(40)]
    assert found(docs(rows), 48) == brute(rows, 48)


def test_rows_of_one_id_are_cut_apart(docs):
    rng = random.Random(9)
    p, other = text(rng, 239), text(rng, 400)
    rows = [(1, p), (5, p + "Q"), (5, other)]
    got = found(docs(rows), 100)
    assert got == brute(rows, 100) and bytes(other, "utf-8") in [g[3] for g in got]
    rows += [(None, other), (None, p), (5, other), (7, other + p), (None, None), (3, text(rng, 150)), (3, p[:120] + other[:200])]
    assert found(docs(rows), 100) == brute(rows, 100)


def test_ids_too_far_apart_for_one_number(docs):
    rows = [(i * (1 << 55) if i % 2 else -i, t) for i, (_, t) in enumerate(corpus(6, 24))][:60]
    assert len({i for i, _ in rows}) == 60 and found(docs(rows), 24) == brute(rows, 24)


def test_nulls_ties_and_clashing_columns(docs):
    long = "abc def ghi " * 20
    rows = [(None, long + "1"), (5, "pre " + long), (9, long), (9, long)]
    got = found(docs(rows), 100)
    assert got == brute(rows, 100)
    tie = [(9, "q" + "".join(map(chr, range(40, 120))) * 2)] * 2
    assert found(docs(tie), 100) == brute(tie, 100)  # neither row is earlier
    df = docs([(1, "t", "s", 2)], "doc_id long, text string, spans string, start long")
    assert D.dedup(df, 100).first()["kept_text"] == "t"
    assert D.dedup(docs([]), 100).count() == 0


def test_text_without_halves_of_characters(docs):
    # the repeated bytes begin within one character and end within another
    shared = "é" * 20
    rows = [(1, shared), (2, "x" + "é" * 20 + "è")]
    for r in D.dedup(docs(rows), 16).collect():
        assert "�" not in r["kept_text"] and r["kept_text"].encode() in bytes(r["kept"]) or not r["kept_text"]


def test_lengths_are_checked(docs):
    with pytest.raises(ValueError):
        D.dedup(docs([]), 5)

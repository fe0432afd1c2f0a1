import hashlib
import re

import pytest

from helixframe.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1)):
            if w:
                grams.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= own
        names = ",".join(sorted(str(x) for x in ids if x is not None))
        out.append((doc_id, len(w), len(hit), len({x for x in ids if x is not None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in D.judged(D.find_hits(d, b, **how)).collect()), key=str)


@pytest.mark.parametrize("blocks", [1, 4])
def test_against_brute_force(spark, words, blocks):
    items = [(i, " ".join(words(n))) for i, n in enumerate([3, 1, 13, 14, 30, 40, 12])] + [(20, "Ünïcode Wörter, die—zählen!"), (21, None), (22, "..."), (None, "no id here"), (10, "Ünïcode wörter die zählen")]
    docs = []
    for i in range(60):
        body = words(80)
        if i % 3 == 0:
            at, src = 10 * (i % 5), words_of(items[i % 7][1])
            body[at:at] = [w.upper() if i % 2 else w for w in src]
        docs.append((i, ("  " if i % 2 else "_-") .join(body)))
    docs += [(100, None), (101, ""), (102, "x ÜNÏCODE"), (103, "say: ünïcode; WÖRTER (DIE) zählen"), (104, "no id HERE"), (105, "the " * 20_000 + items[4][1]), (None, items[0][1]), (106, items[4][1]), (106, items[4][1])]
    size = sum(len((t or "").encode()) for _, t in items) * 13
    assert found(spark, docs, items, max_bytes=size // blocks + 1) == brute(docs, items)


def test_word_bounds_are_kept(spark):
    items = [(1, "ab cd")]
    got = found(spark, [(1, "xab cd"), (2, "ab cde"), (3, "ab, CD"), (4, "ab cd ab cd")], items)
    assert [(g[0], g[2]) for g in got] == [(1, 0), (2, 0), (3, 2), (4, 4)]


def test_offsets_are_of_the_original(spark):
    text = "Élan: The Cat--SAT! here"
    b = spark.createDataFrame([(1, "the cat sat")], "item_id long, text string")
    r = D.find_hits(spark.createDataFrame([(1, text)], "doc_id long, text string"), b).first()
    s = r["spans"][0]
    assert (s["first"], s["last"]) == (1, 3) and text.encode()[s["first_byte"] : s["last_byte"]].decode() == "The Cat--SAT"


def test_empty_tables_and_carried_columns(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a", "s", 3)], "doc_id long, text string, spans string, items long")
    r = D.judged(D.find_hits(df, none)).first()
    assert (r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) == (1, 0, D.NO_ITEMS, False)
    assert D.find_hits(df.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, text string")
    for most in (1 << 20, 14):
        assert D.find_hits(df, some, max_bytes=most, carry=("text",)).first()["text"] == "a"


def test_a_twentieth_is_the_bound(spark):
    got = found(spark, [(1, "hit " + "x " * 19), (2, "hit " + "x " * 20)], [(1, "hit")])
    assert [g[5] for g in got] == [True, False]

import math
import random
import zlib

import duckdb
import pytest

from helixframe.llm import language_id as L

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_unseen_words_fall_back_to_shorter_pieces():
    m = L.Model(["a", "b"], {"known": [9, 1]}, {"<": [5, 5], ">": [5, 5], "xy": [9, 1], "x": [1, 9], "y": [1, 9]}, 4)
    # xy is found at its place before x; the second place has y alone
    of = lambda x: m.gram_logs[m.grams[x]]
    assert m.word("xy") == pytest.approx((of("<") + of("xy") + of("y") + of(">")) / 4)
    assert m.word("q") == pytest.approx((of("<") + of(">")) / 2)
    assert m.word("known") == pytest.approx(m.word_logs[0]) and L.Model(["a"], {}, {}, 4).word("x") is None


def test_spelling():
    assert list(L.spelled("a", 2)) == ["<", "<a", "a", "a>", ">"]


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(100 + i, "der hund und die katze", "de") for i in range(20)] + [(300, None, "en"), (301, "x", None)]
    return L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def pred(docs, trained, rows):
    return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs(rows), trained).collect()}


def test_words_decide(docs, trained):
    got = pred(docs, trained, [(1, "The DOG"), (2, "die Katze, und?"), (3, None), (4, "123 --- !"), (5, ""), (6, "hundes")])
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0 and got[1][1] > 0.9


def test_ties_go_to_the_first_language(docs):
    even = L.Model(["a", "b"], {"w": [1, 1]}, {}, 4)
    assert pred(docs, even, [(1, "w"), (2, "ββββ")]) == {1: ("a", 0.5), 2: ("a", 0.5)}  # of the other word nothing is known


def test_long_texts_and_repeated_rows(docs, trained):
    df = docs([(1, "the " * 100_000), (1, "the " * 100_000), (None, "der")])
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in L.identify(df, trained).collect())
    assert got == [("1", "en"), ("1", "en"), ("None", "de")]


def test_the_table_may_be_small(docs, trained):
    rows = [(i, f"the w{i} cat") for i in range(500)]
    full = pred(docs, trained, rows)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs(rows), trained, table_limit=3).collect()} == full


def test_signs_are_no_letters(docs, trained):
    got = pred(docs, trained, [(1, "² ½ 1"), (2, "①"), (3, "the² cat½"), (4, "_ 7"), (5, "Ⅷ the"), (6, "日本")])
    assert [got[i][0] for i in (1, 2, 4)] == ["und"] * 3 and got[1][1] == 0
    assert got[3][0] == got[5][0] == "en" and got[6][0] != "und"
    assert L.words_of("the² x½y 3z Ⅷ ① é_Ö") == ["the", "x", "y", "z", "é", "ö"]


def plain(train, texts, n_max=4):
    """The whole rule with plain dictionaries: (language, score) of each text."""
    words, grams = {}, {}
    for text, lang in train:
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            words.setdefault(lang, {}).setdefault(w, 0)
            words[lang][w] += 1
            marked = f"<{w}>"
            for i in range(len(marked)):
                for n in range(1, n_max + 1):
                    if i + n <= len(marked):
                        g = marked[i : i + n]
                        grams.setdefault(lang, {}).setdefault(g, 0)
                        grams[lang][g] += 1
    langs = sorted({lang for _, lang in train})

    def logs(table):
        every = {x for lang in langs for x in table.get(lang, {})}
        total = {lang: sum(table.get(lang, {}).get(x, 0) + 0.1 for x in every) for lang in langs}
        return {x: [math.log((table.get(lang, {}).get(x, 0) + 0.1) / total[lang]) for lang in langs] for x in every}

    word_logs, gram_logs = logs(words), logs(grams)
    out = []
    for text in texts:
        own = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not own:
            out.append(("und", 0.0))
            continue
        score = [0.0] * len(langs)
        for w in own:
            if w in word_logs:
                found = [word_logs[w]]
            else:
                marked, found = f"<{w}>", []
                for i in range(len(marked)):
                    longest = [marked[i : i + n] for n in range(n_max, 0, -1) if i + n <= len(marked) and marked[i : i + n] in gram_logs]
                    found += [gram_logs[g] for g in longest[:1]]
            for k in range(len(langs)):
                score[k] += sum(f[k] for f in found) / len(found) if found else 0.0
        best = max(range(len(langs)), key=lambda k: (score[k], -k))
        out.append((langs[best], 1 / sum(math.exp(s - score[best]) for s in score)))
    return out


def test_against_plain_dictionaries(spark, docs):
    rng = random.Random(3)
    pools = {x: ["".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(40)] for x, a in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "aegé日"))}
    make = lambda lang, n: " ".join(rng.choice(pools[lang]) + rng.choice(["", "", "", "²", ",", "½x", "1"]) for _ in range(n))
    train = [(make(lang, rng.randint(0, 12)), lang) for lang in pools for _ in range(25)]
    model = L.train(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string"))
    texts = [make(rng.choice(list(pools)), rng.randint(0, 4)) + rng.choice(["", " zzz", " abz gfe", " ①"]) for _ in range(300)] + [None, "", "² ½ 1", "Q", "ÉÉ a"]
    got = pred(docs, model, list(enumerate(texts)))
    for i, (lang, score) in enumerate(plain(train, texts)):
        assert got[i][1] == pytest.approx(score, abs=2e-6)
        assert got[i][0] == lang or score < 0.51
    every = {lang for lang, _ in got.values()}
    assert every == {"aa", "bb", "cc", "und"}


def test_words_seen_once_count_unless_a_minimum_is_given(spark):
    rows = spark.createDataFrame([(1, "once twice twice", "a"), (2, "other", "b")], "doc_id long, text string, lang string")
    assert set(L.train(rows).words) == {"once", "twice", "other"}
    assert set(L.train(rows, min_count=2).words) == {"twice"}


def test_no_training_rows_and_empty_table(spark, docs):
    none = L.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert L.identify(docs([(1, "text")]), none).first()["lang_pred"] == "und"
    assert L.identify(docs([]), none).count() == 0


def test_carried_columns_may_clash(docs, trained):
    df = docs([(1, "the", "x", 0.5)], "doc_id long, text string, lang string, extra double")
    r = L.identify(df, trained, carry=("text", "lang", "extra")).first()
    assert (r["text"], r["lang"], r["extra"], r["lang_pred"]) == ("the", "x", 0.5, "en")


def test_held_out_accuracy_and_what_is_learned_from(spark):
    got = {r["doc_id"]: r for r in L.op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}' WHERE lang IS NOT NULL").fetchall()
    held = [(i, lang) for i, lang in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, _ in truth if got[i]["held_out"]} == {i for i, _ in held}
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97

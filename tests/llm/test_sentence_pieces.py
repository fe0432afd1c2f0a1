import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from helixframe.llm import sentence_pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "a", " a", "a ", "  a  b ", " ", "  ", "a\n b", "▁", "▁a b", "a▁▁b ▁", "\n\n a\t b's", "é  ü \xa0b  c", "1 2  3", " \n", "a\0b", "<s> x </s>", "<0x0A> 日本語 テスト", "\U0001f600 x  \U0001f600",
    "word " * 5000, "a" * 3000, "ﬁ ½ Ａ", "​ 　 x", None,
]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("limit", [0, 1000])
def test_ids_are_the_library_s(sp, limit):
    texts = [x or "" for x in ODD]
    chunks = P.ChunkTable(MODEL, limit)
    for _ in range(2):
        assert [x.tolist() for x in chunks.encode(texts)] == [sp.encode(x, add_bos=True, add_eos=True) for x in texts]


def test_the_property_is_checked():
    assert P.words_stand_alone(["▁▁", "▁a", "a"]) and not P.words_stand_alone(["a▁b"])
    assert P.ChunkTable(MODEL, 1).alone


def test_a_model_without_it_takes_whole_texts(sp):
    chunks = P.ChunkTable(MODEL, 10)
    chunks.alone = False
    assert [x.tolist() for x in chunks.encode(["a b  c"])] == [sp.encode("a b  c", add_bos=True, add_eos=True)]


def test_query_against_the_library(spark, docs, sp, words):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(words(int(i)))) for i in range(50)] + [(None, "x y"), (3, " a"), (3, " a")]
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.digests(P.transcode(docs(rows), MODEL)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_decoded_text_and_other_columns(spark, docs):
    df = docs([(1, "Hello world", "x")], "doc_id long, text string, decoded string")
    r = P.transcode(df, MODEL).first()
    assert r["decoded"] == "Hello world" and np.frombuffer(r["ids"], "<u4")[0] == 1
    assert P.transcode(docs([]), MODEL).count() == 0

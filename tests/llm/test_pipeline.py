"""The pipeline against a version that looks at everything."""

import hashlib
import random
from fractions import Fraction
from pathlib import Path

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import sentencepiece
from test_decontaminate import brute as brute_hits
from test_jaccard_join import brute as brute_groups
from test_suffix_dedup import brute as brute_spans


def corpus(words):
    rng = random.Random(4)
    passage, items = " ".join(words(60)), [(1, " ".join(words(20))), (2, "one short item")]
    rows = []
    for i in range(60):
        body = words(rng.randint(30, 120))
        if i % 7 == 0:
            body += passage.split(" ")
        if i % 11 == 0:
            body += items[0][1].split(" ")
        rows.append((i, " ".join(body), ["en", "de", None][i % 3]))
    base = rows[5][1].split(" ")
    rows += [(100 + k, " ".join(w if rng.random() > 0.01 else "zzz" for w in base), "en") for k in range(6)] + [(200, rows[8][1], "en"), (201, None, "en"), (202, "123 !!", None), (203, "", "de"), (204, passage, "de"), (5, rows[5][1], "en")]
    return rows, items


def test_run_against_brute_force(spark, words, tmp_path):
    rows, items = corpus(words)
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    keep = {i for i, _, c in brute_groups(want, 5, Fraction(4, 5)) if i == c}
    want = [(i, t) for i, t in {i: t for i, t in want if i in keep}.items()]
    want = [(i, bytes(kept).decode()) for i, _, spans, kept in brute_spans(want, 100) if kept]
    bad = {r[0] for r in brute_hits(want, items) if r[-1]}
    want = [(i, t) for i, t in want if i not in bad]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {i: sp.encode(t, add_bos=True, add_eos=True) for i, t in want}

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in P.run(spark, f"file://{tmp_path}").collect()}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items()}
    assert 40 < len(got) < len(rows) - 8


def test_stages_keep_the_columns_of_documents(spark, words, tmp_path):
    rows, items = corpus(words)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "more") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(c, k) for c, k in docs.dtypes if c != "extra"]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.dtypes == want
        assert out.where("n_chars != length(text)").count() == 0
        empty = stage(spark, docs.limit(0), f"file://{tmp_path}")
        assert empty.count() == 0
    assert len(P.STAGES) == 5 and P.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_no_import_error_is_swallowed():
    for path in [Path(P.__file__), *Path(P.__file__).parent.glob("helixframe/llm/*.py")]:
        assert "ImportError" not in path.read_text() and "ModuleNotFound" not in path.read_text()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_rows_without_an_id_stay(spark, words):
    texts = [" ".join(words(60)) for _ in range(12)]
    rows = [(None if i % 3 == 0 else i, x, "en") for i, x in enumerate(texts)] + [(None, texts[1], "en"), (None, texts[3], "en")]
    want = sorted(texts)
    kept = P.near_duplicates(spark, frame(spark, rows), "")
    got = kept.collect()
    # copies go whether they have an id or not, an id before none
    assert sorted(r["text"] for r in got) == want and {r["doc_id"] for r in got if r["text"] == texts[1]} == {1}


def test_no_text_is_cut_by_the_runs_of_another_without_an_id(spark, words):
    passage, own = " ".join(words(80)), [" ".join(words(120)) for _ in range(4)]
    rows = [(1, passage, "a"), (None, passage + " " + own[0], "b"), (None, own[1], "c"), (None, own[2], "d"), (None, own[3], "e")]
    got = {r["lang"]: r["text"] for r in P.repeated_passages(spark, frame(spark, rows), "").collect()}
    assert got["a"] == passage and own[0] in got["b"] and len(got["b"]) < len(own[0]) + 10
    assert [got[x] for x in "cde"] == own[1:]


def test_texts_that_share_an_id_are_kept_apart(spark, words):
    x, y, z = (" ".join(words(60)) for _ in range(3))
    got = P.near_duplicates(spark, frame(spark, [(5, x, "en"), (5, y, "en"), (2, x, "en"), (5, z, "en"), (5, z, "en"), (7, y, "en")]), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(2, x), (5, y), (5, z)])


def test_repeated_passages_gives_a_row_for_a_row(spark, words):
    rows = [(1, " ".join(words(50)), "en"), (1, " ".join(words(50)), "de"), (1, " ".join(words(50)), "fr"), (2, "short", "en")]
    got = P.repeated_passages(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in got) == sorted(rows)


def test_scratch_tables_are_written_by_python_workers(spark, words, tmp_path, monkeypatch):
    """A file that an executor's JVM writes starts processes that count as that JVM once more. Only results of grouped Python functions,
    whose tasks have a worker already, are written that way."""
    from pyspark.sql import DataFrameWriter

    from helixframe import scratch

    rows, _ = corpus(words)
    made = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows] + [(None, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    writers, names = [], []
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: writers.append(path) or parquet(self, path, *a, **b))
    folder = scratch.new_folder
    monkeypatch.setattr(scratch, "new_folder", lambda s, name: names.append(name) or folder(s, name))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for stage, most in ((P.near_duplicates, 3), (P.repeated_passages, 1)):
        writers.clear(), names.clear()
        stage(spark, docs, f"file://{tmp_path}").count()
        assert len(writers) <= most and len(names) > 8
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_slim_scratch_tables_hold_what_they_are_given(spark):
    from helixframe import scratch

    kinds = "a long, b struct<x: int, y: struct<z: boolean>>, c array<struct<s: string, t: binary>>, d string, e double"
    given = [(i, (i, (i % 2 == 0,)) if i % 3 else None, [(str(i), b"\0\xff")] * (i % 4) if i % 5 else None, "\u00e9" * i, i / 3) for i in range(50)] + [(None,) * 5]
    df = spark.createDataFrame(given, kinds).repartition(3)
    some, none = scratch.stash_slim(df, "slim"), scratch.stash_slim(df.where("a < 0"), "slim")
    assert some.dtypes == none.dtypes == df.dtypes and none.count() == 0
    by = lambda r: str(r)
    assert sorted(some.collect(), key=by) == sorted(df.collect(), key=by)
    scratch.drop(some)

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe import config
from helixframe.functions import exact
from helixframe.functions import sequences as S


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_accession_is_the_first_match_anywhere(spark):
    get = lambda h: one(spark, S.accession(F.col("h")), h=h)
    assert get("AB12.1 something") == "AB12.1"
    assert get("NC_012920.1 then ABC123") == "ABC123"  # an underscore breaks the first one
    assert get("no id") is None
    assert one(spark, S.record_id(F.col("h")), h="word and more") == "word"
    assert one(spark, S.record_id(F.col("h")), h="  ") is None


def test_first_token_keeps_to_spaces(spark):
    assert one(spark, S.first_token(F.col("h")), h=" b c") == ""
    assert one(spark, S.first_token(F.col("h")), h="a\tb c") == "a\tb"


def test_clean_and_normalise(spark):
    c = S.clean(F.col("s"))
    assert one(spark, c, s="ac-g t1RyN") == "ACGTNNN"
    auto = S.normalise(c, S.alphabet(c))
    assert one(spark, auto, s="acgu") == "ACGU"
    assert one(spark, auto, s="acgtu") == "ACGTT"
    assert one(spark, auto, s="é中x") == "NNN"
    assert one(spark, S.normalise(c, F.lit("RNA")), s="ACGT") == "ACGU"


def test_the_two_definitions_of_gc_and_n(spark):
    s, n = F.length("s"), S.count_of(F.col("s"), "N")
    assert one(spark, S.gc_percent(F.col("s"), s, n), s="GCNN") == 100.0
    assert one(spark, S.consensus_gc_percent(F.col("s")), s="GCNN") == 50.0
    assert one(spark, S.gc_percent(F.col("s"), s, n), s="NN") == 0.0
    assert one(spark, S.n_frac(s, n), s="") == 1.0
    assert one(spark, S.consensus_n_frac(F.col("s")), s="") == 0.0


def test_header_organism(spark):
    get = lambda h: one(spark, S.header_organism(F.col("h")), h=h)
    assert get("X1 Homo sapiens Voucher 12") == "Homo sapiens"
    assert get("X1") == "UNKNOWN"
    assert get("X1  ") == "UNKNOWN"
    assert get("X1 voucher 3") == "voucher 3"  # the word needs a space before it


def test_kmers_guard_short_sequences(spark):
    assert one(spark, S.kmers(F.col("s"), 3), s="ACNGT") == []
    assert one(spark, S.kmers(F.col("s"), 3, ignore_n=False), s="ACNG") == ["ACN", "CNG"]
    assert one(spark, S.kmers(F.col("s"), 3), s="AC") == []
    assert one(spark, S.kmers(F.col("s"), 2), s="AAAA") == ["AA"] * 3


def test_canonical_is_the_same_for_both_strands(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACGT") for _ in range(9)),) for _ in range(200)]
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    rows = [(k, "".join(pair[c] for c in reversed(k))) for (k,) in rows]
    got = spark.createDataFrame(rows, "k string, r string").select("k", "r", S.canonical_form(F.col("k")).alias("a"), S.canonical_form(F.col("r")).alias("b")).collect()
    assert all(x["a"] == x["b"] == min(x["k"], x["r"]) for x in got)


def test_alphabets_and_k_are_checked():
    assert config.check_alphabet("dna") == "DNA" and not config.canonical_applies(True, "RNA")
    for bad in (lambda: config.check_alphabet("X"), lambda: config.check_k(0)):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("accepted")


def test_exact_rounding_differs_from_decimal_rounding(spark):
    values = [0.125, 2.675, 1.005, 0.5, 1e-7, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", exact.fixed(F.col("v"), 2).alias("t"), exact.rounded(F.col("v"), 2).alias("r")).orderBy("i").collect()
    assert [g["t"] for g in got] == [None if v is None else f"{v:.2f}" for v in values]
    assert [g["r"] for g in got] == [None if v is None else round(v, 2) for v in values]


def test_keys_and_names(spark):
    import hashlib

    assert one(spark, S.digest(F.col("s")), s="é") == hashlib.sha256("é".encode()).hexdigest()
    assert one(spark, S.alignment_key(F.col("s"), "blastn", "nt", "JSON2", 10), s="AC") == hashlib.sha256(b"blastn|nt|JSON2|10|AC").hexdigest()
    assert one(spark, S.query_id(F.col("h"), F.lit(3)), h="") == "query_0003"
    assert one(spark, S.query_id(F.col("h"), F.lit(3)), h="a b") == "a"
    assert one(spark, S.safe_name(F.col("s"), 4), s="a/b c") == "a_b_"
    assert one(spark, S.safe_name(F.col("s")), s="") == "query"
    assert exact.mask_secret("abcdef") == "abcd…" and exact.mask_secret(None) is None


@settings(max_examples=50, deadline=None)
@given(st.floats(0, 100), st.integers(0, 5))
def test_fixed_is_what_python_prints(v, d):
    assert float(f"{v:.{d}f}") == round(v, d)


def test_bytes_are_encoded_as_patterns_would(spark, tmp_path):
    """Documents become bases by a table of bytes, and plain sequences pass without patterns; both were patterns in the JVM."""
    from pyspark.sql import functions as F

    from helixframe.functions import sequences as S
    from helixframe.plans import encoding as E

    texts = [None, "", "AbZz 12\n", "éÀÖ×Øö÷øÿß", "".join(map(chr, range(1, 0x250))), "\U0001f600aŸİK", "ACGTN\n", "acgu-RY", "ACGTUN"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = docs.select("doc_id", F.translate(F.regexp_replace(F.regexp_replace("text", E.KEPT, ""), "[^A-Za-z]", "*"), E.LETTERS, E.BASES))
    assert sorted(map(tuple, E.fasta(spark, str(tmp_path)).select("idx", "sequence").collect())) == sorted(map(tuple, want.collect()))
    pattern = F.regexp_replace(F.regexp_replace(F.upper("text"), r"\P{L}", ""), f"[{S.AMBIGUOUS}]", "N")
    assert docs.select(S.clean(F.col("text")).eqNullSafe(pattern).alias("same")).where("not same").count() == 0

import random

import pytest

from helixframe.operators import filter as Q
from helixframe.sources import metadata


def records(spark, rows):
    """(idx, sequence, organism)"""
    return spark.createDataFrame([(i, f"R{i}", f"R{i}", None, o, s) for i, s, o in rows], "idx long, header string, record_id string, accession string, organism string, sequence string")


def greedy(rows, cap, dedupe=True):
    seen, n, out = {}, {}, {}
    for i, s, o in sorted(rows):
        if dedupe and s in seen:
            out[i] = ("duplicate", f"R{seen[s]}")
        elif cap > 0 and n.get(o, 0) >= cap:
            out[i] = ("max_per_organism", "")
        else:
            out[i] = ("ok", "")
            seen[s] = i
            n[o] = n.get(o, 0) + 1
    return out


def judged(spark, rows, **how):
    return {r["idx"]: (r["reason"], r["duplicate_of"]) for r in Q.annotate(records(spark, rows), min_len=1, **how).collect()}


def test_cascade(spark):
    rows = [(0, "--", "o"), (1, "AC", "o"), (2, "ACGTNNNN", "o"), (3, "ACGTACGT", "o"), (4, None, "o")]
    got = {r["idx"]: r["reason"] for r in Q.annotate(records(spark, rows), min_len=4, max_n_frac=0.25).collect()}
    assert got == {0: "empty_after_clean", 1: "too_short", 2: "too_many_N", 3: "ok", 4: "empty_after_clean"}


def test_a_share_of_exactly_the_limit_stays(spark):
    got = Q.annotate(records(spark, [(0, "ACGN", "o")]), min_len=1, max_n_frac=0.25).first()
    assert got["kept"] and got["n_frac"] == 0.25


def test_a_capped_first_copy_lets_a_later_one_through(spark):
    rows = [(1, "AAAA", "o1"), (2, "CCCC", "o1"), (3, "CCCC", "o2")]
    assert judged(spark, rows, dedupe=True, max_per_organism=1) == {1: ("ok", ""), 2: ("max_per_organism", ""), 3: ("ok", "")}


@pytest.mark.parametrize("seed", range(4))
def test_dedupe_and_cap_against_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "ACGT" * 2 + rng.choice("ACGT") * rng.randint(1, 4), f"o{rng.randint(0, 5)}") for i in range(120)]
    for cap, dedupe in ((0, True), (2, True), (3, False), (5, True)):
        assert judged(spark, rows, dedupe=dedupe, max_per_organism=cap) == greedy(rows, cap, dedupe), (cap, dedupe)


def test_organism_from_lookup_then_header(spark):
    fasta = spark.createDataFrame([(0, "AB1 Homo", "A"), (1, "word Mus voucher 1", "C"), (2, "x", "G")], "idx long, header string, sequence string")
    lookup = spark.createDataFrame([("AB1", "Known"), ("x", "Named")], "key string, organism string")
    assert [r["organism"] for r in Q.records_of(fasta, lookup).orderBy("idx").collect()] == ["Known", "Mus", "Named"]
    assert [r["organism"] for r in Q.records_of(fasta).orderBy("idx").collect()] == ["Homo", "Mus", "UNKNOWN"]


def test_metadata_lookups(spark, tmp_path):
    lines = ['{"uid": 7, "accession": "A1", "organism": "first"}', "", '{"uid": "7", "accession": "B1", "taxname": "second", "extra": [1]}', '{"uid": "9", "accession": "", "accessionversion": "C1.1", "organism": "third"}', '{"uid": "10"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    m = metadata.read_metadata(spark, f"file://{tmp_path}/m.jsonl")
    assert {r["key"]: r["organism"] for r in metadata.organism_lookup(m).collect()} == {"A1": "first", "7": "second", "B1": "second", "C1.1": "third", "9": "third"}
    assert {r["key"]: r["organism"] for r in metadata.cluster_lookup(m).collect()} == {"A1": "first", "B1": "second", "9": "third", "10": None}
    kept = spark.createDataFrame([("C1.1", "C1.1"), (None, "7")], "accession string, record_id string")
    left = Q.filter_metadata(m, kept)
    assert sorted(r["raw"] for r in left.collect()) == sorted([lines[0], lines[2], lines[3]])
    assert "NestedLoop" not in left._jdf.queryExecution().toString()


def test_counts(spark):
    rows = records(spark, [(0, "ACGT", "a"), (1, "A", "b"), (2, "C", "b")])
    assert {r["reason"]: r["n"] for r in Q.reason_counts(Q.annotate(rows, min_len=2)).collect()} == {"ok": 1, "too_short": 2}
    assert [tuple(r) for r in Q.organism_counts(rows, 1).collect()] == [("b", 2)]


def test_empty_input(spark):
    assert Q.annotate(records(spark, []), dedupe=True, max_per_organism=1).count() == 0


def test_sequences_are_cleaned_once(spark):
    """A condition on what is measured was moved before the cleaning, which it then repeated for each use."""
    rows = spark.createDataFrame([(0, "ac-gtn r", "x")], "idx long, sequence string, organism string")
    plan = Q.quality(Q.measured(rows, "DNA")).where("reason is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^ACGTN]") == 1 and plan.count("upper(") == 1

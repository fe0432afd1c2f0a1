import json
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import consensus as N
from helixframe.operators import export as X
from helixframe.operators import hits as H
from helixframe.sources import metadata


def slow_merge(a, b, least, share):
    """The rule, position by position."""

    def onto(a, b):
        for n in range(min(len(a), len(b)), least - 1, -1):
            pairs = list(zip(a[len(a) - n :], b[:n]))
            known = [(x, y) for x, y in pairs if "N" not in (x, y)]
            if known and sum(x == y for x, y in known) / len(known) >= share:
                mid = "".join(x if x == y else y if x == "N" else x if y == "N" else "N" for x, y in pairs)
                return a[: len(a) - n] + mid + b[n:]
        return None

    return onto(a, b) or onto(b, a)


def test_merge_against_the_plain_rule():
    rng = random.Random(1)
    for _ in range(300):
        whole = "".join(rng.choice("ACGT") for _ in range(40))
        a, b = list(whole[: rng.randint(10, 30)]), list(whole[rng.randint(0, 25) :])
        for s in (a, b):
            for _ in range(rng.randint(0, 3)):
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
        a, b = "".join(a), "".join(b)
        for x, y in ((a, b), (b, a)):
            assert N.merge(x, y, 5, 0.8) == slow_merge(x, y, 5, 0.8)


def test_long_sequences_are_not_tried_an_overlap_at_a_time(monkeypatch):
    rng = random.Random(2)
    whole = "".join(rng.choice("ACGT") for _ in range(40_000))
    a, b = whole[:30_000], whole[25_000:]
    calls = []
    real = N.resolved
    monkeypatch.setattr(N, "resolved", lambda *x: calls.append(1) or real(*x))
    monkeypatch.setattr(N, "overlap_identity", lambda *x: calls.append(1) or 0.0)
    assert N.merge(a, b, 80, 0.97) == whole and N.merge(b, a, 80, 0.97) == whole and len(calls) == 2
    # copies of what was tried are not tried again
    tried = []
    real_merge = N.merge
    monkeypatch.setattr(N, "merge", lambda *x: tried.append(x[1]) or real_merge(*x))
    assert N.fold([a, "C" * 300, b] + ["C" * 300] * 50, "kmer", 80, 0.97, 0.05) == (whole, "ok", "") and len(tried) == 2


def test_merge_cases():
    assert N.merge("AAACCC", "CCCGGG", 3, 1.0) == "AAACCCGGG"
    assert N.merge("CCCGGG", "AAACCC", 3, 1.0) == "AAACCCGGG"  # the other way round
    assert N.merge("AANCCC", "ACCCG", 4, 1.0) == "AAACCCG"  # a known base beats N
    assert N.merge("AAAA", "CCCC", 2, 0.9) is None
    assert N.merge("NNNN", "NNNN", 2, 0.5) is None  # nothing to compare
    with pytest.raises(ValueError):
        N.merge("A", "A", 0, 1.0)


def test_fold_states():
    assert N.fold(["AAACCC", "CCCGGG"], "kmer", 3, 1.0, 0.05) == ("AAACCCGGG", "ok", "")
    assert N.fold(["AAAA", "CCCCC"], "kmer", 3, 1.0, 0.05) == ("CCCCC", "failed", "insufficient_overlap")
    assert N.fold(["AC", "ACG"], "simple", 3, 1.0, 0.05) == ("ACG", "ok", "representative_longest")
    assert N.fold(["ANN"], "kmer", 3, 1.0, 0.05) == ("ANN", "low_quality", "high_N_fraction")


def clusters(spark):
    rows = [("C0001", 3, [("a", None), ("b", None), ("gone", None)], "org"), ("C0002", 1, [("a", None)], None), ("C0003", 2, [("gone", None), ("lost", None)], None), ("C0004", 2, [("c", None), ("d", None)], "")]
    return spark.createDataFrame([(c, s, [{"record_id": r, "accession": r, "length": 1, "organism": o, "taxid": None} for r, o in m], org) for c, s, m, org in rows], f"cluster_id string, size long, members array<{metadata.MEMBER}>, dominant_organism string")


@pytest.mark.parametrize("method", ["kmer", "simple"])
def test_build(spark, method):
    seqs = spark.createDataFrame([(0, "a", "OLD"), (1, "a", "AAACCC"), (2, "b", "CCCGGG"), (3, "c", "AAAA"), (4, "d", "")], "idx long, record_id string, sequence string")
    lookup = spark.createDataFrame([("c", "Cee")], "key string, organism string")
    built = N.build(clusters(spark), seqs, method, 2, 3, 1.0, 0.05, lookup)
    got = {r["cluster_id"]: (r["sequence"], r["status"], r["note"], r["organism"], r["length"]) for r in built.collect()}
    note = {"kmer": ("AAACCCGGG", "ok", "", "org", 9), "simple": ("AAACCC", "ok", "representative_longest", "org", 6)}[method]
    assert got == {"C0001": note, "C0003": (None, "failed", "no_sequences", "UNKNOWN", 0), "C0004": ("AAAA", "ok", "" if method == "kmer" else "representative_longest", "Cee", 4)}
    assert tuple(N.counters(clusters(spark), built).first()) == (4, 3, 2, 1)


def report(hits, **search):
    return json.dumps({"BlastOutput2": [{"report": {"results": {"search": {"hits": hits, **search}}}}]})


FIRST = [
    {"description": [{"accession": "ABC123", "title": "Example hit [Test organism]"}], "len": 250, "hsps": [{"align_len": 250, "identity": 240, "bit_score": 310.5, "evalue": 5e-20}]},
    {"description": [{"accession": "XYZ789", "title": "Second hit"}], "len": 220, "hsps": [{"alignLen": 200, "identity": 180, "bit_score": 250, "evalue": 1e-5}]},
]


def reports(spark, *raw, length=500):
    return spark.createDataFrame([(f"q{i}", length, r) for i, r in enumerate(raw)], "query_id string, query_len long, raw string")


def test_first_dialect(spark):
    got = H.report_hits(reports(spark, report(FIRST)), 2).orderBy("rank").collect()
    assert len(got) == 2
    a, b = got
    assert (a["accession"], a["organism"], a["length"], a["bitscore"], a["pident"], a["coverage"]) == ("ABC123", "Test organism", 250, 310.5, 96.0, 0.5)
    assert (b["accession"], b["organism"], b["pident"], b["coverage"], b["evalue"]) == ("XYZ789", "", 90.0, 0.4, 1e-5)


def test_hits_are_limited_to_one_at_least(spark):
    for n in (1, 0, -5):
        assert [r["accession"] for r in H.report_hits(reports(spark, report(FIRST)), n).collect()] == ["ABC123"]


def test_first_dialect_fills_and_skips(spark):
    odd = [{"description": None, "hsps": [{"align-len": "12", "num_identical": 6}]}, {"hsps": []}, {"description": [{"id": "gi|1", "taxid": 9}], "hsps": [{"align_len": 0}]}]
    two = json.dumps({"BlastOutput2": [json.loads(report(odd))["BlastOutput2"][0], json.loads(report(FIRST))["BlastOutput2"][0]]})
    got = H.report_hits(reports(spark, two, "  ", "{}"), 10).orderBy("query_id", "rank").collect()
    assert [(r["accession"], r["title"], r["organism"], r["pident"], r["length"]) for r in got][:2] == [("", "", "", 50.0, 12), ("gi|1", "gi|1", "9", 0.0, 0)]
    assert len(got) == 4  # hits of all reports, none without alignments
    with pytest.raises(Exception, match="(?i)json|variant"):
        H.report_hits(reports(spark, "no json")).collect()


def test_second_dialect(spark):
    hit = {"description": [{"title": "Example virus", "organism": "Virus example", "taxid": 1234, "accession": "ABC123"}], "accession": "ABC123", "hsps": [{"identity": 90, "align_len": 100, "evalue": 1e-10, "bit_score": 50.0, "query_from": 1, "query_to": 90}]}
    got = H.search_hits(reports(spark, report([hit, {"description": [{"taxname": "t"}]}], query_len=100)), 5).orderBy("rank").collect()
    assert (got[0]["accession"], got[0]["organism"], got[0]["pident"], got[0]["qcov"]) == ("ABC123", "Virus example", 90.0, 90.0)
    assert got[1]["organism"] == "t" and got[1]["pident"] is None and got[1]["qcov"] is None  # stays, with nulls


def test_second_dialect_errors(spark):
    df = reports(spark, "{}", "no", report([]))
    assert {r["query_id"]: r["error"] for r in H.unreadable(df).collect()} == {"q0": "Unexpected JSON2 schema", "q1": "Invalid JSON2 payload"}
    assert H.search_hits(df).count() == 0
    with pytest.raises(H.ReportError):
        H.parse_strictly(reports(spark, "{}"))


def test_best_hits_and_counts(spark):
    df = reports(spark, report(FIRST), report([]))
    assert [(r["query_id"], r["accession"]) for r in H.best_hits(df, H.report_hits(df)).orderBy("query_id").collect()] == [("q0", "ABC123"), ("q1", None)]
    done = spark.createDataFrame([("a", None), ("b", "late")], "query_id string, error string")
    assert tuple(H.outcome_counts(done).first()) == (2, 1, 1)


def test_join_picks_the_first_key_pair(spark):
    f = spark.createDataFrame([("r1", 1), ("r2", 2), (None, 3)], "record_id string, value long")
    m = spark.createDataFrame([("r1", "A", 10), ("r1", "B", 11), (None, "Z", 12)], "accession string, taxon string, value long")
    out, keys = X.with_metadata(f, m)
    assert keys == ("record_id", "accession")
    # one feature row for each match, nulls match nulls, a taken name gets a suffix
    assert sorted((r["record_id"] or "", r["value"], r["taxon"] or "", r["value_meta"] or 0) for r in out.collect()) == [("", 3, "Z", 12), ("r1", 1, "A", 10), ("r1", 1, "B", 11), ("r2", 2, "", 0)]
    same, keys = X.with_metadata(f, m.withColumnRenamed("accession", "record_id"))
    assert keys == ("record_id", "record_id") and same.columns.count("record_id") == 1
    none, keys = X.with_metadata(f, m.drop("accession"))
    assert keys is None and none.columns == f.columns


def test_feature_tables_infer_types(spark, tmp_path):
    (tmp_path / "f.csv").write_text('record_id,n,x,note,gap\nr1,1,0.5,"a,b",1\nr2,2,NA,None,\n')
    df = metadata.read_features(spark, f"file://{tmp_path}/f.csv")
    assert dict(df.dtypes) == {"record_id": "string", "n": "bigint", "x": "double", "note": "string", "gap": "double"}
    assert [tuple(r) for r in df.orderBy("record_id").collect()] == [("r1", 1, 0.5, "a,b", 1.0), ("r2", 2, None, None, None)]
    assert df.select(F.count("note")).first()[0] == 1

import csv
import json

import pytest

from helixframe import cli, config
from helixframe.plans import stages
from helixframe.sources import env, remote

FASTA = ">AB1.1 Homo sapiens\n" + "ACGTTGCA" * 30 + "\n>AB2.1 Homo sapiens\n" + "ACGTTGCA" * 30 + "\n>AB3.1 Mus\nACGN\n"


class Recorded:
    """A transport that answers from a list and notes what was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, method, url, parameters, timeout):
        self.asked.append((method, url.rsplit("/", 1)[1], parameters))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def search(ids, count):
    return json.dumps({"esearchresult": {"count": str(count), "idlist": ids}})


def entrez(t, tmp_path=None, **how):
    return remote.Entrez(config.Fetch(sleep=0, batch_size=2, page_size=2, **how), "me@example.org", None, tmp_path, t, sleep=lambda s: None)


def test_search_pages_until_enough_or_all():
    t = Recorded(search(["1", "2"], 9), search(["3", "4"], 9))
    assert entrez(t).search("q", 3) == (["1", "2", "3"], 9)
    assert [a[2]["retmax"] for a in t.asked] == [2, 1] and t.asked[1][2]["retstart"] == 2
    assert entrez(Recorded(search(["1"], 1))).search("q", 10) == (["1"], 1)
    assert entrez(Recorded(search([], 5))).search("q", 10) == ([], 5)


def test_retries_then_fails():
    t = Recorded(remote.RemoteError("a"), remote.RemoteError("b"), search(["1"], 1))
    assert entrez(t).search("q", 1)[0] == ["1"]
    with pytest.raises(remote.RemoteError):
        entrez(Recorded(*[remote.RemoteError("x")] * 3)).search("q", 1)


def test_answers_are_kept_by_request(tmp_path):
    t = Recorded(">a\nAC", ">b\nGT\n")
    assert list(entrez(t, tmp_path).sequences(["1", "2", "3"])) == [">a\nAC\n", ">b\nGT\n"]
    assert list(entrez(Recorded(), tmp_path).sequences(["1", "2", "3"])) == [">a\nAC\n", ">b\nGT\n"]
    assert [a[2]["id"] for a in t.asked] == ["1,2", "3"] and len(list((tmp_path / "efetch").iterdir())) == 2


def test_summaries_coalesce_and_survive_failures(spark):
    ok = json.dumps({"result": {"1": {"accession": "A", "accessionversion": "A.1", "taxname": "T", "length": 5, "taxid": 7}}})
    t = Recorded(ok, *[remote.RemoteError("down")] * 3)
    rows = list(entrez(t).summaries(["1", "2", "3"], "q"))
    assert rows[0] == {"uid": "1", "accession": "A.1", "title": None, "organism": "T", "slen": 5, "taxid": 7, "source_db": "nuccore", "query": "q"}
    assert rows[1]["accession"] is None and rows[2] == {**rows[1], "uid": "3"}
    assert entrez(Recorded(ok)).metadata(spark, ["1"], "q").first()["slen"] == 5


def test_search_info_lines():
    assert remote.search_info("a = 1\nnone\nb=x=y\na=2") == {"a": "2", "b": "x=y"}


def test_first_dialect_jobs():
    t = Recorded("RID = A1\nRTOE = 12\nRID = A2", "Status=READY", "nothing", "Status=odd", "STATUS=FAILED")
    jobs = remote.AlignmentJobs("e", "t", "k", t)
    assert jobs.submit("AC", "blastn", "nt", hitlist_size=3) == ("A2", 12)  # the last line counts
    assert t.asked[0][2]["HITLIST_SIZE"] == 3 and t.asked[0][2]["API_KEY"] == "k"
    assert [jobs.state("A2") for _ in range(4)] == ["READY", "WAITING", "WAITING", "FAILED"]
    with pytest.raises(remote.RemoteError):
        remote.AlignmentJobs("e", "t", transport=Recorded("no id")).submit("A", "p", "d")
    with pytest.raises(remote.RemoteError):
        remote.AlignmentJobs(None, "t")


def test_second_dialect_jobs():
    now = [0.0]
    sleep = lambda s: now.__setitem__(0, now[0] + s)
    t = Recorded("RID = A1\nRID = A2", "Status=WAITING", "Status=WAITING", "Status=READY\nMessage=fine", "no state")
    jobs = remote.ThrottledJobs("e", "t", None, 2.0, t, clock=lambda: now[0], sleep=sleep)
    assert jobs.submit("AC", "blastn", "nt") == "A1"  # the first line counts
    assert jobs.poll("A1", 1, 100).name == "READY" and now[0] >= 6
    with pytest.raises(remote.RemoteError):
        jobs.state("A1")
    late = remote.ThrottledJobs("e", "t", None, 0, Recorded(*["Status=WAITING"] * 50), clock=lambda: now[0], sleep=sleep)
    assert late.poll("x", 5, 20).name == "TIMEOUT"


def test_rate_limiter_does_not_delay_the_first_call():
    now, slept = [0.0], []
    r = remote.RateLimiter(1.0, lambda: now[0], lambda s: slept.append(s))
    r.wait()
    now[0] = 0.25
    r.wait()
    assert slept == [0.75]


def test_result_cache(tmp_path):
    c = remote.ResultCache(tmp_path / "c")
    assert c.load("k") is None
    c.save("k", {"rid": "R"}, "raw")
    assert c.load("k") == {"rid": "R", "raw_text": "raw"}
    (tmp_path / "c" / "k.raw").unlink()
    assert c.load("k") is None  # both files must be there
    remote.ResultCache(None).save("k", {}, "")
    assert remote.ResultCache(None).load("k") is None


def test_env_file_upwards(tmp_path, monkeypatch):
    for k in ("NCBI_EMAIL", "NCBI_TOOL", "NCBI_API_KEY", "BLAST_PROGRAM", "BLAST_DB"):
        monkeypatch.delenv(k, raising=False)
    monkeypatch.setenv("NCBI_TOOL", "own")
    (tmp_path / ".env").write_text("# note\nNCBI_EMAIL=test@example.org\nNCBI_TOOL='other'\nNCBI_API_KEY=\"abc\"\nBLAST_PROGRAM=blastn\nBLAST_DB=nt\nodd line\n")
    (tmp_path / "a/b").mkdir(parents=True)
    s = env.remote(tmp_path / "a/b")
    assert (s.ncbi_email, s.ncbi_tool, s.ncbi_api_key) == ("test@example.org", "own", "abc") and list(s.missing()) == []
    assert list(env.Remote(None, "tool", None, "blastn", "nt").missing()) == ["NCBI_EMAIL", "NCBI_API_KEY"]
    for k in ("NCBI_EMAIL", "NCBI_API_KEY", "BLAST_PROGRAM", "BLAST_DB"):
        monkeypatch.delenv(k, raising=False)


def table(path):
    with open(path, newline="") as f:
        return list(csv.reader(f))


def test_fetch_command(tmp_path, monkeypatch):
    t = Recorded(search(["1"], 1), FASTA, json.dumps({"result": {"1": {"organism": "Homo"}}}))
    a = cli.parser().parse_args(["fetch", "--query", "q", "--sleep", "0", "--out-dir", str(tmp_path / "raw"), "--cache-dir", str(tmp_path / "cache")])
    assert cli._fetch(a, t) == 0
    assert json.loads((tmp_path / "raw/manifest.json").read_text())["ids_retrieved"] == ["1"]
    assert json.loads((tmp_path / "raw/metadata.jsonl").read_text())["organism"] == "Homo" and (tmp_path / "raw/ids.txt").read_text() == "1\n"


def test_the_stages_from_file_to_file(spark, tmp_path):
    src = tmp_path / "in.fasta"
    src.write_text(FASTA)
    (tmp_path / "m.jsonl").write_text('{"accession": "AB1.1", "organism": "Human", "taxid": 9606}\n{"accession": "zz", "organism": "none"}\n')
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("filter", "--in-fasta", src, "--out-dir", tmp_path / "f", "--dedupe", "--in-metadata", tmp_path / "m.jsonl", "--min-len", 10) == 0
    m = json.loads((tmp_path / "f/filter_manifest.json").read_text())
    assert (m["total_records"], m["kept_records"], m["reason_counts"]) == (3, 1, {"ok": 1, "duplicate": 1, "too_short": 1})
    report = table(tmp_path / "f/filter_report.csv")
    assert report[0] == ["record_id", "accession", "length", "n_count", "n_frac", "gc_percent", "kept", "reason", "duplicate_of", "original_header"]
    assert report[1][:9] == ["AB1.1", "AB1.1", "240", "0", "0.00000", "50.00", "true", "ok", ""] and report[2][7:9] == ["duplicate", "AB1.1"] and report[3][4:8] == ["0.25000", "66.67", "false", "too_short"]
    assert (tmp_path / "f/filtered_sequences.fasta").read_text().startswith(">AB1.1 | accession=AB1.1 | len=240 | n_frac=0.000 | gc=50.0\n")
    assert len((tmp_path / "f/filtered_metadata.jsonl").read_text().splitlines()) == 1

    assert run("motifs", "--in-fasta", src, "--out-dir", tmp_path / "k", "--k", 4, "--top", 3) == 0
    motifs = table(tmp_path / "k/motifs.csv")
    assert motifs[0] == ["kmer", "count", "freq", "n_records", "idf_like"] and len(motifs) == 4 and motifs[1][0] == "ACGT"
    assert table(tmp_path / "k/motifs_by_record.csv")[1][:2] == ["AB1.1", "ACGT"]
    assert run("motifs", "--in-fasta", src, "--out-dir", tmp_path / "k0", "--k", 500) == 0
    assert len(table(tmp_path / "k0/motifs.csv")) == len(table(tmp_path / "k0/motifs_by_record.csv")) == 1
    assert json.loads((tmp_path / "k0/motifs_summary.json").read_text())["notes"] == ["No k-mers extracted"]
    assert run("motifs", "--in-fasta", src, "--out-dir", tmp_path / "k1", "--min-count", 10_000) == 0
    assert not (tmp_path / "k1/motifs_by_record.csv").exists()

    assert run("cluster", "--in-fasta", src, "--out-dir", tmp_path / "c", "--in-metadata", tmp_path / "m.jsonl") == 0
    assert table(tmp_path / "c/cluster_edges.csv") == [["record_id_1", "record_id_2", "jaccard"], ["AB1.1", "AB2.1", "1.0000"]]
    lines = [json.loads(x) for x in (tmp_path / "c/clusters.jsonl").read_text().splitlines()]
    assert [(x["cluster_id"], x["size"]) for x in lines] == [("C0001", 2), ("C0002", 1)] and lines[0]["members"][1]["organism"] is None
    assert table(tmp_path / "c/cluster_stats.csv")[1] == ["C0001", "2", "240.00", "Human", "2", "1.0000", "1.0000"]
    (tmp_path / "one.fasta").write_text(">a\nACGT\n")
    assert run("cluster", "--in-fasta", tmp_path / "one.fasta", "--out-dir", tmp_path / "c1") == 0
    assert (tmp_path / "c1/clusters.jsonl").read_text() == "" and json.loads((tmp_path / "c1/cluster_manifest.json").read_text())["cluster_count"] == 1

    assert run("consensus", "--clusters", tmp_path / "c/clusters.jsonl", "--in-fasta", src, "--out-dir", tmp_path / "n") == 0
    assert (tmp_path / "n/consensus.fasta").read_text().startswith('>CONS_C0001 size=2 dominant_organism="Human" method=kmer k=9\n')
    assert table(tmp_path / "n/consensus_stats.csv")[1] == ["C0001", "2", "240", "0", "0.0000", "50.00", "kmer", "9", "80", "0.97", "ok", ""]
    assert run("filter", "--in-fasta", tmp_path / "none") == 1


def test_export_command(spark, tmp_path):
    (tmp_path / "f.csv").write_text("record_id,value\nrec1,1\nrec2,2\n")
    (tmp_path / "m.jsonl").write_text('{"accession": "rec1", "taxon": "Virus A"}\n{"accession": "rec2", "taxon": "Virus B"}')
    (tmp_path / "k.csv").write_text("record_id,motif\nrec1,M1\n")
    run = lambda f: cli.main(["export", "--features-csv", str(f), "--metadata-jsonl", str(tmp_path / "m.jsonl"), "--motifs-by-record-csv", str(tmp_path / "k.csv"), "--out-dir", str(tmp_path / "o")])
    assert run(tmp_path / "f.csv") == 0
    m = json.loads((tmp_path / "o/export_manifest.json").read_text())
    assert m["counts"] == {"features_rows": 2, "metadata_rows": 2, "joined_rows": 2, "motifs_rows": 1} and m["join_keys"] == ["record_id", "accession"]
    joined = {r["record_id"]: r["taxon"] for r in spark.read.parquet(f"file://{tmp_path}/o/joined_dataset.parquet").collect()}
    assert joined == {"rec1": "Virus A", "rec2": "Virus B"} and (tmp_path / "o/features.parquet").exists() and (tmp_path / "o/motifs_by_record.parquet").exists()
    assert run(tmp_path / "none.csv") == 2


REPORT = json.dumps({"BlastOutput2": [{"report": {"results": {"search": {"query_len": 4, "hits": [{"accession": "H1", "description": [{"accession": "H1", "title": "t [O]", "organism": "O"}], "hsps": [{"align_len": 4, "identity": 3, "evalue": 0.5, "bit_score": 9, "query_from": 1, "query_to": 4}]}]}}}}]})


def test_first_dialect_run_notes_failures_and_uses_the_cache(spark, tmp_path):
    (tmp_path / "q.fasta").write_text(">q1 x\nACGT\n>q2\nGGGG\n")
    args = (tmp_path / "q.fasta", tmp_path / "b", "blastn", "nt", "JSON2", 5, 0, 10, 0, tmp_path / "cache")
    t = Recorded("RID = A", "Status=READY", REPORT, "RID = B", "Status=FAILED")
    m = stages.blast(spark, remote.AlignmentJobs("e", "t", transport=t), *args)
    assert (m["total_queries"], m["succeeded"], m["failed"]) == (2, 1, 1)
    assert table(tmp_path / "b/blast_summary.csv")[1:] == [["q1", "H1", "75.000", "1.000", "0.5", "9.0"], ["q2", "", "", "", "", ""]]
    lines = [json.loads(x) for x in (tmp_path / "b/blast_hits.jsonl").read_text().splitlines()]
    assert lines[0]["raw_path"].endswith("0001_q1.json") and "failed" in lines[1]["error"] and lines[1]["rid"] == "B"
    again = stages.blast(spark, remote.AlignmentJobs("e", "t", transport=Recorded(remote.RemoteError("down"))), *args)
    assert (again["succeeded"], again["failed"]) == (1, 1)  # the first came from the cache


def test_second_dialect_run(spark, tmp_path):
    (tmp_path / "q.fasta").write_text(">q1 x\nACGU\n>q2\nGGGG\n")
    t = Recorded("RID = A", "Status=READY", REPORT, "RID = B", "Status=READY", "{}")
    m = stages.blast_throttled(spark, remote.ThrottledJobs("e", "t", "secret", 0, t), tmp_path / "q.fasta", tmp_path / "b", "blastn", "nt", "JSON2", 5, 0, 10, tmp_path / "cache", env.Remote("e", "t", "secret"))
    assert (m["ok"], m["failed"], m["config"]["ncbi_api_key"]) == (2, 0, "secr…") and t.asked[0][2]["QUERY"] == "ACGT"
    rows = table(tmp_path / "b/blast_summary.csv")
    assert rows[1] == ["q1", "A", "H1", "O", "75.0", "100.0", "0.5", "9.0"] and rows[2][:3] == ["q2", "B", ""]


def test_help_and_exit_codes(monkeypatch, capsys, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert cli.main([]) == 0 and "fetch" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    monkeypatch.delenv("NCBI_EMAIL", raising=False)
    (tmp_path / "x.fasta").write_text(">a\nA\n")
    assert cli.main(["blast", "--in-fasta", "x.fasta"]) == 1
    with pytest.raises(SystemExit):
        monkeypatch.delenv("NCBI_TOOL", raising=False)
        cli._blast2(cli.parser().parse_args(["blast2", "--in-fasta", "x.fasta"]))

import math
import random
from collections import Counter, defaultdict

import pytest

from helixframe.functions import windows as W
from helixframe.operators import cluster as C
from helixframe.operators import graph
from helixframe.operators import kmers as K


def records(spark, seqs):
    return spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(seqs)], "idx long, record_id string, sequence string")


def windows(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]


def random_seqs(seed, n=30, size=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(size)) for _ in range(6)]
    out = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            s[rng.randrange(size)] = rng.choice("ACGTN")
        out.append("".join(s[: rng.randint(2, size)]))
    return out


def test_motifs_against_a_counter(spark):
    seqs = random_seqs(1)
    counts, holders, first = Counter(), Counter(), {}
    for i, s in enumerate(seqs):
        for p, w in enumerate(windows(s, 4)):
            counts[w] += 1
            first.setdefault(w, (i, p))
        holders.update(set(windows(s, 4)))
    order = sorted(counts, key=lambda w: (-counts[w], first[w]))[:25]
    got = K.motifs(records(spark, seqs), 4, top=25).collect()
    assert [g["kmer"] for g in got] == order  # ties go to the first to appear
    total = sum(counts.values())
    for g in got:
        assert g["count"] == counts[g["kmer"]] and g["n_records"] == holders[g["kmer"]]
        assert math.isclose(g["freq"], counts[g["kmer"]] / total) and math.isclose(g["idf_like"], math.log((1 + len(seqs)) / (1 + holders[g["kmer"]])))


def test_ties_and_limits(spark):
    rows = records(spark, ["TTAATT", "CC"])
    assert [r["kmer"] for r in K.motifs(rows, 2, top=2).collect()] == ["TT", "TA"]
    assert K.motifs(rows, 2, top=0, min_count=2).count() == 1
    s = K.summary(rows, 2, 3, 1).first()
    assert (s["total_records"], s["total_kmers"], s["unique_kmers"], s["unique_after_filters"]) == (2, 6, 5, 3)


def test_no_kmers_at_all(spark):
    rows = records(spark, ["A", "NNNN", ""])
    assert K.motifs(rows, 3).count() == 0
    s = K.summary(rows, 3, 200, 1).first()
    assert (s["total_records"], s["total_kmers"], s["unique_kmers"]) == (3, 0, 0)


def test_by_record_shares_are_of_all_its_kmers(spark):
    rows = records(spark, ["AAAC", "GGGG"])
    got = {(r["record_id"], r["kmer"]): r["freq_in_record"] for r in K.motifs_by_record(rows, K.motifs(rows, 2, top=2), 2).collect()}
    assert got == {("r1", "GG"): 1.0, ("r0", "AA"): 2 / 3}


def test_wanted_kmers_are_looked_for_or_joined(spark, monkeypatch):
    """Records' k-mers are counted in batches as numbers; each one was a row of a sort within its record."""
    seqs = random_seqs(6, 40) + ["", "NN", "ACGTÉACGTÉ"]
    rows = records(spark, seqs)
    want = {(i, w, n, windows(s, 3).index(w)) for i, s in enumerate(seqs) for w, n in Counter(windows(s, 3)).items()}
    assert {tuple(r) for r in K.per_record(rows, 3).collect()} == want
    top = K.motifs(rows, 3, top=7)
    kept = {r["kmer"] for r in top.collect()}
    for most in (7, 6):
        monkeypatch.setattr(K, "WANTED", most)
        got = K.motifs_by_record(rows, top, 3)
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (most == 6)
        assert {(r["idx"], r["kmer"], r["count"], r["first_pos"]) for r in got.collect()} == {x for x in want if x[1] in kept}


def test_canonical_is_off_for_rna(spark):
    rows = records(spark, ["TTT"])
    assert K.motifs(rows, 3, canonical=True).first()["kmer"] == "AAA"
    assert K.motifs(rows, 3, canonical=True, alphabet="RNA").first()["kmer"] == "TTT"
    with pytest.raises(ValueError):
        K.motifs(rows, 0)


def brute(seqs, k, t, cap=None):
    sets = [set(windows(s, k)) for s in seqs]
    pairs = [(i, j) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if sets[i] & sets[j]]
    hit = cap is not None and len(pairs) > cap
    sims = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs[:cap]}
    return {p: s for p, s in sims.items() if s >= t}, min(len(pairs), cap or len(pairs)), hit


@pytest.mark.parametrize("cap", [None, 7, 10_000])
def test_edges_against_all_pairs(spark, cap):
    seqs = random_seqs(2, 100)
    want, n, hit = brute(seqs, 5, 0.35, cap)
    links, pairs, was_hit = C.edges(records(spark, seqs), 5, 0.35, cap)
    assert {(r["i"], r["j"]): r["jaccard"] for r in links.collect()} == pytest.approx(want)
    assert (pairs.count(), was_hit) == (n, hit)


def test_uncapped_pairs_are_not_all_joined(spark, monkeypatch):
    """Frequent k-mers made the join quadratic; now it takes rare ones, sets once, and pairs that a bound leaves possible."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = letters(40)
    seqs = [common + letters(120) for _ in range(60)] + [letters(200)] * 20 + ["NNNN", "", "ACG"]
    seqs += [s[: rng.randint(100, 160)] for s in seqs[:20]]
    made = []
    real = C._close
    monkeypatch.setattr(C, "_close", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(C, "BLOCK", 400)  # components are cut into several blocks
    monkeypatch.setattr(C, "drop", lambda *a: None)
    for t in (0.35, 0.0, 1.0):
        want, _, _ = brute(seqs, 9, t)
        links, _, _ = C.edges(records(spark, seqs), 9, t, None)
        assert {(r["i"], r["j"]): r["jaccard"] for r in links.collect()} == pytest.approx(want)
    assert made[0].count() < 100  # of the 60 * 59 / 2 pairs that share k-mers


def test_numbers_of_kmers():
    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 50))) for a in ["ACGT", "ACGTN", "ACGNX", "ACGTÉ\U0001f600"] * 8]
    comp = str.maketrans("ACGT", "TGCA")
    for k in (1, 3, 9, 31, 33):
        for ignore_n in (True, False):
            for canonical in (True, False):
                found = [(i, t[p : p + k]) for i, t in enumerate(texts) for p in range(len(t) - k + 1)]
                want = [(i, min(w, w[::-1].translate(comp)) if canonical else w) for i, w in found if not (ignore_n and "N" in w)]
                letters, start, record, code = W.codes(texts, k, ignore_n, canonical)
                spelled = [x.decode() if isinstance(x, bytes) else x for x in W.spelled(letters, start, code, k, canonical)]
                assert list(zip(record.tolist(), spelled)) == want
                assert len(set(code.tolist())) == len({w for _, w in want}) == len(set(zip(code.tolist(), spelled)))


def test_clusters(spark):
    seqs = random_seqs(3, 40)
    links, _, _ = C.edges(records(spark, seqs), 5, 0.5)
    rows = records(spark, seqs)
    lookup = spark.createDataFrame([(f"r{i}", f"o{i % 3}" if i % 4 else None, i) for i in range(40)], "key string, organism string, taxid long")
    got = C.clusters(rows, links, lookup).orderBy("number").collect()
    want, _, _ = brute(seqs, 5, 0.5)
    up = list(range(40))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, j in want:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(40):
        groups[find(i)].append(i)
    ordered = sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))
    assert [g["cluster_id"] for g in got] == [f"C{i:04d}" for i in range(1, len(ordered) + 1)]
    for g, (root, members) in zip(got, ordered):
        assert g["component"] == root and [m["record_id"] for m in g["members"]] == [f"r{i}" for i in members]
        names = [f"o{i % 3}" if i % 4 else "UNKNOWN" for i in members]
        assert g["dominant_organism"] == Counter(names).most_common(1)[0][0] and g["n_unique_organisms"] == len(set(names))
        sims = [s for (i, j), s in want.items() if find(i) == root]
        assert g["max_pairwise_sim"] == pytest.approx(max(sims, default=0)) and g["mean_pairwise_sim"] == pytest.approx(sum(sims) / len(sims) if sims else 0)


def test_components_of_awkward_graphs(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    rest = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    edges = chain + star + rest + [(None, 3), (7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    f = graph.Forest()
    for a, b in edges:
        if a is not None:
            f.join(a, b)
    nodes = {x for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    assert got == {x: f.find(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_labels_do_not_depend_on_row_order(spark):
    rng = random.Random(8)
    seqs = random_seqs(4, 25)
    rows = records(spark, seqs)
    links = [tuple(r) for r in C.edges(rows, 5, 0.4)[0].collect()]
    seen = set()
    for _ in range(2):
        rng.shuffle(links)
        df = spark.createDataFrame(links, "i long, j long, jaccard double")
        seen.add(tuple(sorted((r["idx"], r["component"]) for r in C.labels(rows, df).collect())))
    assert len(seen) == 1


def test_pair_search_moves_no_row_for_a_kmer(spark, monkeypatch):
    """Rows (record, k-mer) were shuffled, more than the disk holds; now packed numbers of blocks are, and blocks are joined from files."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = []
    for _ in range(25):
        s = letters(rng.randint(30, 300))
        seqs += [s, s[: rng.randint(20, len(s))], s[: len(s) // 2] + letters(len(s) // 2), s[5:] + "N" + letters(9)]
    seqs += ["ACGTXACGTACGÉACGTACGT" * 2, "ACGTXACGTACGÉACGTACG" * 2, "AC" * 30, "AC" * 50]
    monkeypatch.setattr(C, "BLOCK", 700)
    monkeypatch.setattr(C, "MATCHES", 50)
    sent = []
    real = C.stash
    monkeypatch.setattr(C, "stash", lambda df, name: sent.append((name, df.count())) or real(df, name))
    for k, t in ((7, 0.35), (7, 0.6), (33, 0.2)):
        want, _, _ = brute(seqs, k, t)
        links, classes = C.similar(records(spark, seqs), k, t)
        got = C.expanded(links, classes, t).collect()
        assert {(r["i"], r["j"]): r["jaccard"] for r in got} == pytest.approx(want) and len(got) == len(want)
    assert max(n for _, n in sent) <= len(want) + 2 * len(seqs) + 2000


def test_packed_numbers():
    import numpy as np

    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 1 << 40, 100), rng.integers(-(1 << 62), 1 << 62, 100), np.zeros(3, np.int64), np.array([], np.int64), np.arange(300)):
        assert C._unpacked(C._packed(x, False), len(x), False).tolist() == x.tolist()
        assert C._unpacked(C._packed(np.sort(x)), len(x)).tolist() == np.sort(x).tolist()
    code = np.arange(-5, 1 << 12)
    assert len(set(W.mixed(code, 6).tolist())) == len(code) and (W.mixed(code, 6) < 1 << 12).all()


def test_ties_weigh_as_all_pairs(spark):
    seqs = random_seqs(7, 30) + random_seqs(7, 30)[:20] + random_seqs(7, 30)[:9]
    rows = records(spark, seqs)
    links, classes = C.similar(rows, 5, 0.35)
    cols = ["component", "size", "max_pairwise_sim", "mean_pairwise_sim"]
    a, b = ({r[0]: tuple(r[1:]) for r in C.clusters(rows, x).select(cols).collect()} for x in (C.ties(links, classes, 0.35), C.expanded(links, classes, 0.35)))
    assert set(a) == set(b) and all(a[x] == pytest.approx(b[x]) for x in a)

import math

import numpy as np
import pytest

from helixframe.llm import cover_tree as V


def brute(rows, cos):
    up, n = {i: i for i, *_ in rows}, [0] * len(rows)

    def find(x):
        return x if up[x] == x else find(up[x])

    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for a, (i, v, s) in enumerate(rows):
        for b, (j, w, r) in enumerate(rows):
            if a == b or s is None or s != r or i is None or j is None or not sound(v) or not sound(w) or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cos:
                n[a] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, n[k], None if i is None else find(i), i is not None and find(i) == i) for k, (i, *_) in enumerate(rows)), key=str)


def found(spark, rows, cos=0.98):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted((tuple(r) for r in V.near_duplicates(df, cos).collect()), key=str)


def corpus(seed, dim=8, n=220):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] * rng.uniform(0.1, 5) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.3, 2.0])
        rows.append((i * 2, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(1001, rows[0][1], rows[0][2]), (1003, rows[0][1], rows[0][2]), (1005, rows[0][1], None), (1007, None, 1), (1009, [0.0] * dim, 1), (1011, [float("nan")] * dim, 1)]
    rows += [(1013, [float("inf")] + [1.0] * (dim - 1), 1), (1015, [], 1), (1017, [None] + [1.0] * (dim - 1), 1), (1019, [1.0, 2.0], 1), (1021, [2.0, 4.0], 1), (1023, [float(np.float32(3 * x)) for x in rows[0][1]], rows[0][2])]
    return rows


@pytest.mark.parametrize("cos", [0.98, 0.9])
def test_against_all_pairs(spark, cos):
    rows = corpus(3)
    assert found(spark, rows, cos) == brute(rows, cos)


def test_many_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "LEAF", 4)
    rows = corpus(4, 3, 260)  # few dimensions, so that trees have depth and balls are pruned
    assert found(spark, rows) == brute(rows, 0.98)


def test_a_crowd_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 32)
    rng = np.random.default_rng(1)
    c = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in c + rng.normal(size=16) * 0.03], 1) for i in range(150)]
    assert found(spark, rows) == brute(rows, 0.98)


@pytest.mark.parametrize("dim", [2, 6])
def test_levels_of_tables(spark, monkeypatch, dim):
    for name, value in (("BLOCK", 12), ("LEAF", 4), ("FANOUT", 3), ("LOT", 20), ("PARTNERS", 2)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, dim))
    # tight crowds are taken whole on several levels; equal vectors and lone ones beside them
    rows = [(i, [float(np.float32(x)) for x in base[i % 9] + rng.normal(size=dim) * [0.0005, 0.001, 0.2][i % 3]], i % 2) for i in range(330)]
    rows += [(1000 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(20)]
    assert found(spark, rows) == brute(rows, 0.98)


def test_constant_and_very_long_vectors(spark):
    rng = np.random.default_rng(6)
    long = rng.normal(size=6000)
    rows = [(1, [1.0] * 3, 1), (2, [2.0] * 3, 1), (3, [-1.0] * 3, 1), (4, [1.0, 1.0, 3.0], 1), (5, long.tolist(), 1), (6, (long * 2).tolist(), 1), (7, [0.0] * 3, 1)]
    rows = [(i, [float(np.float32(x)) for x in v], s) for i, v, s in rows]
    got = found(spark, rows)
    assert got == brute(rows, 0.98) and [g[1] for g in got] == [1, 1, 0, 0, 1, 1, 0]


def points(n, dim, seed=0, noise=0.05):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(8, dim))[rng.integers(8, size=n)] + rng.normal(size=(n, dim)) * noise
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_tree_levels_cover_and_separate(monkeypatch):
    monkeypatch.setattr(V, "LEAF", 4)
    x = points(300, 3)
    t = V.Tree(x, 0.01)
    assert sorted(t.order.tolist()) == list(range(300))
    deep = 0
    for k in range(len(t.center)):
        own = t.order[t.lo[k] : t.hi[k]]
        assert (V.chords(x[own] @ x[t.center[k]]) <= t.radius[k] + 1e-9).all()
        kids = t.kids[k]
        if kids:
            deep += 1
            assert sorted(i for c in kids for i in t.order[t.lo[c] : t.hi[c]]) == sorted(own)
            assert all(t.radius[c] <= t.radius[k] / 2 + 1e-9 for c in kids)  # radii halve
            ends = x[t.center[kids]]
            apart = V.chords(ends @ ends.T)[np.triu_indices(len(kids), 1)]
            assert (apart > t.radius[k] / 2 - 1e-9).all()  # centres are separated
    assert deep > 3


def test_traversal_meets_every_link_once_and_prunes(monkeypatch):
    monkeypatch.setattr(V, "LEAF", 4)
    a, b = points(200, 3, 1), points(150, 3, 2)
    seen, looked = np.zeros((200, 150), int), 0
    for r, c, hit in V.traverse(V.Tree(a, 0.01), V.Tree(b, 0.01), 0.98):
        looked += len(r) * len(c)
        seen[np.ix_(r, c)] += 1 if hit is None else hit
    assert (seen == (a @ b.T >= 0.98)).all() and looked < 200 * 150


def test_empty_table_and_null_ids(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)]) == sorted([(None, 0, None, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)], key=str)

import numpy as np
import pytest

from helixframe.llm import frequency as Q


@pytest.mark.parametrize("values", [[5], [0, 0, 1], [1, 1 << 39, (1 << 40) - 1], list(range(1000))])
def test_packed_values_come_back(values):
    v = np.array(values, np.uint64)
    assert (Q.unpack(Q.pack(v)) == v).all()


def test_ranges_cover_all_values_and_caps_keep_repeats(rng):
    v = rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)
    v[:1000] = v[0]
    spread = Q.Spread(7, 40)
    p = Q.Packer(spread, most=100_000)
    assert list(p.add(v)) == []
    used, data = p.flush()
    back = np.concatenate([Q.unpack(x) for x in data])
    assert used == sorted(used) and (np.unique(back) == np.unique(spread.narrowed(v))).all()
    assert (back == spread.narrowed(v[:1])[0]).sum() == Q.REPEATS
    assert p.flush() == ([], [])


def test_repeated_values_over_tasks(spark, rng):
    v = rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2)
    parts = [np.concatenate([v[i::5], v[:40]]) for i in range(5)]
    rows, spread = [], Q.Spread(4, 40)
    for x in parts:
        p = Q.Packer(spread)
        list(p.add(x))
        rows += [(u, bytearray(d)) for u, d in zip(*p.flush())]
    got = {r["value"]: r["n"] for r in Q.repeated(spark.createDataFrame(rows, "range int, packed binary")).collect()}
    values, n = np.unique(spread.narrowed(np.concatenate(parts)), return_counts=True)
    assert got == {int(a): int(b) for a, b in zip(values, n) if b > 1}


@pytest.mark.parametrize("most", [1 << 16, 1 << 20])
def test_bit_tables_never_miss(spark, rng, most):
    keys = rng.integers(-(1 << 62), 1 << 62, (2000, 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in keys] + [(None, 1)], "a long, b long")
    t = Q.bit_table(df, "a", "b", max_bits=most)
    assert t.has(Q.mix(keys[:, 0], keys[:, 1])).all()
    other = rng.integers(-(1 << 62), 1 << 62, (20_000, 2))
    assert t.has(Q.mix(other[:, 0], other[:, 1])).mean() < 0.1
    assert not Q.bit_table(df.limit(0), "a").has(Q.mix(keys[:, 0])).any()


def test_spread_follows_the_number_of_values():
    assert Q.Spread.of(1000, 4) == (16, 40)
    big = Q.Spread.of(10**12, 4)
    assert big.bits > 50 and big.ranges * Q.RANGE_BYTES > 7 * 10**12
    assert Q.Spread.of(10**16, 4) == (Q.MOST_RANGES, 60)

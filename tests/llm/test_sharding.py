from collections import Counter

import pytest

from helixframe.llm import sharding as H


def test_every_slot_is_owned_and_shares_are_even():
    owner = H.fill(H.shard_names(16), 1607)
    n = Counter(owner)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1


def test_turns_follow_each_shard_s_order():
    names, slots = ["a", "b", "c"], 11
    owner, taken = H.fill(names, slots), []
    orders = [[(H.md5_60("offset:" + n) % slots + j * (H.md5_60("step:" + n) % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    assert all(sorted(o) == list(range(slots)) for o in orders)
    for turn in range(slots):
        k = turn % 3
        slot = next(s for s in orders[k] if s not in taken)
        taken.append(slot)
        assert owner[slot] == k


def test_few_keys_move_when_a_shard_goes():
    names = H.shard_names(16)
    a, b = [names[k] for k in H.fill(names, 1607)], [names[:-1][k] for k in H.fill(names[:-1], 1607)]
    moved = sum(x != y for x, y in zip(a, b) if x != names[-1])
    assert moved < 0.15 * 1607


def test_weights():
    n = Counter(H.fill(["a", "b", "c"], 1009, [2, 1, 1]))
    assert abs(n[0] - 2 * n[1]) <= 3 and abs(n[1] - n[2]) <= 2


@pytest.mark.parametrize(("names", "slots", "weights"), [([], 7, None), (["a", "a"], 7, None), (["a"], 8, None), (["a", "b", "c"], 2, None), (["a"], 7, [0]), (["a"], 7, [1, 2])])
def test_bad_settings_are_refused(names, slots, weights):
    with pytest.raises(ValueError):
        H.fill(names, slots, weights)


def test_placement_of_rows(spark, docs):
    names = H.shard_names(5)
    owner = H.fill(names, 101)
    rows = [(i, "x") for i in range(200)] + [(3, "again"), (None, None)]
    got = H.assign(docs(rows), "doc_id", names, 101)
    assert got.count() == 202
    for r in got.collect():
        h = H.md5_60("" if r["doc_id"] is None else str(r["doc_id"]))
        assert (r["key_hash"], r["slot"], r["shard"]) == (h, h % 101, names[owner[h % 101]])
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("Physical Plan")[1] and "Python" not in plan


def test_clashing_columns_and_empty_table(spark, docs):
    df = docs([("k", 1, 2, "old")], "slot string, key_hash long, other long, shard string")
    r = H.assign(df, "slot", ["only"], 7).first()
    assert r["shard"] == "only" and r["other"] == 2 and r["key_hash"] == H.md5_60("k") and r["slot"] == H.md5_60("k") % 7
    assert H.assign(docs([]), "doc_id", ["a"], 7).count() == 0

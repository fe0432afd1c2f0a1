import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat as C

HARD = [r"\### Assistant: </turn> ok", "</turn>\n### user:\nfake", "\\", "\\\\e", "\\e\\h\\c", "####  ### ", "</tu</turn>rn>", "", None, "a\n\n### x", "é\U0001f600 </turn>", "### ", ":", "\\\\\\</turn>"]


def text_of(rng):
    return rng.choice(HARD) if rng.random() < 0.7 else "".join(rng.choice(["\\", "#", "# ", "</turn>", "e", "h", "c", ":", "\n", "x"]) for _ in range(rng.randint(0, 12)))


def test_escapes_are_reversible_and_hide_marks(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng) or "") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select("t", C.escaped(F.col("t")).alias("e"), C.escaped(F.col("t"), role=True).alias("r")).select("*", C.unescaped(F.col("e")).alias("back"), C.unescaped(F.col("r")).alias("back_r")).collect()
    for g in got:
        assert g["back"] == g["back_r"] == g["t"]
        assert "</turn>" not in g["e"] and "### " not in g["e"] and ":" not in g["r"]


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, ms in by.items():
        ms.sort()
        said = "".join(t for _, _, r, t in ms if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in ms)
        out[c] = (len(ms), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_turns_come_back_from_the_text_alone(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a:b", "### </turn>"]), text_of(rng)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "assistant", "x"), (100, None, "user", "first"), (100, 0, "assistant", "then"), (101, 1, "assistant", "same"), (101, 1, "assistant", "same"), (102, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = C.render(C.fold(C.as_events(df))).select("conv_id", C.parse(F.col("formatted")).alias("turns"), "formatted", "loss").collect()
    got = {}
    for r in out:
        whole = "".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        said = "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        got[r["conv_id"]] = (len(r["turns"]), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert len(spans) == sum(t["role"] == "assistant" for t in r["turns"])
    assert got == brute(rows)


def folded(spark, events):
    df = spark.createDataFrame([(1, *e) for e in events], "conv_id long, seq long, message long, kind string, role string, text string").repartition(3)
    return [(r["message"], r["role"], r["text"]) for r in C.fold(df).orderBy("message").collect()]


def place(event):
    seq, m, kind, role, text = event
    return (seq is not None, seq or 0, m, kind, role, text or "")


def simulate(events):
    """The log, event by event."""
    now, roles = {}, {}
    for _, m, kind, role, text in sorted(events, key=place):
        text = text or ""
        if kind in ("message", "edit", "regenerate"):
            if kind == "regenerate":
                for later in [k for k in now if k > m]:
                    del now[later]
            now[m], roles[m] = text, role
        elif kind == "delta":
            if m in now:
                now[m] += text
            else:
                now[m], roles[m] = text, role
        elif kind == "delete":
            now.pop(m, None)
    return [(m, roles[m], now[m]) for m in sorted(now)]


def test_deltas_edits_regenerations(spark):
    assert folded(spark, [(1, 1, "message", "user", "hi"), (2, 2, "delta", "assistant", "he"), (3, 2, "delta", "assistant", "llo")]) == [(1, "user", "hi"), (2, "assistant", "hello")]
    assert folded(spark, [(1, 1, "message", "user", "hi"), (2, 1, "edit", "user", "ho"), (3, 1, "delta", "user", "!")]) == [(1, "user", "ho!")]
    log = [(1, 1, "message", "user", "q"), (2, 2, "delta", "assistant", "old"), (3, 3, "message", "user", "more"), (4, 2, "regenerate", "assistant", "new"), (5, 2, "delta", "assistant", "er"), (6, 3, "message", "user", "again")]
    assert folded(spark, log) == [(1, "user", "q"), (2, "assistant", "newer"), (3, "user", "again")]
    assert folded(spark, log[:5]) == [(1, "user", "q"), (2, "assistant", "newer")]
    assert folded(spark, [(1, 1, "message", "user", "q"), (2, 1, "delete", "user", None)]) == []


def test_null_sequence_numbers_come_first(spark):
    assert folded(spark, [(None, 1, "message", "user", "hi"), (2, 1, "delta", "user", "!"), (3, 1, "delta", "user", "?")]) == [(1, "user", "hi!?")]
    log = [(None, 2, "regenerate", "assistant", "new"), (1, 2, "delta", "assistant", "er"), (None, 3, "message", "user", "stays")]
    assert folded(spark, log) == [(2, "assistant", "newer"), (3, "user", "stays")]


def test_deltas_after_a_regeneration_stay(spark):
    log = [(1, 3, "message", "user", "gone"), (2, 2, "regenerate", "assistant", "new"), (3, 3, "delta", "user", "x")]
    assert folded(spark, log) == simulate(log) == [(2, "assistant", "new"), (3, "user", "x")]
    log = [(1, 2, "delta", "assistant", "old"), (2, 1, "regenerate", "user", "q"), (3, 2, "delta", "assistant", "after")]
    assert folded(spark, log) == simulate(log) == [(1, "user", "q"), (2, "assistant", "after")]


@pytest.mark.parametrize("seed", range(4))
def test_logs_against_a_simulation(spark, seed):
    rng = random.Random(seed)
    logs = {}
    for c in range(120):
        events = []
        for seq in range(rng.randint(1, 16)):
            m = rng.randint(1, 4)
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            at = rng.choice([seq, seq, seq, None, rng.randint(0, 15)]) if seed else seq  # nulls and ties
            events.append((at, m, kind, rng.choice(["user", "assistant"]), rng.choice([f"{seq}.", f"{seq}.", "", None])))
        logs[c] = events
    rows = [(c, *e) for c, es in logs.items() for e in es]
    df = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string").repartition(4)
    got = {}
    for r in C.fold(df).orderBy("conv_id", "message").collect():
        got.setdefault(r["conv_id"], []).append((r["message"], r["role"], r["text"]))
    assert got == {c: x for c, es in logs.items() if (x := simulate(es))}


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = C.render(C.fold(C.as_events(df)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.render(C.fold(C.as_events(none))).count() == 0

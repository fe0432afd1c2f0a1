import json

from helixframe.operators import filter as Q
from helixframe.streaming import quality


def test_a_stream_is_judged_like_a_batch(spark, tmp_path):
    rows = [(0, "AB1 Homo", "ACGT" * 60), (1, "x", "AC"), (2, "y", "N" * 300)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"idx": i, "header": h, "sequence": s}) + "\n" for i, h, s in rows))
    q = quality.judged(quality.read_stream(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("judged").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["idx"]: r["reason"] for r in spark.table("judged").collect()}
    batch = Q.annotate(Q.records_of(spark.createDataFrame(rows, "idx long, header string, sequence string")))
    assert got == {r["idx"]: r["reason"] for r in batch.collect()} == {0: "ok", 1: "too_short", 2: "too_many_N"}

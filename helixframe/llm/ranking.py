"""Ranks of pairs by Spark's sort, for prefix doubling (operator 9).

Rows (at, .., major, minor) are sorted over all partitions by (major, minor, at). Equal pairs are a class and stand together. A
class may go over any number of partitions, so a hot one needs no task of its own. Each task goes through its own sorted
rows, of which there are about ``ROWS``, and tells the first and last class of its partition; the driver, which gets two
rows a partition, joins classes across borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cores, drop, stash_map, stash_slim

#: About how many rows a sorted partition has.
ROWS = 500_000
#: Bits of a rank that number a partition's classes.
CLASS_BITS = 32


def _sorted(rows: DataFrame) -> DataFrame:
    """rows in order, with the number of their partition. rows is stashed, as it is read twice: for the borders, and to be sorted."""
    parts = max(cores(rows.sparkSession), -(-rows.count() // ROWS))
    by = ("major", "minor", "at")
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())


class _Part:
    """A partition's sorted rows: where classes begin, and how many rows each has."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if self.table is None:
            return
        self.number = self.table["part"][0].as_py()
        self.major, self.minor = (np.asarray(self.table[c].combine_chunks()) for c in ("major", "minor"))
        group = np.concatenate([[True], self.major[1:] != self.major[:-1]])
        self.new = group | np.concatenate([[True], self.minor[1:] != self.minor[:-1]])
        self.first = np.flatnonzero(self.new)
        self.count = np.diff(np.append(self.first, len(self.new)))
        # classes whose major rank another class of the partition has
        of_group = np.cumsum(group)[self.first] - 1
        self.several = np.bincount(of_group)[of_group] > 1

    def rows(self, at: np.ndarray, kind: int, columns: list[str], **more) -> pa.RecordBatch:
        n = len(at)
        taken = self.table.select(columns).take(pa.array(at)).combine_chunks()
        cols = {"kind": pa.array(np.full(n, kind, np.int32)), "part": pa.array(np.full(n, self.number, np.int32)), **{c: taken[c].combine_chunks() if n else pa.array([], self.table.schema.field(c).type) for c in columns}, **{c: pa.array(x) for c, x in more.items()}}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _chains(edges: list) -> list[list]:
    """The border classes of all partitions, in order, those joined that go on across borders. edges: rows with part, major,
    minor, flag and whether the class ends its partition (kind 3) or begins it (kind 2; both, if it is the only one and
    there is no row of kind 3)."""
    chains: list[list] = []
    for e in edges:
        before = chains[-1][-1] if chains else None
        if before is not None and before["part"] != e["part"] and (before["major"], before["minor"]) == (e["major"], e["minor"]):
            chains[-1].append(e)
        else:
            chains.append([e])
    return chains


def rerank(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(settled, left) of rows (at, size, major, minor): (at, size) of rows that aren't the first of their class, and (at) of the
    firsts of classes that share their major rank with another class. rows is stashed; so are both results."""
    spark, kind_of = rows.sparkSession, dict(rows.dtypes)["at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Part(batches)
        if p.table is None:
            return
        columns = ["at", "size", "major", "minor"]
        last = len(p.first) - 1
        out = lambda at, kind, flag: p.rows(at, kind, columns, flag=flag)
        later = np.flatnonzero(~p.new)
        yield out(later, 0, np.zeros(len(later), bool))
        inner = p.first[1:][p.several[1:]]  # a last class that has company is settled here as well
        yield out(inner, 1, np.ones(len(inner), bool))
        yield out(p.first[:1], 2, p.several[:1])
        if last:
            yield out(p.first[last:], 3, p.several[last:])

    done = stash_map(_sorted(rows.select("at", "size", "major", "minor")), run, f"kind int, part int, at {kind_of}, size long, major long, minor long, flag boolean", f"{name}-sorted")
    chains = _chains(done.where("kind >= 2").orderBy("part", "kind").collect())  # two rows a partition
    several = [any(e["flag"] for e in c) for c in chains]
    for i, (a, b) in enumerate(zip(chains, chains[1:])):
        # neighbours across a border; within a partition the flags know
        if a[-1]["part"] != b[0]["part"] and a[-1]["major"] == b[0]["major"]:
            several[i] = several[i + 1] = True
    later, firsts = [], []
    for c, more in zip(chains, several):
        later += [(e["at"], e["size"]) for e in c[1:]]
        if more and not (c[0]["kind"] == 3 and c[0]["flag"]):
            firsts.append((c[0]["at"], c[0]["size"]))
    kind = f"at {kind_of}, size long"
    settled = stash_slim(done.where("kind = 0").select("at", "size").union(spark.createDataFrame(later, kind)), f"{name}-settled")
    left = stash_slim(done.where("kind = 1").select("at").union(spark.createDataFrame(firsts, kind).select("at")), f"{name}-left")
    drop(done)
    return settled, left


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """(at, side, rank) of rows (at, side, major, minor) whose pair another row has too; stashed. rank is the place of
    the pair among all pairs in order."""
    spark, kind_of = rows.sparkSession, dict(rows.dtypes)["at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Part(batches)
        if p.table is None:
            return
        rank = (np.int64(p.number) << CLASS_BITS) + np.cumsum(p.new) - 1
        last = len(p.first) - 1
        inner = np.flatnonzero(np.repeat(p.count > 1, p.count))
        columns = ["at", "side", "major", "minor"]
        out = lambda at, kind, n: p.rows(at, kind, columns, rank=rank[at], n=n)
        yield out(inner, 0, np.zeros(len(inner), np.int64))
        yield out(p.first[:1], 2, p.count[:1])
        if last:
            yield out(p.first[last:], 3, p.count[last:])

    done = stash_map(_sorted(rows.select("at", "side", "major", "minor")), run, f"kind int, part int, at {kind_of}, side long, major long, minor long, rank long, n long", f"{name}-sorted")
    again, more = [], []
    for c in _chains(done.where("kind >= 2").orderBy("part", "kind").collect()):  # two rows a partition
        again += [(e["rank"], c[0]["rank"]) for e in c[1:]]
        if len(c) > 1:
            more += [(e["at"], e["side"], c[0]["rank"]) for e in c if e["n"] == 1]
    # ranks that go on from an earlier partition, one a partition at most
    names = F.broadcast(spark.createDataFrame(again, "rank long, whole long"))
    found = done.where("kind = 0").join(names, "rank", "left").select("at", "side", F.coalesce("whole", "rank").alias("rank"))
    out = stash_slim(found.union(spark.createDataFrame(more, f"at {kind_of}, side long, rank long")), name)
    drop(done)
    return out

"""Connected components of a graph given as edges, by alternating large and small stars.

A large star links each node's larger neighbours to its smallest one; a small star links a node and its smaller
neighbours to the smallest. A few rounds turn every component into a star around its smallest node. Tasks first replace
their edges by a spanning forest, minima are added up before they are shuffled, and the joins back are plain ones that
Spark splits at hot nodes. Every half round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, stash


class Forest:
    """Union-find; the smallest node of a set is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple]:
        return [(x, self.find(x)) for x in self.up]


def forest_of(edges: DataFrame) -> DataFrame:
    """(a, b), a > b: the edges of each task's spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for t in batches:
            for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                if a is not None and b is not None:
                    f.join(a, b)
        got = f.edges()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components", stash: Callable[[DataFrame, str], DataFrame] = stash) -> DataFrame:
    """(node, root) of every node with an edge, its component's smallest node being the root; stashed, in the way given."""
    now = stash(forest_of(edges).distinct(), name)

    def signature(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    sig = signature(now)
    while sig[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), name)
        large = stash(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), name)
        drop(least, now)
        # each edge has a > b, so a node's smaller neighbours are its own edges' ends
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), name)
        met = large.join(least, F.col("a") == F.col("u"))
        small = stash(met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("u", "m")).distinct(), name)
        drop(least, large)
        now, before, sig = small, sig, signature(small)
        if sig == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = stash(roots.union(roots.select(F.col("root").alias("node"), "root")).distinct(), name)
    drop(now)
    return out

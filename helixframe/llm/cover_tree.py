"""Exact near-duplicate vectors by dual traversal of cover trees (operator 8).

Method. Vectors of a label (and of one length) are compared by cosine. On unit vectors that is a distance: cosine >= c is a
chord of at most sqrt(2 - 2c). Equal vectors are one point with a count. A label's points make one tree of nested
levels. Its upper levels are tables: a node with more than ``BLOCK`` points is split among up to ``FANOUT`` of its own points,
drawn by hash, each point going to the nearest one; a node knows its centre and covering radius. Below, each node left
has a cover tree in a task: levels of separated centres whose radii halve, down to leaves of a few points or to where a
level would hardly group them. The traversal is dual in both parts, a level at a time from the root's pair with itself: a
pair of nodes is dropped if its balls can't hold a link, taken whole if all its pairs must be links, and else split; pairs
of leaves are compared in full, in double precision.

A task returns for each point how many others it is linked with and a root of its links, never the pairs. Centres are a
sample only to place points; which links are found doesn't depend on them.

Scale: the driver gets counts alone. A level moves the vectors of nodes that are still large once; points of a large node
are dealt over many tasks, each with the node's centres beside them. Nodes tighter than an eighth of the threshold aren't split, as a
pair of them is taken whole. A block is sent once for each ``PARTNERS`` partners, and its tree built as often. At worst, when
vectors of a label lie alike far from each other, as random ones do, no ball is far from another and every two blocks of
a label are compared, in matrix products; no exact metric tree avoids that.

Defined results: a null, empty or zero vector, or one with null or non-finite components, links with nothing, as does one
with a null label; it is its own component. A null id has no component and isn't kept. Rows that repeat an id count as rows
each in n_links and share a component. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import drop, stash, table

BLOCK = 1024
LEAF = 64
#: Parts of a split node; points that are routed in one task; blocks that meet one in one task; levels of tables at most.
FANOUT, LOT, PARTNERS, LEVELS = 64, 4096, 8, 12
#: Room for rounding in bounds; comparisons at leaves use none.
SLACK = 1e-9


def unit(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def chords(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


class Tree:
    """Nodes in arrays: a centre (a point), a radius that covers the node's points, a range of the point order, children."""

    def __init__(self, x: np.ndarray, least: float) -> None:
        self.x, order = x, np.arange(len(x))
        self.center, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        todo = [(0, len(x), None, -1)]
        while todo:
            lo, hi, center, up = todo.pop()
            own = order[lo:hi]
            center = own[0] if center is None else center
            far = chords(x[own] @ x[center])
            k = len(self.center)
            self.center.append(center)
            self.radius.append(float(far.max()))
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([])
            if up >= 0:
                self.kids[up].append(k)
            if hi - lo <= LEAF or self.radius[k] <= least:
                continue
            parts = self.net(own, self.radius[k] / 2)
            if parts is None:
                continue
            at = lo
            for c, p in parts:
                order[at : at + len(p)] = p
                todo.append((at, at + len(p), c, k))
                at += len(p)
        self.order = order
        self.center, self.radius, self.lo, self.hi = np.array(self.center), np.array(self.radius), np.array(self.lo), np.array(self.hi)

    def net(self, own: np.ndarray, r: float):
        """Centres more than r apart, each with the points it covers; None if they would be nearly as many as points."""
        parts, rest = [], own
        while len(rest):
            if len(parts) > max(4, len(own) // 8):
                return None
            near = chords(self.x[rest] @ self.x[rest[0]]) <= r
            near[0] = True
            parts.append((rest[0], rest[near]))
            rest = rest[~near]
        return parts if len(parts) > 1 else None


def traverse(a: Tree, b: Tree, cos: float):
    """(rows of a, rows of b, block of booleans) of all pairs of leaves that may be linked, and nodes linked whole."""
    limit, todo = math.sqrt(2 - 2 * cos), [(0, 0)]
    while todo:
        i, j = np.array([p[0] for p in todo]), np.array([p[1] for p in todo])
        d = chords((a.x[a.center[i]] * b.x[b.center[j]]).sum(1))
        reach = a.radius[i] + b.radius[j]
        nxt = []
        for p, q, apart, r in zip(i.tolist(), j.tolist(), d.tolist(), reach.tolist()):
            if apart - r > limit + SLACK:
                continue
            rows, cols = a.order[a.lo[p] : a.hi[p]], b.order[b.lo[q] : b.hi[q]]
            if apart + r < limit - 1e-7:
                yield rows, cols, None
                continue
            ka, kb = a.kids[p], b.kids[q]
            if not ka and not kb:
                yield rows, cols, a.x[rows] @ b.x[cols].T >= cos
            elif kb and (not ka or b.radius[q] > a.radius[p]):
                nxt += [(p, y) for y in kb]
            else:
                nxt += [(x, q) for x in ka]
        todo = nxt


def block_links(cos: float):
    """For a block and some of its partners: (id, links, root) of every point that has links. Rows of the block itself have side
    0; its partners' have side 1 and their block's number; ``own`` says whether the block is compared with itself as well."""

    def run(rows: pa.Table) -> pa.Table:
        dim = len(rows["vec"][0].as_py()) // 8
        x, ids, count = unit(rows["vec"].to_pylist(), dim), np.asarray(rows["id"]), np.asarray(rows["n"])
        side, partner = np.asarray(rows["side"]), np.asarray(rows["partner"])
        least = math.sqrt(2 - 2 * cos) / 4
        one = np.flatnonzero(side == 0)
        if not len(one):  # hashes may leave a part of a node without points
            return pa.table({"id": ids[one], "links": ids[one], "root": ids[one]})
        ta, links, blocks = Tree(x[one], least), np.zeros(len(ids), np.int64), []
        others = [np.flatnonzero((side == 1) & (partner == k)) for k in np.unique(partner[side == 1])]
        for two in ([one] if rows["own"][0].as_py() else []) + others:
            same = two is one
            for r, c, hit in traverse(ta, ta if same else Tree(x[two], least), cos):
                if hit is None:
                    hit = np.ones((len(r), len(c)), bool)
                if same:
                    hit = hit & (r[:, None] != c[None, :])
                if not hit.any():
                    continue
                r, c = one[r], two[c]
                np.add.at(links, r, hit @ count[c])
                if not same:
                    np.add.at(links, c, count[r] @ hit)
                blocks.append((r, c, hit))
        # labels go back and forth over the links until none falls
        label, big = ids.copy(), np.iinfo(np.int64).max
        while True:
            before = label.copy()
            for r, c, hit in blocks:
                label[r] = np.minimum(label[r], np.where(hit, label[c][None, :], big).min(1))
                label[c] = np.minimum(label[c], np.where(hit, label[r][:, None], big).min(0))
            if (label == before).all():
                break
        keep = links > 0
        return pa.table({"id": ids[keep], "links": links[keep], "root": label[keep]})

    return run


def routed(key, points: pa.Table, centers: pa.Table) -> pa.Table:
    """Points of a node with the number of the nearest of its centres and the distance to it."""
    dim = len(points["vec"][0].as_py()) // 8 if points.num_rows else 1
    child, far = np.zeros(points.num_rows, np.int64), np.full(points.num_rows, 2.0)
    if points.num_rows and centers.num_rows:
        x = unit(points["vec"].to_pylist(), dim)
        p = unit(centers["centers"][0].as_py(), dim)
        for at in range(0, len(x), 1024):
            best = (x[at : at + 1024] @ p.T).argmax(1)
            child[at : at + 1024] = best
            # the plain distance, as the bounds use it
            far[at : at + 1024] = np.sqrt(((x[at : at + 1024] - p[best]) ** 2).sum(1))
    cells = [f"{c}.{k}" for c, k in zip(points["cell"].to_pylist(), child.tolist())]
    return pa.table({"label": points["label"], "cell": pa.array(cells, pa.string()), "id": points["id"], "n": points["n"], "vec": points["vec"], "far": far})


def grow(points: DataFrame, tight: float) -> tuple[DataFrame, DataFrame]:
    """(points in their last nodes, nodes) of the upper levels, both stashed. points: (label, id, n, vec). Nodes: (label, cell, parent,
    center, radius, size, weight, rep, split); the weight adds up the counts n, rep is the smallest id."""
    spark = points.sparkSession
    now = points.select("label", F.lit("0").alias("cell"), "id", "n", "vec", F.lit(2.0).alias("far"))
    centers, done, nodes = None, [], []
    for level in range(LEVELS):
        sized = now.groupBy("label", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("id").alias("rep"))
        split = (F.col("size") > BLOCK) & (F.col("radius") > tight) & F.lit(level < LEVELS - 1)
        sized = stash(sized.withColumn("split", split), "node-sizes")
        # a centre of its own for the root; it covers the whole sphere
        own = sized.join(centers, ["label", "cell"]) if centers is not None else sized.withColumn("center", F.lit(None).cast("binary"))
        nodes.append(stash(own.withColumn("parent", F.substring_index("cell", ".", level) if level else F.lit(None).cast("string")), "nodes"))
        rest = sized.where("split")
        if not rest.count():
            done.append(stash(now.select("label", "cell", "id", "n", "vec"), "node-points"))
            break
        done.append(stash(now.join(sized.where("not split").select("label", "cell"), ["label", "cell"], "left_semi").select("label", "cell", "id", "n", "vec"), "node-points"))
        open_ = now.join(rest.select("label", "cell", "size"), ["label", "cell"])
        # a node's centres are those of its points whose hash is small: about a part for half a block each, within the fan-out
        wanted = F.least(F.lit(FANOUT), F.greatest(F.lit(8), F.ceil(2 * F.col("size") / BLOCK)))
        drawn = open_.where(F.xxhash64(F.lit(level), "id").bitwiseAND((1 << 30) - 1) < wanted * (1 << 30) / F.col("size"))
        drawn = drawn.groupBy("label", "cell").agg(F.array_sort(F.collect_list("vec")).alias("centers"))
        drawn = stash(drawn, "node-centers")
        lots = F.ceil(F.col("size") / LOT)
        dealt = open_.select("label", "cell", "id", "n", "vec", F.pmod(F.xxhash64("id"), lots).alias("lot"))
        beside = drawn.join(rest.select("label", "cell", "size"), ["label", "cell"]).select("label", "cell", "centers", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)).alias("lot"))
        moved = dealt.groupBy("label", "cell", "lot").cogroup(beside.groupBy("label", "cell", "lot")).applyInArrow(routed, "label string, cell string, id long, n long, vec binary, far double")
        before = now
        now = stash(moved, "routed")
        if level:
            drop(before)
        centers = drawn.select("label", "cell", F.posexplode("centers").alias("k", "center")).select("label", F.concat_ws(".", "cell", F.col("k").cast("string")).alias("cell"), "center")
        # a node of which no point was drawn has one part, without a centre; the next level draws again
        centers = stash(centers.union(rest.join(drawn, ["label", "cell"], "left_anti").select("label", F.concat("cell", F.lit(".0")), F.lit(None).cast("binary"))), "centers")
        drop(drawn)
    columns = ["label", "cell", "parent", "center", "radius", "size", "weight", "rep", "split"]
    every, own = nodes[0].select(*columns), done[0]
    for x in nodes[1:]:
        every = every.union(x.select(*columns))
    for x in done[1:]:
        own = own.union(x)
    return own, stash(every, "all-nodes")


def node_pairs(nodes: DataFrame, cos: float) -> tuple[DataFrame, DataFrame]:
    """(label, a, b) of pairs of last nodes that may hold links, a = b among them, and (label, a, b) of pairs of nodes all of whose
    points are linked; a traversal of the upper levels, a level at a time."""
    limit = math.sqrt(2 - 2 * cos)
    # what a node is replaced by: its parts, or itself
    part = F.struct("cell", "radius", "center", "split")
    parts = nodes.where("parent is not null").groupBy("label", F.col("parent").alias("node")).agg(F.collect_list(part).alias("parts"))
    alone = nodes.where("not split").select("label", F.col("cell").alias("node"), F.array(part).alias("parts"))
    fronts = stash(parts.union(alone), "fronts")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                dim = int(r["label"].rsplit("/", 1)[1]) // 8

                def balls(x):
                    # without a centre of its own, a ball is the whole sphere
                    axis = np.eye(1, dim).tobytes()
                    return unit([p["center"] or axis for p in x], dim), np.array([p["radius"] if p["center"] else 2.0 for p in x])

                (ca, ra), (cb, rb) = balls(r["pa"]), balls(r["pb"])
                apart, reach = chords(ca @ cb.T), ra[:, None] + rb[None, :]
                near = apart - reach <= limit + 1e-7
                if r["a"] == r["b"]:
                    near &= np.array([x["cell"] for x in r["pa"]])[:, None] <= np.array([x["cell"] for x in r["pb"]])[None, :]
                whole = near & (apart + reach < limit - 1e-6)
                for i, j in zip(*np.nonzero(near)):
                    x, y = r["pa"][i], r["pb"][j]
                    out.append((r["label"], x["cell"], y["cell"], bool(whole[i, j]), x["split"] or y["split"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()])], ["label", "a", "b", "whole", "more"])

    now = nodes.where("parent is null").select("label", F.col("cell").alias("a"), F.col("cell").alias("b"), F.lit(False).alias("whole"), F.col("split").alias("more"))
    ended, taken = [], []
    for _ in range(LEVELS):
        ended.append(now.where("not whole and not more").select("label", "a", "b"))
        taken.append(now.where("whole").select("label", "a", "b"))
        rest = now.where("more and not whole")
        if rest.isEmpty():
            break
        side = lambda c: fronts.select("label", F.col("node").alias(c), F.col("parts").alias(f"p{c}"))
        now = stash(rest.select("label", "a", "b").join(side("a"), ["label", "a"]).join(side("b"), ["label", "b"]).select("label", "a", "b", "pa", "pb").mapInArrow(expand, "label string, a string, b string, whole boolean, more boolean"), "node-pairs")
    pairs, whole = ended[0], taken[0]
    for x, y in zip(ended[1:], taken[1:]):
        pairs, whole = pairs.union(x), whole.union(y)
    return pairs, whole


def near_duplicates(df: DataFrame, cos: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("v"))
    sound = F.expr("label is not null and vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = np.asarray(b.column(2).flatten()).astype("<f8") + 0.0, np.cumsum([0, *(len(x) for x in b.column(2))])
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([raw[8 * x : 8 * y] for x, y in zip(off, off[1:])], pa.binary())], ["vec_id", "label", "vec"])

    whole_rows = stash(rows.select("vec_id", "label", F.when(sound, F.col("v")).alias("v")), "vectors")
    valid = whole_rows.where("v is not null").mapInArrow(as_bytes, "vec_id long, label string, vec binary")
    valid = stash(valid.select("vec_id", F.concat("label", F.lit("/"), F.octet_length("vec").cast("string")).alias("label"), "vec"), "vector-bytes")
    # equal vectors are one point: its smallest id, and how many there are
    points = stash(valid.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "points")
    placed, nodes = grow(points, math.sqrt(2 - 2 * cos) / 8)
    pairs, whole = node_pairs(nodes, cos)

    # last nodes in blocks; one is larger than a block only where it couldn't be split
    sizes = nodes.where("not split").select("label", "cell", F.ceil(F.col("size") / BLOCK).alias("parts"))
    block = lambda cell, part: F.concat_ws("#", cell, part)
    dealt = placed.join(sizes, ["label", "cell"]).select("label", "id", "n", "vec", block(F.col("cell"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("string")).alias("block"))
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    both = pairs.join(sizes.select("label", F.col("cell").alias("a"), F.col("parts").alias("na")), ["label", "a"]).join(sizes.select("label", F.col("cell").alias("b"), F.col("parts").alias("nb")), ["label", "b"])
    both = both.select("*", span("na").alias("x")).select("*", span("nb").alias("y")).where("a != b or x <= y")
    both = both.select("label", block(F.col("a"), F.col("x").cast("string")).alias("b1"), block(F.col("b"), F.col("y").cast("string")).alias("b2"))
    both = stash(both, "block-pairs")
    lots = both.groupBy("label", "b1").agg(F.ceil(F.count_if(F.col("b1") != F.col("b2")) / PARTNERS).alias("lots"))
    both = both.join(lots, ["label", "b1"]).withColumn("lot", F.when(F.col("b1") == F.col("b2"), 0).otherwise(F.pmod(F.xxhash64("b2"), F.greatest("lots", F.lit(1)))).cast("long"))
    both = stash(both.select("label", "b1", "b2", "lot"), "block-lots")
    own = both.groupBy("label", "b1", "lot").agg(F.max(F.col("b1") == F.col("b2")).alias("own"))
    asked = own.select("label", F.col("b1").alias("at"), "b1", "lot", F.lit(0).alias("side"), F.lit(0).cast("long").alias("partner"), "own")
    asked = asked.union(both.where("b1 != b2").join(own, ["label", "b1", "lot"]).select("label", F.col("b2").alias("at"), "b1", "lot", F.lit(1).alias("side"), F.xxhash64("b2").alias("partner"), "own"))
    sent = dealt.withColumnRenamed("block", "at").join(asked, ["label", "at"])
    found = stash(sent.groupBy("label", "b1", "lot").applyInArrow(block_links(cos), "id long, links long, root long"), "links")
    drop(both)

    # pairs of nodes taken whole: each point of one is linked with all of the other, whichever level they stand on
    if not whole.isEmpty():
        info = nodes.select("label", "cell", "weight", "rep")
        w = whole.join(info.select("label", F.col("cell").alias("a"), F.col("weight").alias("wa"), F.col("rep").alias("ra")), ["label", "a"]).join(info.select("label", F.col("cell").alias("b"), F.col("weight").alias("wb"), F.col("rep").alias("rb")), ["label", "b"])
        w = stash(w, "whole-pairs")
        to = w.select("label", F.col("a").alias("cell"), F.col("wb").alias("more"), (F.col("a") == F.col("b")).alias("self"), F.col("ra").alias("rep")).union(w.where("a != b").select("label", "b", "wa", F.lit(False), "rb"))
        to = stash(to.groupBy("label", "cell").agg(F.sum("more").alias("more"), F.max("self").alias("self"), F.first("rep").alias("rep")), "whole-nodes")
        up = F.expr("transform(sequence(1, size(split(cell, '[.]'))), k -> substring_index(cell, '.', k))")
        meant = placed.select("label", "id", "n", F.explode(up).alias("cell")).join(to, ["label", "cell"])
        meant = meant.select("id", (F.col("more") - F.when(F.col("self"), F.col("n")).otherwise(0)).alias("links"), F.col("rep").alias("root"))
        joined = w.select(F.col("ra").alias("id"), F.lit(0).cast("long").alias("links"), F.col("rb").alias("root"))
        found = stash(found.union(meant).union(joined), "all-links")

    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    copies = valid.join(points.select("label", "vec", "id", "n"), ["label", "vec"]).select("vec_id", "id", "n")
    copies = stash(copies.join(counted, "id", "left").select("vec_id", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "linked")
    drop(valid, points)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(copies.select(F.col("vec_id").alias("a"), F.col("id").alias("b"))).where("a != b"), "vector-roots")
    drop(found)
    linked = copies.join(roots, F.col("id") == F.col("node"), "left").select("vec_id", F.col("links").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    alone = whole_rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), 0.98)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE x = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.x = v.vec_id
"""

"""Suffix-array deduplication by distributed prefix doubling, with unique positions discarded (operator 9).

What is removed: each byte covered by a string of ``length`` bytes that also starts earlier, in a smaller doc_id or
earlier in the same document; overlaps count, and strings are judged on the input.

Method. In prefix doubling a position's rank for 2k bytes comes from the pair of ranks (position, position + k): Spark sorts the
pairs, equal neighbours get one rank, and positions whose rank is unique are left away, until none is left or 2k is past
the threshold. Over all positions each round would shuffle more than a row a byte. So positions are discarded in
coarser units first, by the same sorting of pairs, and single positions are doubled at last:

1. ``length / 4`` bytes. A window of ``length`` bytes is known by its anchor, the position in it whose quarter has the least
   hash; windows with equal text have the same anchor at the same offset. Anchors whose quarter occurs once are
   discarded with all their windows (about 35 positions each).
2. Runs of windows that share an anchor: the pairs (quarter's name, whole run's name) are sorted. A run that isn't the first of
   its class is settled: all its windows repeat. Firsts go on, if their quarter has another class.
3. Runs are cut into pieces of ``PIECE`` windows; the pairs (name of the bytes that all its windows hold, whole piece's name) are
   sorted. Pieces whose common bytes are unique are discarded, later copies of a whole piece are settled.
4. What is left goes on as single positions p with the names of the quarters at p, p + 25, p + 50 and p + 75. Pairs
   of quarters are sorted and ranked, which gives the ranks of 50 bytes; positions with a unique one of the two go. Pairs of
   these ranks are sorted, which gives those of ``length``: a position that isn't the first of its rank is settled.

A name is a 64-bit fingerprint that every task computes for itself; a rank is a class's place in Spark's sort. Pairs are sorted over all
partitions by (pair, position), so that a class of any size, a third of all rows as well, is cut over many tasks; a
partition tells the driver its first and last class, no more, and classes that go on across a border are joined there. Two
different strings get one pair of names with a probability of about 10^-18 for 10^10 positions.

Texts move only at the end, where settled runs meet their texts, whose bytes outside are kept. Each round scans them
again and looks its positions up in a bit table, which may let a few more through; these take part with their true
ranks and change nothing. Beyond ``frequency.MAX_KEYS`` keys, positions are joined to their texts instead, so that the work stays
in proportion to the input. Long texts are scanned in segments.

Defined results: a null text counts as empty; a text shorter than ``length`` loses nothing; a null id comes after all
others; rows that share an id but not the text come in the order of a 128-bit hash of their texts, each cut by its own
runs alone; rows that share both tie, so neither is earlier and both stay; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frequency
from .common import Shared, cores, drop, free_shuffles, in_order, stash, stash_map, stash_slim, table
from .frequency import Packer, Spread, bit_table, mix, repeated
from .ranking import ranked, rerank

PIECE = 8
#: Window starts of a segment; their number must fit into the low bits of an anchor's key.
SEGMENT = 1 << 19
POSITION_BITS = np.uint64(20)
_BASE = 0x9E3779B97F4A7C15 | 1


class Ranks:
    """Fingerprints of the substrings of some bytes: differences of sums of byte values times powers of an odd number."""

    VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int):
        if len(cls._up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_up", _BASE), ("_down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, base & (1 << 64) - 1, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls._up, cls._down

    def __init__(self, data: bytes) -> None:
        up, self.down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.VALUES[np.frombuffer(data, np.uint8)] * up[: len(data)], out=self.sums[1:])

    def of(self, at: np.ndarray, size) -> np.ndarray:
        """Ranks of the strings of the given size (or sizes) at the positions."""
        h = (self.sums[at + size] - self.sums[at]) * self.down[at]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        h = (self.sums[size:] - self.sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def paired(*ranks: np.ndarray) -> np.ndarray:
    return mix(*ranks)


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` consecutive ones, from block-wise running minima."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


class Segment:
    """Part of a text, its windows, and the runs of windows that share an anchor."""

    def __init__(self, data: bytes, offset: int, length: int) -> None:
        self.offset, self.length, quarter = offset, length, length // 4
        self.ranks = Ranks(data)
        short = self.ranks.every(quarter)
        places = np.arange(len(short), dtype=np.uint64)
        least = least_in_windows((short >> POSITION_BITS << POSITION_BITS) | places, length - quarter + 1)
        anchor = (least & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.diff(anchor)) + 1
        self.start = np.concatenate([[0], edge])  # first window of each run
        self.size = np.diff(np.append(self.start, len(anchor)))
        self.anchor = anchor[self.start]
        self.quarter = short[self.anchor]

    def whole(self, pick: np.ndarray) -> np.ndarray:
        """Ranks of the text of whole runs, with their place around the anchor."""
        s, n = self.start[pick], self.size[pick]
        return paired(self.ranks.of(s, n + self.length - 1), (self.anchor[pick] - s) << 10 | n)

    def pieces(self, pick: np.ndarray):
        """(start, size, common, whole) of the pieces of runs."""
        last = self.anchor[pick] - self.start[pick]  # largest distance of a window to the anchor
        first = last - self.size[pick] + 1
        low, high = first // PIECE, last // PIECE
        n = high - low + 1
        run = np.repeat(np.arange(len(pick)), n)
        node = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        a = self.anchor[pick][run]
        x, y = np.maximum(node * PIECE, first[run]), np.minimum(node * PIECE + PIECE - 1, last[run])
        start, size = a - y, y - x + 1
        # bytes that every window of the node holds, as a pair of overlapping halves
        common, half = self.length - PIECE + 1, self.length // 2
        at = a - node * PIECE
        core = paired(self.ranks.of(at, half), self.ranks.of(at + common - half, half), node)
        return start, size, core, paired(self.ranks.of(start, size + self.length - 1), x << 10 | y)

    def singles(self, start: np.ndarray, size: np.ndarray):
        """(position, side, first quarter, last quarter) of both halves of every window of some pieces. Halves and quarters overlap
        where the length isn't a multiple of four."""
        at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        half = -(-self.length // 2)
        quarter = -(-half // 2)
        for side, x in enumerate((at, at + self.length - half)):
            yield at, np.full(len(at), side), self.ranks.of(x, quarter), self.ranks.of(x + half - quarter, quarter)


def segments(texts: Iterator[tuple], length: int) -> Iterator[tuple[int, Segment, np.ndarray | None]]:
    """(key, segment, wanted starts of windows, if the rows list them) of all texts that have a window; consecutive segments
    overlap by a window less a byte."""
    for key, text, *own in texts:
        data = (text or "").encode()
        for lo in range(0, len(data) - length + 1, SEGMENT):
            yield key, Segment(data[lo : lo + SEGMENT + length - 1], lo, length), own[0] if own else None


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            lists = part.column(2) if part.num_columns > 2 else None
            for k, (key, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                yield (key, text) if lists is None else (key, text, np.asarray(lists[k].values))


def scan(docs: DataFrame, length: int, spread: Spread, name: str) -> DataFrame:
    """Packed names of all anchors' quarters; stashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(spread)

        def out(used, data):
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(data, pa.binary())], ["range", "packed"])

        for _, seg, _ in segments(rows_of(batches), length):
            for x in packer.add(seg.quarter):
                yield out(*x)
        yield out(*packer.flush())

    return stash_map(docs, run, "range int, packed binary", name)


class Places:
    """(doc, start) as one number in their order, which sorts best; as a struct where numbers don't reach."""

    def __init__(self, docs: DataFrame) -> None:
        r = docs.agg(F.min("doc"), F.max("doc"), F.max(F.octet_length("text")), F.sum(F.octet_length("text"))).first()
        self.least, self.bits, self.bytes = r[0] or 0, max(1, (r[2] or 0).bit_length()), r[3] or 0
        self.fits = ((r[1] or 0) - self.least + 1).bit_length() + self.bits < 63

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with ``at`` instead of doc and start, if they haven't it yet."""
        return rows if self.fits else rows.select(F.struct("doc", "start").alias("at"), *[c for c in rows.columns if c not in ("doc", "start")])

    def split(self, rows: DataFrame) -> DataFrame:
        """The way back."""
        doc, start = F.col("at.doc"), F.col("at.start")
        if self.fits:
            doc, start = F.shiftright("at", self.bits) + self.least, F.col("at").bitwiseAND((1 << self.bits) - 1)
        return rows.select(doc.alias("doc"), start.alias("start"), *[c for c in rows.columns if c != "at"])

    def schema(self, *rest: str) -> str:
        return ", ".join(f"{c} long" for c in [*(["at"] if self.fits else ["doc", "start"]), *rest])

    def numbers(self, key: int, start: np.ndarray) -> list[np.ndarray]:
        """The columns of places in Python."""
        return [(key - self.least << self.bits) + start] if self.fits else [np.full(len(start), key, np.int64), start]


class Out:
    """Gathers places and columns of numbers, and gives record batches."""

    def __init__(self, places: Places, *names: str, most: int = 100_000) -> None:
        self.places, self.names, self.most, self.parts, self.size = places, [x.split()[0] for x in places.schema(*names).split(", ")], most, [], 0

    def add(self, key: int, start: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(start):
            self.parts.append((*self.places.numbers(key, start), *columns))
            self.size += len(start)
        if self.size >= self.most:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            cols = [np.concatenate(c) for c in zip(*self.parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in cols], self.names)
            self.parts, self.size = [], 0


def place(key: int, at: np.ndarray) -> np.ndarray:
    """What bit tables know positions by."""
    return mix(np.full(len(at), key, np.int64), at)


def runs(docs: DataFrame, length: int, spread: Spread, quarters: DataFrame, places: Places) -> DataFrame:
    """Round 2: (place, size, quarter's name, whole run's name) of anchors that may not be unique; stashed."""
    many = quarters.count() > frequency.MAX_KEYS
    sent = Shared(docs.sparkSession, None if many else bit_table(quarters, "value", hashed=False))
    columns = ("size", "major", "minor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known = Out(places, *columns), sent.value
        for key, seg, _ in segments(rows_of(batches), length):
            pick = np.arange(len(seg.start)) if known is None else np.flatnonzero(known.has(spread.narrowed(seg.quarter)))
            yield from out.add(key, seg.offset + seg.start[pick], seg.size[pick], seg.quarter[pick], seg.whole(pick))
        yield from out.end()

    if many:
        rows = docs.mapInArrow(run, places.schema(*columns))
        rows = stash(rows.join(quarters, F.shiftrightunsigned("major", 64 - spread.bits) == F.col("value"), "left_semi"), "suffix-runs")
    else:
        rows = stash_map(docs, run, places.schema(*columns), "suffix-runs")
    sent.drop()
    return rows


class Picked:
    """Documents with the places that a round goes on with: in bit tables, or listed beside the texts where those are too many."""

    def __init__(self, docs: DataFrame, places: Places, *left: DataFrame) -> None:
        rows = [places.split(x).select("doc", "start") for x in left]
        self.listed = any(x.count() > frequency.MAX_KEYS for x in left)
        if self.listed:
            lists = rows[-1].groupBy("doc").agg(F.array_sort(F.collect_list("start")).alias("starts"))
            self.docs, tables = docs.join(lists, "doc").select("doc", "text", "starts"), None
        else:
            self.docs, tables = docs, (bit_table(rows[0].select("doc").distinct(), "doc"), *[bit_table(x, "doc", "start") for x in rows])
        self.sent = Shared(docs.sparkSession, tables)

    def map(self, run, length: int, places: Places, columns: tuple[str, ...], name: str) -> DataFrame:
        """run(key, segment, has, out) over each segment with such places; has(starts, nth) tells the nth round's from others; stashed."""
        sent = self.sent

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, out = sent.value, Out(places, *columns)

            def texts():
                for b in batches:
                    if tables is not None:
                        b = b.filter(pa.array(tables[0].has(mix(np.asarray(b.column(0)).astype(np.int64)))))
                    yield from rows_of([b])

            for key, seg, own in segments(texts(), length):
                # lists hold the last round's places; those of rounds before follow from them
                has = (lambda x, nth, key=key: tables[nth].has(place(key, x))) if own is None else (lambda x, nth, own=own: np.isin(x, own))
                yield from run(key, seg, has, out)
            yield from out.end()

        done = stash_map(self.docs, go, places.schema(*columns), name)
        sent.drop()
        return done


def pieces(picked: Picked, length: int, places: Places) -> DataFrame:
    """Round 3: (place, size, name of the common bytes, whole piece's name)."""

    def run(key, seg, has, out):
        pick = np.flatnonzero(has(seg.offset + seg.start, 1))
        if len(pick):
            start, size, core, whole = seg.pieces(pick)
            yield from out.add(key, seg.offset + start, size, core, whole)

    return picked.map(run, length, places, ("size", "major", "minor"), "suffix-pieces")


def singles(picked: Picked, length: int, places: Places) -> DataFrame:
    """Round 4: (place, side, names of two quarters) of both halves of single positions."""
    listed = picked.listed

    def run(key, seg, has, out):
        pick = np.arange(len(seg.start)) if listed else np.flatnonzero(has(seg.offset + seg.start, 1))
        if len(pick):
            start, size, _, _ = seg.pieces(pick)
            keep = has(seg.offset + start, 2)
            if keep.any():
                for at, *rest in seg.singles(start[keep], size[keep]):
                    yield from out.add(key, seg.offset + at, *rest)

    return picked.map(run, length, places, ("side", "major", "minor"), "suffix-singles")


def covered(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, start, size): runs of windows that occur earlier as well. docs: (doc, text), a row for each doc, none null."""
    places = Places(docs)
    spread = Spread.of(places.bytes // 30, cores(docs.sparkSession))
    packed = scan(docs, length, spread, "suffix-scan")
    quarters = stash(repeated(packed), "suffix-quarters")
    drop(packed)

    rows = runs(docs, length, spread, quarters, places)
    one, in_runs = rerank(places.of(rows), "suffix-runs")
    drop(quarters, rows)
    rows = pieces(Picked(docs, places, in_runs), length, places)
    two, in_pieces = rerank(places.of(rows), "suffix-pieces")
    drop(rows)
    rows = singles(Picked(docs, places, in_runs, in_pieces), length, places)
    drop(in_runs, in_pieces)

    # doubling: ranks of halves from pairs of quarters, then those of whole windows from pairs of halves
    halves = ranked(places.of(rows), "suffix-halves")
    drop(rows)
    rank = lambda side: F.max(F.when(F.col("side") == side, F.col("rank")))
    pairs = halves.groupBy("at").agg(rank(0).alias("major"), rank(1).alias("minor")).where("major is not null and minor is not null")
    pairs = stash_slim(pairs.select("at", F.lit(1).cast("long").alias("size"), "major", "minor"), "suffix-pairs")
    drop(halves)
    three, left = rerank(pairs, "suffix-windows")
    drop(pairs, left)
    free_shuffles(docs.sparkSession)
    return places.split(one.union(two).union(three))


def dedup(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, kept_text) and the columns in carry, which pass by unread: spans hold (start, end) of the maximal removed runs of bytes, kept the bytes
    outside; kept_text is their text, without characters that a run cuts in two."""
    if length < 16 or length > 900:
        raise ValueError("length must be from 16 to 900 bytes")
    extra = [(c, k) for c, k in df.dtypes if c in carry]
    carried = [F.col(f"`{c}`").alias(f"carried{i}") for i, (c, _) in enumerate(extra)]
    docs, unique = in_order(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried))
    docs = docs.withColumnRenamed("key", "doc")
    texts = docs.select("doc", "text")
    by_doc = stash_slim(covered(texts if unique else stash_slim(texts.dropDuplicates(["doc"]), "suffix-texts"), length).groupBy("doc").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("size") + length - 1).alias("end"))).alias("runs")), "suffix-by-doc")
    met = docs.join(by_doc, "doc", "left").select("doc_id", "text", "runs", *[f"carried{i}" for i in range(len(extra))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts, lists = part.column(1).to_pylist(), part.column(2)
                spans, kept, clean = [], [], []
                for k, text in enumerate(texts):
                    data, own = (text or "").encode(), lists[k]
                    merged: list[list[int]] = []
                    if own.is_valid:
                        flat = own.values
                        start, end = np.asarray(flat.field(0)), np.minimum(np.asarray(flat.field(1)), len(data))
                        order = np.argsort(start, kind="stable")
                        start, end = start[order], np.maximum.accumulate(end[order])
                        head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                        tail = np.append(head[1:] - 1, len(end) - 1)
                        merged = [[x, y] for x, y in zip(start[head].tolist(), end[tail].tolist()) if x < y]
                    at, rest = 0, []
                    for x, y in merged:
                        rest.append(data[at:x])
                        at = y
                    spans.append([{"start": x, "end": y} for x, y in merged])
                    rest.append(data[at:])
                    kept.append(b"".join(rest))
                    # piece by piece, as halves of different characters could make another one
                    clean.append("".join(x.decode("utf-8", "ignore") for x in rest) if merged else text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(clean, pa.string()), *part.columns[3:]],
                    ["doc_id", "n_bytes", "spans", "kept", "kept_text", *[c for c, _ in extra]],
                )

    return met.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_text string" + "".join(f", `{c}` {k}" for c, k in extra))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents", "doc_id", "text"), 100)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
hexed AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM doc),
win AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM hexed WHERE n >= 100)),
firsts AS (SELECT s, min(struct_pack(d := doc_id, p := i)) AS f FROM win GROUP BY s HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE doc_id > f.d OR i > f.p),
edges AS (
  SELECT doc_id, i, CASE WHEN i <= max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM later),
spans AS (
  SELECT doc_id, min(i) AS x, max(i) + 100 AS y
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edges) GROUP BY doc_id, g),
parts AS (
  SELECT doc_id, x, y, coalesce(lag(y) OVER (PARTITION BY doc_id ORDER BY x), 0) AS before FROM spans),
kept AS (
  SELECT p.doc_id, sum(y - x) AS removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (x - before)), '' ORDER BY x) || substr(any_value(h), 2 * max(y) + 1) AS rest
  FROM parts p JOIN hexed USING (doc_id) GROUP BY p.doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM hexed h LEFT JOIN kept USING (doc_id)
"""

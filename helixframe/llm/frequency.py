"""Which 64-bit values occur more than once in the corpus, found with few bytes a value, and bit tables of bounded size.

A task sorts its values, cuts them to some leading bits, deals them into ranges of the value space and sends each range as one
row of packed differences, about three bytes a value instead of a row each. A range's rows meet in one task, which
merges them and keeps the values seen at least twice. Two different values may share their leading bits, so that a value may
be taken for a repeated one; the other way round it never errs. Callers use the answer to leave away only what is
certainly alone. How many bits and ranges there are follows from the number of values (``Spread``), so that neither the share
of false answers nor a range's size grows with the input.

A bit table holds such values (or row keys) for a look-up in Python workers. It has 16 bits a key, up to ``MAX_BITS`` (16 MB). With
``MAX_KEYS`` keys it lets two of five other rows through; callers use none for more keys than that, but join, which shuffles
more and has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Packed bytes of a range that meet in a task.
RANGE_BYTES = 32 << 20
MOST_RANGES = 1 << 18
#: How often a task reports one value at most. Levels of frequency above it look alike to one task, not to the whole.
REPEATS = 256
MAX_BITS = 1 << 27
MIN_BITS = 1 << 16
MAX_KEYS = MAX_BITS // 2
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of integers (the finaliser of splitmix64, chained)."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) + _MIX[0]
        h = (h ^ (h >> np.uint64(30))) * _MIX[1]
        h = (h ^ (h >> np.uint64(27))) * _MIX[2]
        h ^= h >> np.uint64(31)
    return h


class Spread(NamedTuple):
    """How many ranges values are dealt to, and how many of their bits count."""

    ranges: int
    bits: int

    @classmethod
    def of(cls, values: int, cores: int) -> Spread:
        """For so many values in all: a value is taken for another with a probability of 1 / 4096 at most, as long as 60 bits do."""
        return cls(min(MOST_RANGES, max(4 * cores, values * 8 // RANGE_BYTES)), min(60, max(40, int(values).bit_length() + 12)))

    def narrowed(self, values: np.ndarray) -> np.ndarray:
        return values >> np.uint64(64 - self.bits)


def pack(values: np.ndarray) -> bytes:
    """Sorted values as a first one and differences of as few bytes as the largest needs."""
    step = np.diff(values)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return bytes([width]) + values[:1].astype("<u8").tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width, step = data[0], np.frombuffer(data, np.uint8, offset=9)
    wide = np.zeros((len(step) // width, 8), np.uint8)
    wide[:, :width] = step.reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 1), wide.view("<u8").ravel()]), dtype=np.uint64)


class Packer:
    """Gathers a task's values and gives (range, packed) rows, every ``most`` values and at the end."""

    def __init__(self, spread: Spread, most: int = 2_000_000) -> None:
        self.spread, self.most, self.parts, self.size = spread, max(most, 16 * spread.ranges), [], 0

    def add(self, values: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
        self.parts.append(self.spread.narrowed(values))
        self.size += len(values)
        if self.size >= self.most:
            yield self.flush()

    def flush(self) -> tuple[list[int], list[bytes]]:
        v = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        self.parts, self.size = [], 0
        if not len(v):
            return [], []
        v.sort()
        if (v[REPEATS:] == v[:-REPEATS]).any():
            v = v[np.concatenate([np.ones(min(REPEATS, len(v)), bool), v[REPEATS:] != v[:-REPEATS]])]
        edges = np.searchsorted(v, np.array([-(-(r << self.spread.bits) // self.spread.ranges) for r in range(self.spread.ranges + 1)], np.uint64))
        used = np.flatnonzero(np.diff(edges))
        return used.tolist(), [pack(v[edges[r] : edges[r + 1]]) for r in used]


def repeated(packed: DataFrame) -> DataFrame:
    """(value, n) of the values that (range int, packed binary) rows hold at least twice."""

    def merge(t: pa.Table) -> pa.Table:
        v = np.sort(np.concatenate([unpack(x) for x in t["packed"].to_pylist()]))
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.diff(np.append(first, len(v)))
        return pa.table({"value": v[first[n > 1]].astype(np.int64), "n": n[n > 1].astype(np.int64)})

    return packed.select("range", "packed").groupBy("range").applyInArrow(merge, "value long, n long")


class BitTable:
    """Keys of which it says for certain that they aren't in it."""

    def __init__(self, bits: int, words: np.ndarray, filled: np.ndarray) -> None:
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits >> 6, np.uint64)
        self.words[words] = filled

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def bit_table(rows: DataFrame, *columns: str, hashed: bool = True, bits_per_key: int = 16, max_bits: int = MAX_BITS) -> BitTable:
    """A table of the keys in integer columns. hashed: look it up by mix() of the columns, else by the one column itself.

    Tasks set their own bits first; the driver gets a word for each 64 bits, so max_bits bounds it."""
    n = rows.count()
    bits = MIN_BITS
    while bits < min(max_bits, n * bits_per_key):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            if b.num_rows:
                cols = [np.asarray(b.column(i)).astype(np.int64) for i in range(len(columns))]
                at = (mix(*cols) if hashed else cols[0].astype(np.uint64)) & np.uint64(bits - 1)
                own = np.zeros(bits >> 6, np.uint64) if own is None else own
                np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        if own is not None:
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(own[used].view(np.int64))], ["word", "bits"])

    clean = rows.select(*[F.col(c).cast("long").alias(f"k{i}") for i, c in enumerate(columns)]).na.drop()
    got = clean.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return BitTable(bits, np.asarray(got["word"]).astype(np.int64), np.asarray(got["bits"]).astype(np.int64).view(np.uint64))

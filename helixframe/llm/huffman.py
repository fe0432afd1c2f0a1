"""Canonical, length-limited Huffman coding of integer symbols, in numpy.

Code lengths come from package-merge, so they are the best ones under the limit. A stream is cut into lanes of ``STEP``
symbols; the bit offset of each lane's start is a checkpoint. Lanes decode on their own, all of them together in one
table look-up per step.
"""

from __future__ import annotations

import numpy as np

LIMIT = 16
STEP = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The code length of each symbol, 0 where its count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)  # sums of counts stay exact up to 2**53
    n, row, levels = len(leaves), leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        levels.append(at < n)
    lengths, need = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:need].sum())
        lengths[:k] += 1
        need = 2 * (need - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by length and number, their codes): codes of a length are consecutive."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    width = lengths[order].astype(np.int64)
    step = np.left_shift(np.int64(1), 62 - width)
    first = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.int64) if len(order) else step
    return order, np.right_shift(first, 62 - width)


class Coder:
    """Encodes and decodes with the code that the lengths define."""

    def __init__(self, lengths: np.ndarray) -> None:
        order, codes = canonical(lengths)
        self.length = lengths.astype(np.int64)
        self.code = np.zeros(len(lengths), np.uint64)
        self.code[order] = codes.astype(np.uint64)
        reach = np.left_shift(1, LIMIT - self.length[order]) if len(order) else np.zeros(0, np.int64)
        self.symbol = np.zeros(1 << LIMIT, np.uint32)
        self.width = np.ones(1 << LIMIT, np.uint8)
        self.symbol[: reach.sum()] = np.repeat(order, reach)
        self.width[: reach.sum()] = np.repeat(lengths[order], reach)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, most significant first, in whole 32-bit words; bit offset of every STEP-th symbol)."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        width = self.length[ids]
        if not width.all():
            raise ValueError("a symbol has no code")
        end = np.cumsum(width)
        at = end - width
        word, value = at >> 5, self.code[ids] << (64 - width - (at & 31)).astype(np.uint64)
        out = np.zeros((int(end[-1]) >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out[: (int(end[-1]) + 31) >> 5].astype(">u4").tobytes(), at[::STEP]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n symbols of a block; lanes start at the checkpoints."""
        if not n:
            return np.zeros(0, np.uint32)
        data = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
        at, lanes = checkpoints.astype(np.int64), len(checkpoints)
        out = np.empty((STEP, lanes), np.uint32)
        last = len(data) - 3
        for k in range(STEP):
            i = np.minimum(at >> 3, last)
            window = (data[i] << 16) | (data[i + 1] << 8) | data[i + 2]
            code = (window >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
            out[k] = self.symbol[code]
            at += self.width[code]
        return out.T.reshape(-1)[:n]

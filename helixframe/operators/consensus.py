"""Heuristic consensus of clusters: longest representative, or a greedy fold of overlap merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import sequences as S

_N = ord("N")


def overlap_identity(left: np.ndarray, right: np.ndarray) -> float:
    """Share of equal bases among the positions where neither is N; 0 if there is none."""
    known = (left != _N) & (right != _N)
    n = int(known.sum())
    return int(((left == right) & known).sum()) / n if n else 0.0


def resolved(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The known base where one is N; N where two bases differ."""
    out = np.where(left == _N, right, left)
    out[(left != right) & (left != _N) & (right != _N)] = _N
    return out


def _equal_at_ends(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """For each n up to m, at how many places both of a's last n and b's first n flags hold."""
    size = 1 << int(2 * m - 1).bit_length()
    # the end of a, turned around, times b: places n - 1 of the product are overlaps of n
    got = np.fft.irfft(np.conj(np.fft.rfft(b[:m].astype(np.float64), size)) * np.fft.rfft(a[len(a) - m :].astype(np.float64), size), size)
    return np.rint(got[:m][::-1]).astype(np.int64)  # a shift of s leaves an overlap of m - s


def _onto(a: np.ndarray, b: np.ndarray, min_overlap: int, min_identity: float):
    """The longest overlap of a's end with b's start that is similar enough, merged; None if there is none.

    Equal bases are counted for all overlaps at once, a letter at a time, as the product of two transformed sequences."""
    m = min(len(a), len(b))
    if m < min_overlap:
        return None
    end, start = a[len(a) - m :], b[:m]
    known = _equal_at_ends(end != _N, start != _N, m)
    same = np.zeros(m, np.int64)
    for letter in np.intersect1d(end, start):
        if letter != _N:
            same += _equal_at_ends(end == letter, start == letter, m)
    fits = np.where(known > 0, same / np.maximum(known, 1), 0.0) >= min_identity
    fits[: min_overlap - 1] = False
    if not fits.any():
        return None
    n = m - int(fits[::-1].argmax())
    return np.concatenate([a[: len(a) - n], resolved(a[len(a) - n :], b[:n]), b[n:]])


def merge(a: str, b: str, min_overlap: int, min_identity: float) -> str | None:
    """a's end on b's start, or else b's end on a's start."""
    if min_overlap < 1:
        raise ValueError("min_overlap must be at least 1")
    # code points, so that any letter keeps its place
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    got = _onto(x, y, min_overlap, min_identity)
    got = _onto(y, x, min_overlap, min_identity) if got is None else got
    return None if got is None else got.astype("<u4").tobytes().decode("utf-32-le")


def fold(sequences: list[str], method: str, min_overlap: int, min_identity: float, max_n_frac: float) -> tuple[str, str, str]:
    """(consensus, status, note) of a cluster's sequences in member order."""
    ordered = sorted(sequences, key=len, reverse=True)
    consensus, merged = ordered[0], False
    if method == "simple":
        status, note = "ok", "representative_longest"
    else:
        tried: set[str] = set()  # what left the consensus as it is would leave it again
        for s in ordered[1:]:
            if s in tried:
                continue
            got = merge(consensus, s, min_overlap, min_identity)
            merged = merged or got is not None
            if got is None or got == consensus:
                tried.add(s)
            else:
                consensus, tried = got, set()
        status, note = ("ok", "") if merged or len(ordered) == 1 else ("failed", "insufficient_overlap")
    if (consensus.count("N") / len(consensus) if consensus else 1.0) > max_n_frac:
        return consensus, "low_quality", "high_N_fraction"
    return consensus, status, note


def build(clusters: DataFrame, sequences: DataFrame, method: str = config.Consensus.method, min_cluster_size: int = config.Consensus.min_cluster_size, min_overlap: int = config.Consensus.min_overlap, min_identity: float = config.Consensus.min_identity, max_n_frac: float = config.Consensus.max_n_frac, lookup: DataFrame | None = None) -> DataFrame:
    """(cluster_id, size, organism, sequence, length, n_count, n_frac, gc_percent, status, note) of each attempted cluster;
    sequence is null if no member's was found. sequences: (idx, record_id, sequence); of equal ids the last counts.

    The longest representative needs no Python: it is the maximum by length, then by place. A fold depends on its order, so a
    cluster's sequences meet in one task for the kmer method."""
    if method not in ("simple", "kmer"):
        raise ValueError("method must be simple or kmer")
    known = sequences.groupBy("record_id").agg(F.max_by("sequence", "idx").alias("sequence")).where("sequence != ''")
    tried = clusters.where(F.size("members") >= min_cluster_size)
    # a header's organism comes from metadata only where the cluster has none
    member = tried.select("cluster_id", F.posexplode("members").alias("pos", "m")).select("cluster_id", "pos", F.col("m.record_id").alias("record_id"))
    found = member.join(known, "record_id")
    if method == "simple":
        best = found.groupBy("cluster_id").agg(F.max_by("sequence", F.struct(F.length("sequence"), -F.col("pos"))).alias("sequence"))
        share = F.when(F.length("sequence") > 0, S.count_of(F.col("sequence"), "N") / F.length("sequence")).otherwise(1.0)
        poor = share > max_n_frac
        made = best.select("cluster_id", "sequence", F.when(poor, "low_quality").otherwise("ok").alias("status"), F.when(poor, "high_N_fraction").otherwise("representative_longest").alias("note"))
    else:

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            seqs = rows.sort_values("pos")["sequence"].tolist()
            return pd.DataFrame([(rows["cluster_id"].iloc[0], *fold(seqs, method, min_overlap, min_identity, max_n_frac))], columns=["cluster_id", "sequence", "status", "note"])

        made = found.select("cluster_id", "pos", "sequence").groupBy("cluster_id").applyInPandas(run, "cluster_id string, sequence string, status string, note string")
    organism = tried.select("cluster_id", F.size("members").cast("long").alias("size"), F.nullif("dominant_organism", F.lit("")).alias("organism"))
    if lookup is not None:
        named = member.join(lookup.where("organism != ''").withColumnRenamed("key", "record_id"), "record_id").groupBy("cluster_id", "organism").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
        mode = named.groupBy("cluster_id").agg(F.max_by("organism", F.struct("n", -F.col("first"))).alias("mode"))
        organism = organism.join(mode, "cluster_id", "left").select("cluster_id", "size", F.coalesce("organism", "mode").alias("organism"))
    out = organism.join(made, "cluster_id", "left")
    text = F.coalesce("sequence", F.lit(""))
    return out.select(
        "cluster_id", "size", F.coalesce("organism", F.lit("UNKNOWN")).alias("organism"), "sequence", F.length(text).cast("long").alias("length"), S.count_of(text, "N").alias("n_count"), S.consensus_n_frac(text).alias("n_frac"), S.consensus_gc_percent(text).alias("gc_percent"),
        F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("note", F.lit("no_sequences")).alias("note"),
    )


def counters(clusters: DataFrame, built: DataFrame) -> DataFrame:
    """One row: total, attempted, ok (low quality included), failed."""
    done = built.agg(F.count("*").alias("attempted"), F.count_if(F.col("status") != "failed").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))
    return clusters.agg(F.count("*").alias("total")).crossJoin(done)

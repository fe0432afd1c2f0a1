"""Default settings of every stage."""

from __future__ import annotations

from dataclasses import dataclass

# The settings and file names that users of the stages rely on.
RAW_DIR = "data/raw"
CACHE_DIR = "data/cache"
FILTERED_DIR = "data/filtered"
MOTIF_DIR = "data/motifs"
CLUSTER_DIR = "data/clusters"
CONSENSUS_DIR = "data/consensus"
BLAST_DIR = "data/blast"
EXPORT_DIR = "data/exports"

ALPHABETS = ("DNA", "RNA", "AUTO")


@dataclass(frozen=True)
class Fetch:
    limit: int = 200
    db: str = "nuccore"
    rettype: str = "fasta"
    retmode: str = "text"
    tool: str = "helixframe"
    sleep: float = 0.34
    sleep_with_key: float = 0.1
    timeout: int = 30
    retries: int = 3
    batch_size: int = 100
    page_size: int = 500


@dataclass(frozen=True)
class Filter:
    min_len: int = 200
    max_n_frac: float = 0.05
    alphabet: str = "AUTO"
    max_per_organism: int = 0


@dataclass(frozen=True)
class Motifs:
    k: int = 9
    top: int = 200
    min_count: int = 1


@dataclass(frozen=True)
class Cluster:
    k: int = 9
    min_similarity: float = 0.35
    max_pairs: int = 200_000


@dataclass(frozen=True)
class Consensus:
    min_cluster_size: int = 2
    method: str = "kmer"
    k: int = 9
    min_overlap: int = 80
    min_identity: float = 0.97
    max_n_frac: float = 0.05


@dataclass(frozen=True)
class Blast:
    program: str = "blastn"
    db: str = "nt"
    format: str = "JSON2"
    max_hits: int = 10
    poll_seconds: float = 10
    timeout_seconds: int = 600
    rate_limit_seconds: float = 1.0


def check_alphabet(alphabet: str) -> str:
    if alphabet.upper() not in ALPHABETS:
        raise ValueError(f"alphabet must be one of {', '.join(ALPHABETS)}, not {alphabet!r}")
    return alphabet.upper()


def check_k(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def canonical_applies(canonical: bool, alphabet: str) -> bool:
    """Reverse complements are folded for DNA only."""
    return canonical and alphabet.upper() != "RNA"

"""Command line. ``python -m helixframe.cli`` has the stages; ``blast2`` and ``export`` are those of the second dialect."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from dataclasses import replace
from pathlib import Path

from . import __version__, config
from .sources import env

log = logging.getLogger("helixframe")


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("helixframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe", description="Nucleotide-sequence analytics on Spark.")
    top.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    top.add_argument("--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", metavar="command")

    def command(name: str, run, about: str):
        p = sub.add_parser(name, help=about, description=about)
        p.set_defaults(run=run)
        return p

    def n_and_alphabet(p):
        p.add_argument("--ignore-N", dest="ignore_n", action="store_true", default=True)
        p.add_argument("--allow-N", dest="ignore_n", action="store_false")
        p.add_argument("--canonical", action="store_true")
        p.add_argument("--alphabet", choices=config.ALPHABETS, default="AUTO")

    p, d = command("fetch", _fetch, "Search and download sequences and metadata."), config.Fetch()
    p.add_argument("--query", required=True)
    p.add_argument("--limit", type=int, default=d.limit)
    p.add_argument("--out-dir", default=config.RAW_DIR)
    p.add_argument("--cache-dir", default=config.CACHE_DIR)
    for name in ("db", "rettype", "retmode", "tool"):
        p.add_argument(f"--{name}", default=getattr(d, name))
    p.add_argument("--email")
    p.add_argument("--api-key")
    p.add_argument("--sleep", type=float)
    p.add_argument("--timeout", type=int, default=d.timeout)
    p.add_argument("--retries", type=int, default=d.retries)

    p, d = command("filter", _filter, "Filter records by quality."), config.Filter()
    p.add_argument("--in-fasta", required=True)
    p.add_argument("--out-dir", default=config.FILTERED_DIR)
    p.add_argument("--min-len", type=int, default=d.min_len)
    p.add_argument("--max-n-frac", type=float, default=d.max_n_frac)
    p.add_argument("--alphabet", choices=config.ALPHABETS, default=d.alphabet)
    p.add_argument("--dedupe", action="store_true")
    p.add_argument("--in-metadata")
    p.add_argument("--write-report", dest="write_report", action="store_true", default=True)
    p.add_argument("--no-report", dest="write_report", action="store_false")
    p.add_argument("--max-per-organism", type=int, default=d.max_per_organism)

    p, d = command("motifs", _motifs, "Count k-mers."), config.Motifs()
    p.add_argument("--in-fasta", required=True)
    p.add_argument("--out-dir", default=config.MOTIF_DIR)
    p.add_argument("--k", type=int, default=d.k)
    p.add_argument("--top", type=int, default=d.top)
    p.add_argument("--min-count", type=int, default=d.min_count)
    p.add_argument("--per-record", dest="per_record", action="store_true", default=True)
    p.add_argument("--no-per-record", dest="per_record", action="store_false")
    n_and_alphabet(p)

    p, d = command("cluster", _cluster, "Cluster records by k-mer similarity."), config.Cluster()
    p.add_argument("--in-fasta", required=True)
    p.add_argument("--out-dir", default=config.CLUSTER_DIR)
    p.add_argument("--k", type=int, default=d.k)
    p.add_argument("--min-sim", type=float, default=d.min_similarity)
    p.add_argument("--max-pairs", type=int, default=d.max_pairs)
    p.add_argument("--in-metadata")
    n_and_alphabet(p)

    p, d = command("consensus", _consensus, "Build consensus sequences of clusters."), config.Consensus()
    p.add_argument("--clusters", required=True)
    p.add_argument("--in-fasta", required=True)
    p.add_argument("--out-dir", default=config.CONSENSUS_DIR)
    p.add_argument("--min-cluster-size", type=int, default=d.min_cluster_size)
    p.add_argument("--method", choices=["simple", "kmer"], default=d.method)
    p.add_argument("--k", type=int, default=d.k)
    p.add_argument("--min-overlap", type=int, default=d.min_overlap)
    p.add_argument("--min-identity", type=float, default=d.min_identity)
    p.add_argument("--max-n-frac", type=float, default=d.max_n_frac)
    p.add_argument("--canonical", dest="canonical", action="store_true", default=True)
    p.add_argument("--no-canonical", dest="canonical", action="store_false")
    p.add_argument("--in-metadata")

    for name, run, formats in (("blast", _blast, ["JSON2", "Tabular", "XML"]), ("blast2", _blast2, ["JSON2", "TABULAR", "XML"])):
        p, d = command(name, run, "Align sequences remotely."), config.Blast()
        p.add_argument("--in-fasta", required=name == "blast2")
        p.add_argument("--out-dir", default=config.BLAST_DIR)
        p.add_argument("--program")
        p.add_argument("--db")
        p.add_argument("--format", choices=formats, default=d.format, **({"type": str.upper} if name == "blast2" else {}))
        p.add_argument("--max-hits", type=int, default=d.max_hits)
        p.add_argument("--poll-seconds", type=float, default=d.poll_seconds)
        p.add_argument("--timeout-seconds", type=int, default=d.timeout_seconds)
        p.add_argument("--rate-limit-seconds", type=float, default=d.rate_limit_seconds)
        p.add_argument("--cache-dir", default=None if name == "blast" else f"{config.CACHE_DIR}/blast")

    p = command("export", _export, "Write feature tables with metadata as Parquet.")
    p.add_argument("--features-csv", default=f"{config.FILTERED_DIR}/filtered_features.csv")
    p.add_argument("--metadata-jsonl", default=f"{config.RAW_DIR}/metadata.jsonl")
    p.add_argument("--motifs-by-record-csv")
    p.add_argument("--out-dir", default=config.EXPORT_DIR)
    return top


def _there(*paths) -> None:
    for p in paths:
        if p and "://" not in str(p) and not Path(p).exists():
            raise FileNotFoundError(f"no such file: {p}")


def _fetch(a, transport=None) -> int:
    from .plans import stages
    from .sources import remote

    email, key = a.email or os.environ.get("NCBI_EMAIL"), a.api_key or os.environ.get("NCBI_API_KEY")
    d = config.Fetch()
    wait = a.sleep if a.sleep is not None else d.sleep_with_key if key else d.sleep
    s = replace(d, db=a.db, rettype=a.rettype, retmode=a.retmode, tool=a.tool, sleep=wait, sleep_with_key=wait, timeout=a.timeout, retries=a.retries)
    stages.fetch(remote.Entrez(s, email, key, a.cache_dir, transport or remote.http), None, a.query, a.limit, a.out_dir)
    return 0


def _filter(a) -> int:
    from .plans import stages

    _there(a.in_fasta, a.in_metadata)
    stages.filter_records(session(), a.in_fasta, a.out_dir, a.min_len, a.max_n_frac, a.alphabet, a.dedupe, a.max_per_organism, a.in_metadata, a.write_report)
    return 0


def _motifs(a) -> int:
    from .plans import stages

    _there(a.in_fasta)
    stages.motifs(session(), a.in_fasta, a.out_dir, a.k, a.top, a.min_count, a.ignore_n, a.canonical, a.per_record, a.alphabet)
    return 0


def _cluster(a) -> int:
    from .plans import stages

    _there(a.in_fasta, a.in_metadata)
    stages.cluster(session(), a.in_fasta, a.out_dir, a.k, a.min_sim, a.ignore_n, a.canonical, a.alphabet, a.max_pairs, a.in_metadata)
    return 0


def _consensus(a) -> int:
    from .plans import stages

    _there(a.clusters, a.in_fasta, a.in_metadata)
    stages.consensus(session(), a.clusters, a.in_fasta, a.out_dir, a.method, a.k, a.min_cluster_size, a.min_overlap, a.min_identity, a.max_n_frac, a.canonical, a.in_metadata)
    return 0


def _blast(a, transport=None) -> int:
    """0 also where queries fail; 1 without an email address."""
    from .plans import stages
    from .sources import remote

    default = Path(config.CONSENSUS_DIR) / "consensus.fasta"
    source = a.in_fasta or (default if default.exists() else Path(config.FILTERED_DIR) / "filtered_sequences.fasta")
    _there(source)
    if not (email := os.environ.get("NCBI_EMAIL")):
        log.error("NCBI_EMAIL must be set for submissions")
        return 1
    d = config.Blast()
    jobs = remote.AlignmentJobs(email, os.environ.get("NCBI_TOOL") or "helixframe", os.environ.get("NCBI_API_KEY"), transport or remote.http, a.timeout_seconds)
    stages.blast(session(), jobs, source, a.out_dir, a.program or os.environ.get("BLAST_PROGRAM") or d.program, a.db or os.environ.get("BLAST_DB") or d.db, a.format, a.max_hits, a.poll_seconds, a.timeout_seconds, a.rate_limit_seconds, a.cache_dir)
    return 0


def _blast2(a, transport=None) -> int:
    """1 if any query failed."""
    from .plans import stages
    from .sources import remote

    s, d = env.remote(), config.Blast()
    if missing := [x for x in s.missing() if x in ("NCBI_EMAIL", "NCBI_TOOL")]:
        raise SystemExit(f"these must be set: {', '.join(missing)}")
    jobs = remote.ThrottledJobs(s.ncbi_email, s.ncbi_tool, s.ncbi_api_key, a.rate_limit_seconds, transport or remote.http)
    done = stages.blast_throttled(session(), jobs, a.in_fasta, a.out_dir, (a.program or s.blast_program or d.program).lower(), a.db or s.blast_db or d.db, a.format, a.max_hits, a.poll_seconds, a.timeout_seconds, a.cache_dir, s)
    return int(done["failed"] > 0)


def _export(a) -> int:
    """2 for a missing file, 1 for other failures."""
    from .plans import stages

    try:
        stages.export(session(), a.features_csv, a.metadata_jsonl, a.out_dir, a.motifs_by_record_csv)
    except FileNotFoundError as e:
        log.error("%s", e)
        return 2
    return 0


def main(argv: list[str] | None = None) -> int:
    env.load()
    top = parser()
    a = top.parse_args(argv)
    if not a.command:
        top.print_help()
        return 0
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(asctime)s | %(levelname)s | %(message)s")
    try:
        return a.run(a)
    except FileNotFoundError as e:
        log.error("%s", e)
    except Exception:
        log.exception("%s failed", a.command)
    return 1


if __name__ == "__main__":
    sys.exit(main())

"""The stages as users run them: files in, files and a manifest out. Each is a thin shell around lazy operators. Inputs and
outputs may be URIs; what remote services answer (fetch, blast) is written by the driver to local folders."""

from __future__ import annotations

import json
import logging
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__, config, sinks
from ..functions import sequences as S
from ..functions.exact import mask_secret
from ..operators import cluster as C
from ..operators import consensus as N
from ..operators import export as X
from ..operators import filter as Q
from ..operators import hits as H
from ..operators import kmers as K
from ..scratch import stash
from ..sinks import uri
from ..sources import fasta, metadata, remote
from ..sources.env import Remote

log = logging.getLogger("helixframe")


def _lookup(spark: SparkSession, path, how) -> DataFrame | None:
    return how(metadata.read_metadata(spark, uri(path))) if path else None


def fetch(service: remote.Entrez, spark: SparkSession, query: str, limit: int, out_dir: str | Path) -> dict:
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    ids, total = service.search(query, limit)
    paths = {"sequences": out / "sequences.fasta", "metadata": out / "metadata.jsonl", "ids": out / "ids.txt"}
    with paths["sequences"].open("w", encoding="utf-8") as f:
        f.writelines(service.sequences(ids))
    with paths["metadata"].open("w", encoding="utf-8") as f:
        f.writelines(json.dumps(row) + "\n" for row in service.summaries(ids, query))
    paths["ids"].write_text("".join(f"{i}\n" for i in ids), "utf-8")
    s = service.s
    manifest = {
        "query": query, "timestamp": sinks.now(), "db": s.db, "limit_requested": limit, "total_found": total, "ids_retrieved": ids,
        "parameters": {"rettype": s.rettype, "retmode": s.retmode, "tool": s.tool, "sleep": s.sleep, "timeout": s.timeout, "retries": s.retries, "email_present": bool(service.email), "api_key_present": bool(service.api_key)},
        "outputs": {k: str(v) for k, v in paths.items()}, "cache_dir": str(service.cache_dir),
    }
    sinks.write_manifest(out / "manifest.json", manifest)
    return manifest


def filter_records(spark: SparkSession, in_fasta: str | Path, out_dir: str | Path, min_len: int, max_n_frac: float, alphabet: str, dedupe: bool, max_per_organism: int, in_metadata=None, write_report: bool = True) -> dict:
    out = str(out_dir).rstrip("/")
    rows = Q.records_of(fasta.read_fasta(spark, uri(in_fasta)), _lookup(spark, in_metadata, metadata.organism_lookup))
    cap = max(max_per_organism, 0)
    done = stash(Q.annotate(rows, min_len, max_n_frac, alphabet, dedupe, cap), "annotated")
    kept = done.where("kept")
    paths = {"sequences": sinks.write_fasta(kept, f"{out}/filtered_sequences.fasta", Q.fasta_header()), "report": None, "metadata": None}
    if write_report:
        report = done.select("idx", "record_id", F.coalesce("accession", F.lit("")).alias("accession"), "length", "n_count", "n_frac", "gc_percent", F.col("kept").cast("string").alias("kept"), "reason", "duplicate_of", F.col("header").alias("original_header"))
        paths["report"] = sinks.write_csv(report, f"{out}/filter_report.csv", [c for c in report.columns if c != "idx"], {"n_frac": 5, "gc_percent": 2}, ["idx"])
    if in_metadata:
        left = Q.filter_metadata(metadata.read_metadata(spark, uri(in_metadata)), kept.select("accession", "record_id"))
        paths["metadata"] = sinks.write_lines(left, f"{out}/filtered_metadata.jsonl", "raw", "line")
    counts = {r["reason"]: r["n"] for r in Q.reason_counts(done).collect()}  # a row for each reason
    total = sum(counts.values())
    log.info("kept %s of %s; top organisms: %s", counts.get("ok", 0), total, [tuple(r) for r in Q.organism_counts(rows, 3).collect()])
    manifest = {
        "timestamp": sinks.now(), "inputs": {"fasta": str(in_fasta), "metadata": str(in_metadata) if in_metadata else None}, "outputs": {k: str(v) if v else None for k, v in paths.items()},
        "params": {"min_len": min_len, "max_n_frac": max_n_frac, "alphabet": alphabet.upper(), "dedupe": dedupe, "write_report": write_report, "max_per_organism": cap},
        "total_records": total, "kept_records": counts.get("ok", 0), "dropped_records": total - counts.get("ok", 0), "reason_counts": counts, "duplicates": counts.get("duplicate", 0), "dropped_max_per_organism": counts.get("max_per_organism", 0),
    }
    sinks.write_manifest(f"{out}/filter_manifest.json", manifest)
    return manifest


def motifs(spark: SparkSession, in_fasta: str | Path, out_dir: str | Path, k: int, top: int, min_count: int, ignore_n: bool, canonical: bool, per_record: bool, alphabet: str) -> dict:
    out, how = str(out_dir).rstrip("/"), {"ignore_n": ignore_n, "canonical": canonical, "alphabet": alphabet}
    rows = stash(K.sequences_of(fasta.read_fasta(spark, uri(in_fasta))), "records")
    found = stash(K.motifs(rows, k, top, min_count, **how), "motifs")
    sinks.write_csv(found, f"{out}/motifs.csv", ["kmer", "count", "freq", "n_records", "idf_like"], {"freq": 6, "idf_like": 6}, [-F.col("count"), F.col("first")])
    n = K.summary(rows, k, top, min_count, **how).first()
    # without any k-mer the table is written empty; with k-mers of which none is wanted it isn't written
    if per_record and (n["unique_after_filters"] or not n["total_kmers"]):
        sinks.write_csv(K.motifs_by_record(rows, found, k, **how), f"{out}/motifs_by_record.csv", ["record_id", "kmer", "count", "freq_in_record"], {"freq_in_record": 6}, ["idx", "first_pos"])
    effective = config.canonical_applies(canonical, alphabet) if n["total_kmers"] else canonical
    manifest = {
        "timestamp": sinks.now(), "input_fasta": str(in_fasta), "params": {"k": k, "top": top, "min_count": min_count, "ignore_n": ignore_n, "canonical": effective, "per_record": per_record, "alphabet": alphabet.upper()},
        "total_records": n["total_records"], "total_kmers_considered": n["total_kmers"], "unique_kmers": n["unique_kmers"], "unique_kmers_after_filters": n["unique_after_filters"], "notes": [] if n["total_kmers"] else ["No k-mers extracted"],
    }
    sinks.write_manifest(f"{out}/motifs_summary.json", manifest)
    return manifest


STATS = ["cluster_id", "size", "mean_len", "dominant_organism", "n_unique_organisms", "max_pairwise_sim", "mean_pairwise_sim"]


def cluster(spark: SparkSession, in_fasta: str | Path, out_dir: str | Path, k: int, min_similarity: float, ignore_n: bool, canonical: bool, alphabet: str, max_pairs: int, in_metadata=None) -> dict:
    out, how = str(out_dir).rstrip("/"), {"ignore_n": ignore_n, "canonical": canonical, "alphabet": alphabet}
    rows = stash(K.sequences_of(fasta.read_fasta(spark, uri(in_fasta))), "records")
    total = rows.count()
    paths = {"edges": f"{out}/cluster_edges.csv", "clusters": f"{out}/clusters.jsonl", "stats": f"{out}/cluster_stats.csv"}
    evaluated = kept = 0
    number = total
    if total > 1:
        links, pairs, hit = C.edges(rows, k, min_similarity, max_pairs, **how)
        links = stash(links, "edges")
        if hit:
            log.warning("the limit of %s pairs was reached; clusters may be incomplete", max_pairs)
        evaluated, kept = pairs.count(), links.count()
        found = stash(C.clusters(rows, links, _lookup(spark, in_metadata, metadata.cluster_lookup)), "clusters")
        number = found.count()
        named = rows.select("idx", "record_id")
        edge = links.join(named.select(F.col("idx").alias("i"), F.col("record_id").alias("record_id_1")), "i").join(named.select(F.col("idx").alias("j"), F.col("record_id").alias("record_id_2")), "j")
        sinks.write_csv(edge, paths["edges"], ["record_id_1", "record_id_2", "jaccard"], {"jaccard": 4}, [-F.col("jaccard"), "i", "j"])
        shown = found.select(F.col("number").alias("__number"), "cluster_id", "size", "members", "mean_len", "dominant_organism", "n_unique_organisms", "max_pairwise_sim", "mean_pairwise_sim")
        sinks.write_jsonl(shown, paths["clusters"], "__number")
        sinks.write_csv(found, paths["stats"], STATS, {"mean_len": 2, "max_pairwise_sim": 4, "mean_pairwise_sim": 4}, ["number"])
    else:
        sinks.write_small_csv(paths["edges"], ["record_id_1", "record_id_2", "jaccard"], [])
        sinks.write_text(paths["clusters"], "")
        sinks.write_small_csv(paths["stats"], STATS, [])
    manifest = {
        "timestamp": sinks.now(), "params": {"k": k, "min_similarity": min_similarity, "ignore_n": ignore_n, "canonical": canonical, "alphabet": alphabet, "max_pairs": max_pairs}, "inputs": {"fasta": str(in_fasta), "metadata": str(in_metadata) if in_metadata else None},
        "total_records": total, "pairs_evaluated": evaluated, "edges_kept": kept, "cluster_count": number, "outputs": {k: str(v) for k, v in paths.items()},
    }
    sinks.write_manifest(f"{out}/cluster_manifest.json", manifest)
    return manifest


def consensus(spark: SparkSession, clusters: str | Path, in_fasta: str | Path, out_dir: str | Path, method: str, k: int, min_cluster_size: int, min_overlap: int, min_identity: float, max_n_frac: float, canonical: bool = True, in_metadata=None) -> dict:
    out = str(out_dir).rstrip("/")
    found = metadata.read_clusters(spark, uri(clusters))
    rows = K.sequences_of(fasta.read_fasta(spark, uri(in_fasta)))
    built = stash(N.build(found, rows, method, min_cluster_size, min_overlap, min_identity, max_n_frac, _lookup(spark, in_metadata, metadata.consensus_lookup)), "consensus")
    # in the order of the clusters file, which their ids follow
    built = built.withColumn("number", F.regexp_extract("cluster_id", r"(\d+)", 1).try_cast("long"))
    header = F.concat(F.lit("CONS_"), "cluster_id", F.lit(" size="), F.col("size").cast("string"), F.lit(' dominant_organism="'), "organism", F.lit(f'" method={method} k={k}'))
    paths = {"consensus_fasta": sinks.write_fasta(built.where("sequence is not null"), f"{out}/consensus.fasta", header, "number")}
    stats = built.select("number", "cluster_id", F.col("size").alias("cluster_size"), F.col("length").alias("consensus_len"), "n_count", "n_frac", "gc_percent", F.lit(method).alias("method"), F.lit(k).alias("k"), F.lit(min_overlap).alias("min_overlap"), F.lit(min_identity).alias("min_identity"), "status", "note")
    paths["consensus_stats"] = sinks.write_csv(stats, f"{out}/consensus_stats.csv", [c for c in stats.columns if c != "number"], {"n_frac": 4, "gc_percent": 2, "min_identity": 2}, ["number"])
    n = N.counters(found, built).first()
    manifest = {
        "timestamp": sinks.now(), "params": {"method": method, "k": k, "min_overlap": min_overlap, "min_identity": min_identity, "min_cluster_size": min_cluster_size, "max_n_frac": max_n_frac, "canonical": canonical},
        "inputs": {"clusters": str(clusters), "fasta": str(in_fasta), "metadata": str(in_metadata) if in_metadata else None},
        "nb_clusters_total": n["total"], "nb_clusters_attempted": n["attempted"], "nb_consensus_ok": n["ok"], "nb_consensus_failed": n["failed"], "outputs": {k: str(v) for k, v in paths.items()},
    }
    sinks.write_manifest(f"{out}/consensus_manifest.json", manifest)
    return manifest


def _raw_path(raw_dir: Path, name: str, suffix: str, text: str) -> Path:
    raw_dir.mkdir(parents=True, exist_ok=True)
    path = raw_dir / f"{name}.{suffix}"
    path.write_text(text, "utf-8")
    return path


def _safe(text: str, most: int) -> str:
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in text)[:most]


def _hits_of(spark: SparkSession, reports: list[tuple], parse, max_hits: int) -> dict[str, list[dict]]:
    """The parsed hits of finished queries, by query. All reports go through Spark together."""
    if not reports:
        return {}
    df = spark.createDataFrame(reports, "query_id string, query_len long, raw string")
    out: dict[str, list[dict]] = {}
    for r in parse(df, max_hits).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append({k: v for k, v in r.asDict().items() if k not in ("query_id", "rank")})
    return out


def blast(spark: SparkSession, jobs: remote.AlignmentJobs, in_fasta: str | Path, out_dir: str | Path, program: str, db: str, format_type: str, max_hits: int, poll_seconds: float, timeout_seconds: float, rate_limit_seconds: float, cache_dir=None, clock=time.monotonic, sleep=time.sleep) -> dict:
    """First dialect: jobs one by one at a limited rate, results kept by sequence; a failed query is noted and the run goes on."""
    out, cache, limiter = Path(out_dir), remote.ResultCache(cache_dir), remote.RateLimiter(rate_limit_seconds, clock, sleep)
    raw_dir, format_type = out / "raw", format_type.upper()
    suffix = {"TABULAR": "tsv", "XML": "xml"}.get(format_type, "json")
    rows = fasta.read_fasta(spark, uri(in_fasta))
    queries = rows.select("idx", S.query_id(F.col("header"), F.col("idx") + 1).alias("query_id"), "sequence", S.alignment_key(F.col("sequence"), program, db, format_type, max_hits).alias("key")).orderBy("idx").toLocalIterator()
    results, reports = [], []
    for q in queries:
        n, entry = q["idx"] + 1, {"query_id": q["query_id"], "rid": None, "top_hits": [], "raw_path": None}
        name = f"{n:04d}_{_safe(q['query_id'], 100) or 'query'}"
        results.append((entry, q))
        if kept := cache.load(q["key"]):
            entry |= {"rid": kept.get("rid"), "top_hits": kept.get("top_hits", []), "raw_path": str(_raw_path(raw_dir, name, suffix, kept.get("raw_text", "")))}
            continue
        try:
            limiter.wait()
            entry["rid"], _ = jobs.submit(q["sequence"], program, db, hitlist_size=max_hits)
            deadline, state = clock() + timeout_seconds, "WAITING"
            while state == "WAITING" and clock() < deadline:
                limiter.wait()
                state = jobs.state(entry["rid"])
                if state == "WAITING":
                    sleep(poll_seconds)
            if state != "READY":
                raise remote.RemoteError(f"job {entry['rid']} " + ("failed" if state == "FAILED" else f"took more than {timeout_seconds} seconds"))
            limiter.wait()
            report = raw = jobs.result(entry["rid"])
            if format_type != "JSON2":
                limiter.wait()
                raw = jobs.result(entry["rid"], format_type)
            entry["raw_path"] = str(_raw_path(raw_dir, name, suffix, raw))
            reports.append((str(n), len(q["sequence"]), report))
            entry["__raw"] = raw
        except remote.RemoteError as e:
            entry["error"] = str(e)
    found = _hits_of(spark, reports, H.report_hits, max_hits)
    for n, (entry, q) in enumerate(results, 1):
        if "__raw" in entry:
            entry["top_hits"] = found.get(str(n), [])
            cache.save(q["key"], {"query_id": entry["query_id"], "rid": entry["rid"], "format_type": format_type, "program": program, "database": db, "max_hits": max_hits, "top_hits": entry["top_hits"], "timestamp": sinks.now()}, entry.pop("__raw"))
    out.mkdir(parents=True, exist_ok=True)
    (out / "blast_hits.jsonl").write_text("".join(json.dumps(e) + "\n" for e, _ in results), "utf-8")
    line = lambda h: [h["accession"], f"{h['pident']:.3f}", f"{h['coverage']:.3f}", h["evalue"], h["bitscore"]]
    sinks.write_small_csv(out / "blast_summary.csv", ["query_id", "accession", "pident", "coverage", "evalue", "bitscore"], ([e["query_id"], *(line(e["top_hits"][0]) if e["top_hits"] else [""] * 5)] for e, _ in results))
    failed = sum("error" in e for e, _ in results)
    manifest = {
        "timestamp": sinks.now(), "input_fasta": str(in_fasta), "out_dir": str(out), "raw_dir": str(raw_dir), "program": program, "database": db, "format": format_type, "max_hits": max_hits, "poll_seconds": poll_seconds, "timeout_seconds": timeout_seconds,
        "rate_limit_seconds": rate_limit_seconds, "cache_dir": str(cache_dir) if cache_dir else None, "cache_enabled": bool(cache_dir), "email": jobs.own["EMAIL"], "tool": jobs.own["TOOL"], "api_key_provided": bool(jobs.key), "total_queries": len(results), "succeeded": len(results) - failed, "failed": failed,
    }
    sinks.write_manifest(out / "blast_manifest.json", manifest)
    return manifest


def blast_throttled(spark: SparkSession, jobs: remote.ThrottledJobs, in_fasta: str | Path, out_dir: str | Path, program: str, db: str, format_type: str, max_hits: int, poll_seconds: float, timeout_seconds: float, cache_dir: str | Path, settings: Remote) -> dict:
    """Second dialect: hits only from JSON2 results; unreadable ones count as done, without hits."""
    out, cache, started = Path(out_dir), Path(cache_dir), sinks.now()
    cache.mkdir(parents=True, exist_ok=True)
    suffix = {"JSON2": "json", "TABULAR": "txt", "XML": "xml"}.get(format_type.upper(), "txt")
    rows = fasta.read_records(spark, uri(in_fasta), uppercase=True, convert_u_to_t=program == "blastn")
    results, reports = [], []
    for n, q in enumerate(rows.orderBy("idx").toLocalIterator()):
        entry = {"query_id": q["identifier"], "rid": None, "program": program, "db": db, "top_hits": [], "raw_result_path": None}
        results.append(entry)
        try:
            entry["rid"] = jobs.submit(q["sequence"], program, db)
            state = jobs.poll(entry["rid"], poll_seconds, timeout_seconds)
            if state.name != "READY":
                raise remote.RemoteError(state.message or f"the job's state is {state.name}")
            kept = cache / f"{entry['rid']}.{suffix}"
            if not kept.exists():
                kept.write_text(jobs.result(entry["rid"], format_type), "utf-8")
            raw = kept.read_text("utf-8")
            entry["raw_result_path"] = str(_raw_path(out / "raw", f"{_safe(q['identifier'], 120)}_{entry['rid']}", suffix, raw))
            if format_type.upper() == "JSON2":
                reports.append((str(n), len(q["sequence"]), raw))
        except (remote.RemoteError, OSError) as e:
            entry["error"] = str(e)
    for n, found in _hits_of(spark, reports, H.search_hits, max_hits).items():
        results[int(n)]["top_hits"] = found
    out.mkdir(parents=True, exist_ok=True)
    (out / "blast_hits.jsonl").write_text("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in results), "utf-8")
    best = lambda e: e["top_hits"][0] if e["top_hits"] else {}
    sinks.write_small_csv(out / "blast_summary.csv", ["query_id", "rid", "top_accession", "top_organism", "pident", "qcov", "evalue", "bitscore"], ([e["query_id"], e["rid"], *(best(e).get(c) for c in ("accession", "organism", "pident", "qcov", "evalue", "bitscore"))] for e in results))
    failed = sum("error" in e for e in results)
    manifest = {
        "params": {"program": program, "db": db, "format": format_type, "max_hits": max_hits, "poll_seconds": poll_seconds, "timeout_seconds": timeout_seconds, "rate_limit_seconds": jobs.limiter.interval, "cache_dir": str(cache), "out_dir": str(out), "in_fasta": str(in_fasta)},
        "timestamps": {"started_at": started, "finished_at": sinks.now()}, "nb_sequences": len(results), "ok": len(results) - failed, "failed": failed, "version": __version__, "config": vars(settings) | {"ncbi_api_key": mask_secret(settings.ncbi_api_key)},
    }
    sinks.write_manifest(out / "blast_manifest.json", manifest)
    return manifest


def export(spark: SparkSession, features_csv: str | Path, metadata_jsonl: str | Path, out_dir: str | Path, motifs_csv=None) -> dict:
    for p in (features_csv, metadata_jsonl, motifs_csv):
        if p and "://" not in str(p) and not Path(p).exists():
            raise FileNotFoundError(f"no such file: {p}")
    out = str(out_dir).rstrip("/")
    features, meta = metadata.read_features(spark, uri(features_csv)), metadata.read_metadata_table(spark, uri(metadata_jsonl))
    joined, keys = X.with_metadata(features, meta)
    sinks.write_parquet(features, f"{out}/features.parquet")
    sinks.write_parquet(joined, f"{out}/joined_dataset.parquet")
    counts = {"features_rows": features.count(), "metadata_rows": meta.count(), "joined_rows": spark.read.parquet(uri(f"{out}/joined_dataset.parquet")).count(), "motifs_rows": None}
    if motifs_csv:
        rows = metadata.read_features(spark, uri(motifs_csv))
        sinks.write_parquet(rows, f"{out}/motifs_by_record.parquet")
        counts["motifs_rows"] = rows.count()
    manifest = {
        "params": {"features_csv": str(features_csv), "metadata_jsonl": str(metadata_jsonl), "motifs_by_record_csv": str(motifs_csv) if motifs_csv else None, "out_dir": str(out)}, "join_keys": list(keys) if keys else None, "counts": counts,
        "generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "version": __version__,
    }
    sinks.write_manifest(f"{out}/export_manifest.json", manifest)
    return manifest

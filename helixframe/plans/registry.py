"""Queries over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, sinks
from ..functions import sequences as S
from ..functions.exact import fixed
from ..operators import cluster, consensus, export, filter, hits, kmers
from ..scratch import new_folder, stash
from ..sources import fasta, metadata
from . import encoding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _records(spark: SparkSession, sf_dir: str, organism: str = "lang") -> DataFrame:
    rows = encoding.fasta(spark, sf_dir)
    return filter.records_of(rows).drop("organism").join(rows.select("idx", F.col(organism).alias("organism")), "idx") if organism == "source" else filter.records_of(rows)


def _passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, record_id, sequence, length, organism) of records that pass the quality rules."""
    judged = filter.quality(filter.measured(_records(spark, sf_dir), "DNA"))
    return judged.where("reason is null").select("idx", "record_id", "sequence", "length", "organism")


def _sql(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{encoding.SQL}{body}"


# Filter -----------------------------------------------------------------------------------------------------------

_METRICS = "idx, record_id, length::BIGINT AS length, n_count::BIGINT AS n_count, n_frac, gc_percent"


@query(_sql(f" SELECT {_METRICS}, coalesce(reason, 'ok') AS reason FROM quality"))
def quality_report(spark, sf_dir):
    out = filter.annotate(_records(spark, sf_dir), alphabet="DNA")
    return out.select("idx", "record_id", "length", "n_count", "n_frac", "gc_percent", "reason")


@query(_sql(" SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM quality GROUP BY 1"))
def reason_counts(spark, sf_dir):
    return filter.reason_counts(filter.annotate(_records(spark, sf_dir), alphabet="DNA"))


@query(_sql(""", d AS (SELECT idx, record_id, first_value(idx) OVER w AS f, first_value(record_id) OVER w AS keeper FROM passing WINDOW w AS (PARTITION BY sequence ORDER BY idx))
 SELECT q.idx, coalesce(q.reason, CASE WHEN d.f = q.idx THEN 'ok' ELSE 'duplicate' END) AS reason, CASE WHEN d.f < q.idx THEN regexp_extract(keeper, '([A-Z]{1,}[0-9]+(?:\\.[0-9]+)?)') ELSE '' END AS duplicate_of
 FROM quality q LEFT JOIN d USING (idx)"""))
def dedupe_first(spark, sf_dir):
    return filter.annotate(_records(spark, sf_dir), alphabet="DNA", dedupe=True).select("idx", "reason", "duplicate_of")


@query(_sql(""", d AS (SELECT idx, row_number() OVER (PARTITION BY lang ORDER BY idx) AS r FROM passing)
 SELECT idx, coalesce(reason, CASE WHEN r <= 50 THEN 'ok' ELSE 'max_per_organism' END) AS reason FROM quality LEFT JOIN d USING (idx)"""))
def cap_per_organism(spark, sf_dir):
    return filter.annotate(_records(spark, sf_dir), alphabet="DNA", max_per_organism=50).select("idx", "reason")


# A fold in SQL: the state is the kept sequences and how many each source has, one step for each record in order.
@query(_sql(""", p AS (SELECT idx, source, sequence, row_number() OVER (ORDER BY idx) AS r FROM passing),
 f AS (
  SELECT 0::BIGINT AS r, NULL::BIGINT AS idx, NULL::VARCHAR AS reason, [NULL]::VARCHAR[] AS seen, [NULL]::VARCHAR[] AS kept
  UNION ALL
  SELECT p.r, p.idx,
         CASE WHEN list_contains(f.seen, md5(p.sequence)) THEN 'duplicate' WHEN len(list_filter(f.kept, lambda x: x = p.source)) >= 20 THEN 'max_per_organism' ELSE 'ok' END,
         CASE WHEN list_contains(f.seen, md5(p.sequence)) OR len(list_filter(f.kept, lambda x: x = p.source)) >= 20 THEN f.seen ELSE list_append(f.seen, md5(p.sequence)) END,
         CASE WHEN list_contains(f.seen, md5(p.sequence)) OR len(list_filter(f.kept, lambda x: x = p.source)) >= 20 THEN f.kept ELSE list_append(f.kept, p.source) END
  FROM f JOIN p ON p.r = f.r + 1)
 SELECT q.idx, coalesce(q.reason, f.reason) AS reason FROM quality q LEFT JOIN f ON f.idx = q.idx""", recursive=True))
def dedupe_and_cap(spark, sf_dir):
    return filter.annotate(_records(spark, sf_dir, "source"), alphabet="DNA", dedupe=True, max_per_organism=20).select("idx", "reason")


@query("SELECT lang AS organism, count(*) AS n FROM documents GROUP BY 1")
def organism_counts(spark, sf_dir):
    return filter.organism_counts(_records(spark, sf_dir))


@query(_sql(" SELECT idx, record_id AS accession, record_id, record_id AS first_token, lang AS organism, lang AS description FROM enc"))
def header_parse(spark, sf_dir):
    h = F.col("header")
    return encoding.fasta(spark, sf_dir).select("idx", S.accession(h).alias("accession"), S.record_id(h).alias("record_id"), S.first_token(h).alias("first_token"), S.header_organism(h).alias("organism"), S.split_header(h)[1].alias("description"))


@query(_sql(" SELECT idx, sha256(sequence) AS digest, sha256('blastn|nt|JSON2|10|' || sequence) AS key, 'query_' || printf('%04d', idx + 1) AS query_id FROM enc"))
def sha_keys(spark, sf_dir):
    seq = F.col("sequence")
    return encoding.fasta(spark, sf_dir).select("idx", S.digest(seq).alias("digest"), S.alignment_key(seq, "blastn", "nt", "JSON2", 10).alias("key"), S.query_id(F.lit(""), F.col("idx") + 1).alias("query_id"))


@query(_sql(""" SELECT item_id AS line FROM benchmark b
 WHERE EXISTS (SELECT 1 FROM passing d WHERE d.record_id = CASE WHEN b.item_id % 2 = 0 THEN 'DOC' || b.item_id || '.1' END)
    OR EXISTS (SELECT 1 FROM passing d WHERE d.record_id = CASE WHEN b.item_id % 5 = 0 THEN 'DOC' || (b.item_id + 1) || '.1' END)"""))
def metadata_semi_filter(spark, sf_dir):
    # metadata: benchmark items with an accession, a uid, both or neither; kept: the records that pass the quality rules
    item = F.col("item_id")
    meta = _table(spark, sf_dir, "benchmark", "item_id").select(item.alias("line"), F.when(item % 2 == 0, F.concat(F.lit("DOC"), item, F.lit(".1"))).alias("accession"), F.lit(None).cast("string").alias("accessionversion"), F.when(item % 5 == 0, F.concat(F.lit("DOC"), item + 1, F.lit(".1"))).alias("uid"))
    return filter.filter_metadata(meta, _passing(spark, sf_dir).select("record_id", F.col("record_id").alias("accession"))).select("line")


# Sources and sinks: what is written to the shared folder and read back ---------------------------------------------

#: Documents whose encoded sequence holds no character that the readers would strip; file order is that of doc_id.
_NUMBERED = ", n AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS nth FROM enc)"


def _fasta_file(spark, sf_dir, indent: str = "") -> str:
    """Documents as a FASTA file, its headers after white space if wanted."""
    rows = encoding.fasta(spark, sf_dir)
    path = f"{new_folder(spark, 'fasta')}/all.fasta"
    if indent:
        text = F.concat(F.lit(f"junk{indent}\n{indent}>"), "header", F.lit(f"\n\n{indent}"), "sequence", F.lit("\n"))
        return str(sinks.write_lines(rows.select("idx", text.alias("value")), path, "value", "idx"))
    return str(sinks.write_fasta(rows, path, F.col("header")))


@query(_sql(_NUMBERED + " SELECT nth AS idx, header, sha256(sequence) AS digest, length(sequence)::BIGINT AS length FROM n"))
def fasta_round_trip(spark, sf_dir):
    got = fasta.read_fasta(spark, _fasta_file(spark, sf_dir))
    return got.select("idx", "header", S.digest(F.col("sequence")).alias("digest"), F.length("sequence").cast("long").alias("length"))


# each record but the first begins with what stands before the next header
@query(_sql(_NUMBERED + " SELECT nth AS idx, header, sha256(sequence || CASE WHEN nth < (SELECT max(nth) FROM n) THEN 'junk' ELSE '' END) AS digest FROM n"))
def fasta_indented(spark, sf_dir):
    got = fasta.read_fasta(spark, _fasta_file(spark, sf_dir, indent=" \t"))
    return got.select("idx", "header", S.digest(F.col("sequence")).alias("digest"))


# in the second dialect the text before the first header opens its sequence
@query(_sql(_NUMBERED + """ SELECT nth AS idx, record_id AS identifier, lang AS description,
  sha256(CASE WHEN nth = 0 THEN 'JTNK' ELSE '' END || sequence || CASE WHEN nth < (SELECT max(nth) FROM n) THEN 'JTNK' ELSE '' END) AS digest FROM n"""))
def records_indented(spark, sf_dir):
    got = fasta.read_records(spark, _fasta_file(spark, sf_dir, indent="  "), convert_u_to_t=True)
    return got.select("idx", "identifier", "description", S.digest(F.col("sequence")).alias("digest"))


def _metadata_file(spark, sf_dir) -> str:
    """Documents as metadata, several lines a key; some without an accession, an organism or a uid."""
    i = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars").select(
        i.alias("__at"), F.when(i % 3 > 0, F.concat(F.lit("u"), i % 41)).alias("uid"), F.when(i % 4 > 0, F.concat(F.lit("A"), i % 53)).otherwise("").alias("accession"), F.when(i % 8 == 0, F.concat(F.lit("V"), i % 17)).alias("accessionversion"),
        F.when(i % 5 > 0, F.col("lang")).alias("organism"), F.when(i % 7 > 0, F.col("source")).alias("taxname"), (i % 11).alias("taxid"), F.col("n_chars").alias("slen"), F.lit("x").alias("more"),
    )
    return str(sinks.write_jsonl(rows, f"{new_folder(spark, 'metadata')}/m.jsonl", "__at"))


_METADATA = """WITH m AS (SELECT doc_id AS line, CASE WHEN doc_id % 3 > 0 THEN 'u' || doc_id % 41 END AS uid, CASE WHEN doc_id % 4 > 0 THEN 'A' || doc_id % 53 END AS acc, CASE WHEN doc_id % 8 = 0 THEN 'V' || doc_id % 17 END AS ver,
  nullif(CASE WHEN doc_id % 5 > 0 THEN lang END, '') AS organism, nullif(CASE WHEN doc_id % 7 > 0 THEN source END, '') AS taxname, doc_id % 11 AS taxid, n_chars AS slen FROM documents),
 o AS (SELECT *, coalesce(organism, taxname) AS name, coalesce(acc, ver) AS key FROM m)"""


@query(f"{_METADATA} SELECT uid, coalesce(acc, '') AS accession, ver AS accessionversion, organism, taxname, taxid, slen, count(*) AS n FROM o GROUP BY ALL")
def metadata_round_trip(spark, sf_dir):
    got = metadata.read_metadata(spark, _metadata_file(spark, sf_dir))
    return got.where("raw like '%more%'").groupBy("uid", "accession", "accessionversion", "organism", "taxname", "taxid", "slen").agg(F.count("*").alias("n"))


@query(f"{_METADATA} SELECT key, arg_max(name, struct_pack(line := line, nth := nth)) AS organism FROM (SELECT key, name, line, CASE WHEN key IS NULL THEN NULL ELSE 0 END AS nth FROM o WHERE key IS NOT NULL UNION ALL SELECT uid, name, line, 1 FROM o WHERE uid IS NOT NULL) WHERE name IS NOT NULL GROUP BY key")
def metadata_organisms(spark, sf_dir):
    return metadata.organism_lookup(metadata.read_metadata(spark, _metadata_file(spark, sf_dir)))


@query(f"{_METADATA}, k AS (SELECT coalesce(acc, uid, 'None') AS key, line, name, taxid FROM o) SELECT k.key, name AS organism, taxid FROM k JOIN (SELECT key, max(line) AS line FROM k GROUP BY key) l ON l.key = k.key AND l.line = k.line")
def metadata_clusters(spark, sf_dir):
    return metadata.cluster_lookup(metadata.read_metadata(spark, _metadata_file(spark, sf_dir)))


@query(f"{_METADATA}, k AS (SELECT coalesce(acc, uid) AS key, line, organism FROM o WHERE coalesce(acc, uid) IS NOT NULL) SELECT k.key, organism FROM k JOIN (SELECT key, max(line) AS line FROM k GROUP BY key) l ON l.key = k.key AND l.line = k.line")
def metadata_consensus(spark, sf_dir):
    return metadata.consensus_lookup(metadata.read_metadata(spark, _metadata_file(spark, sf_dir)))


@query(f"{_METADATA} SELECT uid, coalesce(acc, '') AS accession, taxid, slen, 'x' AS more, count(*) AS n FROM o GROUP BY ALL")
def metadata_table(spark, sf_dir):
    return metadata.read_metadata_table(spark, _metadata_file(spark, sf_dir)).groupBy("uid", "accession", "taxid", "slen", "more").agg(F.count("*").alias("n"))


# the organism comes from the lookup where it knows the record, else from the header
@query(f"{_METADATA}, last AS (SELECT key, arg_max(name, line) AS name FROM o WHERE acc IS NOT NULL AND name IS NOT NULL GROUP BY key) SELECT d.doc_id AS idx, coalesce(l.name, d.lang) AS organism FROM documents d LEFT JOIN last l ON l.key = 'A' || d.doc_id")
def resolved_organisms(spark, sf_dir):
    rows = encoding.fasta(spark, sf_dir).withColumn("header", F.concat(F.lit("A"), "idx", F.lit(" "), "lang", F.lit(" voucher "), "idx"))
    known = metadata.organism_lookup(metadata.read_metadata(spark, _metadata_file(spark, sf_dir)).where("accession != ''").drop("uid").withColumn("uid", F.lit(None).cast("string")))
    return filter.records_of(rows, known).select("idx", "organism")


@query("SELECT doc_id, n_chars, CASE WHEN n_chars % 5 > 0 THEN n_chars / 8.0 END AS share, CASE WHEN lang = 'en' THEN NULL ELSE n_chars % 2 = 0 END AS even, 'say \"' || lang || '\", ' || source AS said, CASE WHEN lang = 'NA' THEN NULL ELSE lang END AS lang FROM documents")
def features_round_trip(spark, sf_dir):
    # integers, numbers and truth values with gaps, texts with quotes; types are found again
    n = F.col("n_chars")
    rows = _table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang", "source").select(
        "doc_id", "n_chars", F.when(n % 5 > 0, n / 8.0).alias("share"), F.when(F.col("lang") == "en", None).otherwise(F.when(n % 2 == 0, "True").otherwise("False")).alias("even"), F.concat(F.lit('say "'), "lang", F.lit('", '), "source").alias("said"), "lang"
    )
    path = sinks.write_csv(rows, f"{new_folder(spark, 'features')}/f.csv", rows.columns, order=["doc_id"])
    return metadata.read_features(spark, str(path))


@query("SELECT doc_id, lang, n_chars FROM documents")
def parquet_round_trip(spark, sf_dir):
    path = sinks.write_parquet(_table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars"), f"{new_folder(spark, 'parquet')}/p")
    return spark.read.parquet(str(path))


# lines keep the order they are written in
@query("SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place, lang || ' ' || doc_id AS value FROM documents")
def lines_round_trip(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars").select((-F.col("n_chars")).alias("down"), "doc_id", F.concat("lang", F.lit(" "), "doc_id").alias("line"))
    path = sinks.write_lines(rows, f"{new_folder(spark, 'lines')}/l.txt", "line", "down", "doc_id")
    text = spark.read.text(str(path)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return fasta.ordinals(text, "path", "block").select(F.col("idx").alias("place"), "value")


@query("SELECT count(*) AS total_records, count(*) FILTER (lang = 'de') AS kept_records, 'ß \"x\"' AS note FROM documents")
def manifest_round_trip(spark, sf_dir):
    n = _table(spark, sf_dir, "documents", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "de").alias("de")).first()
    path = sinks.write_manifest(f"{new_folder(spark, 'manifest')}/m.json", {"total_records": n["n"], "kept_records": n["de"], "note": 'ß "x"'})
    return spark.read.option("multiLine", True).json(str(path)).select("total_records", "kept_records", "note")


# Alphabets --------------------------------------------------------------------------------------------------------

#: German documents are written with U; AUTO takes those for RNA that hold a U and no T.
_RNA = """, a AS (SELECT idx, CASE WHEN lang = 'de' THEN replace(sequence, 'T', 'U') ELSE sequence END AS s FROM enc),
 k AS (SELECT idx, s, CASE WHEN contains(s, 'U') AND NOT contains(s, 'T') THEN 'RNA' ELSE 'DNA' END AS alphabet FROM a)"""


@query(_sql(_RNA + " SELECT idx, alphabet, sha256(CASE WHEN alphabet = 'RNA' THEN replace(s, 'T', 'U') ELSE replace(s, 'U', 'T') END) AS digest, length(s)::BIGINT AS length, (length(s) - length(replace(s, 'N', '')))::BIGINT AS n_count FROM k"))
def alphabets_auto(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("sequence", F.when(F.col("organism") == "de", F.translate("sequence", "T", "U")).otherwise(F.col("sequence")))
    # small letters and marks between them are cleaned away, ambiguity codes are N
    rows = rows.withColumn("sequence", F.concat(F.lit(" -"), F.lower(F.translate("sequence", "N", "R")), F.lit("*1")))
    return filter.measured(rows).select("idx", "alphabet", S.digest(F.col("sequence")).alias("digest"), "length", "n_count")


@query(_sql(" SELECT idx, sha256(replace(sequence, 'T', 'U')) AS digest FROM enc"))
def alphabet_rna(spark, sf_dir):
    return filter.measured(_records(spark, sf_dir), "RNA").select("idx", S.digest(F.col("sequence")).alias("digest"))


@query("SELECT doc_id AS idx, substr(regexp_replace('DOC' || doc_id || '.1|' || lang || '/' || source, '[^A-Za-z0-9_-]', '_', 'g'), 1, 100) AS name FROM documents")
def safe_names(spark, sf_dir):
    return _table(spark, sf_dir, "documents", "doc_id", "lang", "source").select(F.col("doc_id").alias("idx"), S.safe_name(F.concat(F.lit("DOC"), "doc_id", F.lit(".1|"), "lang", F.lit("/"), "source")).alias("name"))


# eighths have an exact binary value, so their ties go to even
@query("SELECT doc_id, printf('%.2f', (n_chars % 1000) / 8.0) AS two FROM documents")
def fixed_points(spark, sf_dir):
    return _table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", fixed((F.col("n_chars") % 1000) / 8.0, 2).alias("two"))


# K-mers -----------------------------------------------------------------------------------------------------------


def _kmer_sql(body: str, k: int = 9, kmer: str = "m", from_: str = "passing") -> str:
    comp = f"least({kmer}, reverse(translate({kmer}, 'ACGT', 'TGCA')))" if kmer != "m" else "m"
    return _sql(f""", w AS (SELECT idx, record_id, sequence, unnest(range(1, length(sequence) - {k} + 2)) AS i FROM {from_} WHERE length(sequence) >= {k}),
 raw AS (SELECT idx, record_id, i, substr(sequence, i, {k}) AS m FROM w),
 kmers AS (SELECT idx, record_id, i, {comp.replace(kmer, 'm')} AS kmer FROM raw WHERE m NOT LIKE '%N%'),
 per AS (SELECT idx, record_id, kmer, count(*) AS count, min(i) AS p FROM kmers GROUP BY ALL),
 tot AS (SELECT kmer, sum(count)::BIGINT AS count, count(*) AS n_records, min(struct_pack(i := idx, p := p)) AS first FROM per GROUP BY kmer){body}""")


_MOTIFS = """SELECT kmer, count, count::DOUBLE / (SELECT sum(count) FROM per) AS freq, n_records, round(ln((1.0 + (SELECT count(*) FROM passing)) / (1 + n_records)), 9) AS idf_like FROM tot"""


def _motif_rows(found: DataFrame) -> DataFrame:
    return found.select("kmer", "count", "freq", "n_records", F.round("idf_like", 9).alias("idf_like"))


@query(_kmer_sql(f" {_MOTIFS} ORDER BY count DESC, first LIMIT 200"))
def motifs_top(spark, sf_dir):
    return _motif_rows(kmers.motifs(_passing(spark, sf_dir)))


@query(_kmer_sql(f" {_MOTIFS} WHERE count >= 50"))
def motifs_min_count(spark, sf_dir):
    return _motif_rows(kmers.motifs(_passing(spark, sf_dir), top=0, min_count=50))


@query(_kmer_sql(f" {_MOTIFS} ORDER BY count DESC, first LIMIT 200", kmer="x.m"))
def motifs_canonical(spark, sf_dir):
    return _motif_rows(kmers.motifs(_passing(spark, sf_dir), canonical=True))


@query(_kmer_sql(f" {_MOTIFS} ORDER BY count DESC, first LIMIT 200").replace("WHERE m NOT LIKE '%N%'", ""))
def motifs_allow_n(spark, sf_dir):
    return _motif_rows(kmers.motifs(_passing(spark, sf_dir), ignore_n=False))


@query(_kmer_sql(""", top AS (SELECT kmer FROM tot ORDER BY count DESC, first LIMIT 200)
 SELECT idx, record_id, kmer, count, count::DOUBLE / (sum(count) OVER (PARTITION BY idx)) AS freq_in_record FROM per QUALIFY kmer IN (SELECT kmer FROM top)"""))
def motifs_by_record(spark, sf_dir):
    rows = _passing(spark, sf_dir)
    return kmers.motifs_by_record(rows, kmers.motifs(rows)).select("idx", "record_id", "kmer", "count", "freq_in_record")


@query(_kmer_sql(" SELECT (SELECT count(*) FROM passing) AS total_records, sum(count)::BIGINT AS total_kmers, count(*) AS unique_kmers, least(count(*) FILTER (count >= 2), 200) AS unique_after_filters FROM tot"))
def motifs_summary(spark, sf_dir):
    return kmers.summary(_passing(spark, sf_dir), 9, 200, 2)


# Clusters ---------------------------------------------------------------------------------------------------------


def _edge_sql(body: str, k: int, cap: str = "", recursive: bool = False) -> str:
    sql = _kmer_sql(f""", sets AS (SELECT DISTINCT idx, kmer FROM kmers), n AS (SELECT idx, count(*) AS n FROM sets GROUP BY idx),
 pairs AS (SELECT a.idx AS i, b.idx AS j, count(*) AS s FROM sets a JOIN sets b ON a.kmer = b.kmer AND a.idx < b.idx GROUP BY ALL {cap}),
 edges AS (SELECT i, j, s::DOUBLE / (x.n + y.n - s) AS jaccard FROM pairs JOIN n x ON x.idx = i JOIN n y ON y.idx = j WHERE s::DOUBLE / (x.n + y.n - s) >= 0.35){body}""", k)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else sql


_COMPONENTS = """, reach AS (SELECT idx AS x, idx AS y FROM passing UNION SELECT r.x, CASE WHEN e.i = r.y THEN e.j ELSE e.i END FROM reach r JOIN edges e ON e.i = r.y OR e.j = r.y),
 lab AS (SELECT x AS idx, min(y) AS component FROM reach GROUP BY x)"""


@query(_edge_sql(" SELECT i, j, jaccard FROM edges", 15))
def similarity_pairs(spark, sf_dir):
    return cluster.edges(_passing(spark, sf_dir), 15, max_pairs=None)[0]


@query(_edge_sql(" SELECT i, j, jaccard FROM edges", 9, "ORDER BY i, j LIMIT 200000"))
def similarity_capped(spark, sf_dir):
    return cluster.edges(_passing(spark, sf_dir), 9)[0]


@query(_edge_sql(_COMPONENTS + " SELECT idx, component FROM lab", 15, recursive=True))
def clusters(spark, sf_dir):
    rows = stash(_passing(spark, sf_dir), "records")
    return cluster.labels(rows, _ties(rows))


def _ties(rows: DataFrame) -> DataFrame:
    """Similar pairs, those of records with one set of k-mers as weights."""
    return stash(cluster.ties(*cluster.similar(rows, 15), config.Cluster.min_similarity), "edges")


def _clusters(spark, sf_dir):
    rows = stash(_passing(spark, sf_dir), "records")
    links = _ties(rows)
    lookup = rows.select(F.col("record_id").alias("key"), "organism", F.lit(1).cast("long").alias("taxid"))
    return rows, stash(cluster.clusters(rows, links, lookup), "clusters")


@query(_edge_sql(_COMPONENTS + """, m AS (SELECT l.component, p.lang, p.idx, p.length FROM lab l JOIN passing p USING (idx)),
 o AS (SELECT component, lang, count(*) AS c, min(idx) AS f FROM m GROUP BY ALL),
 s AS (SELECT component, max(jaccard) AS mx, avg(jaccard) AS mean FROM edges JOIN lab ON lab.idx = i GROUP BY component),
 b AS (SELECT component, count(*) AS size, avg(length) AS mean_len FROM m GROUP BY component)
 SELECT 'C' || printf('%04d', row_number() OVER (ORDER BY size DESC, component)) AS cluster_id, b.component, size, round(mean_len, 6) AS mean_len,
        (SELECT arg_max(lang, struct_pack(c := c, f := -f)) FROM o WHERE o.component = b.component) AS dominant_organism,
        (SELECT count(*) FROM o WHERE o.component = b.component) AS n_unique_organisms, coalesce(mx, 0.0) AS max_pairwise_sim, round(coalesce(mean, 0.0), 9) AS mean_pairwise_sim
 FROM b LEFT JOIN s USING (component)""", 15, recursive=True))
def cluster_stats(spark, sf_dir):
    out = _clusters(spark, sf_dir)[1]
    return out.select("cluster_id", "component", "size", F.round("mean_len", 6).alias("mean_len"), "dominant_organism", "n_unique_organisms", "max_pairwise_sim", F.round("mean_pairwise_sim", 9).alias("mean_pairwise_sim"))


@query("SELECT o_custkey, arg_max(o_orderpriority, struct_pack(c := c, f := -f)) AS mode FROM (SELECT o_custkey, o_orderpriority, count(*) AS c, min(o_orderkey) AS f FROM orders GROUP BY ALL) GROUP BY o_custkey")
def organism_mode(spark, sf_dir):
    by = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("c"), F.min("o_orderkey").alias("f"))
    return by.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("c", -F.col("f"))).alias("mode"))


# Consensus --------------------------------------------------------------------------------------------------------


@query(_edge_sql(_COMPONENTS + """, b AS (SELECT component, count(*) AS size, arg_max(p.sequence, struct_pack(l := p.length, i := -p.idx)) AS sequence FROM lab JOIN passing p USING (idx) GROUP BY component),
 c AS (SELECT 'C' || printf('%04d', row_number() OVER (ORDER BY size DESC, component)) AS cluster_id, * FROM b)
 SELECT cluster_id, size, sha256(sequence) AS digest, length(sequence)::BIGINT AS length, 'ok' AS status, 'representative_longest' AS note FROM c WHERE size >= 2""", 15, recursive=True))
def longest_representative(spark, sf_dir):
    rows, found = _clusters(spark, sf_dir)
    out = consensus.build(found, rows, method="simple")
    return out.select("cluster_id", "size", S.digest(F.col("sequence")).alias("digest"), "length", "status", "note")


#: The first bases of each record. A fold in SQL looks at all overlaps of two sequences, which is dear, so these are short;
#: consensus_merge below runs over whole sequences.
_SHORT = 240


def _fold_sql() -> str:
    def overlap(a: str, b: str) -> str:
        x, y = f"substr({a}, length({a}) - n + i, 1)", f"substr({b}, i, 1)"
        known, same = f"len(list_filter(range(1, n + 1), lambda i: {x} <> 'N' AND {y} <> 'N'))", f"len(list_filter(range(1, n + 1), lambda i: {x} <> 'N' AND {x} = {y}))"
        return f"list_filter(range(least(length({a}), length({b})), 79, -1), lambda n: {known} > 0 AND {same} >= 0.97 * {known})[1]"

    def joined(a: str, b: str, n: str) -> str:
        x, y = f"substr({a}, length({a}) - {n} + i, 1)", f"substr({b}, i, 1)"
        mid = f"array_to_string(list_transform(range(1, {n} + 1), lambda i: CASE WHEN {x} = 'N' THEN {y} WHEN {y} = 'N' OR {x} = {y} THEN {x} ELSE 'N' END), '')"
        return f"substr({a}, 1, length({a}) - {n}) || {mid} || substr({b}, {n} + 1)"

    body = f"""{_COMPONENTS}, m AS (SELECT l.component, p.sequence, row_number() OVER (PARTITION BY l.component ORDER BY p.length DESC, p.idx) AS r, count(*) OVER (PARTITION BY l.component) AS size FROM lab l JOIN passing p USING (idx)),
 f AS (
  SELECT component, r, sequence AS c, false AS merged FROM m WHERE r = 1 AND size >= 2
  UNION ALL
  SELECT component, r, CASE WHEN n1 IS NOT NULL THEN {joined('c', 's', 'n1')} WHEN n2 IS NOT NULL THEN {joined('s', 'c', 'n2')} ELSE c END, merged OR n1 IS NOT NULL OR n2 IS NOT NULL
  FROM (SELECT component, r, c, s, merged, n1, CASE WHEN n1 IS NULL THEN {overlap('s', 'c')} END AS n2
        FROM (SELECT f.component, m.r, f.c, m.sequence AS s, f.merged, {overlap('f.c', 'm.sequence')} AS n1 FROM f JOIN m ON m.component = f.component AND m.r = f.r + 1))),
 done AS (SELECT f.component, f.c, f.merged, m.size FROM f JOIN m ON m.component = f.component AND m.r = f.r AND m.r = m.size)
 SELECT component, size, sha256(c) AS digest, length(c)::BIGINT AS length,
        CASE WHEN (length(c) - length(replace(c, 'N', ''))) > 0.05 * length(c) THEN 'low_quality' WHEN merged THEN 'ok' ELSE 'failed' END AS status,
        CASE WHEN (length(c) - length(replace(c, 'N', ''))) > 0.05 * length(c) THEN 'high_N_fraction' WHEN merged THEN '' ELSE 'insufficient_overlap' END AS note FROM done"""
    return _edge_sql(body, 15, recursive=True).replace("passing AS (SELECT * FROM quality WHERE reason IS NULL)", f"passing AS (SELECT idx, record_id, substr(sequence, 1, {_SHORT}) AS sequence, least(length, {_SHORT})::BIGINT AS length FROM quality WHERE reason IS NULL)")


def _short(spark, sf_dir):
    """Clusters of the records' first bases, and the records."""
    cut = F.substring("sequence", 1, _SHORT)
    rows = stash(_passing(spark, sf_dir).select("idx", "record_id", cut.alias("sequence"), F.length(cut).cast("long").alias("length")), "records")
    return rows, stash(cluster.clusters(rows, _ties(rows)), "clusters")


@query(_fold_sql())
def consensus_short(spark, sf_dir):
    rows, found = _short(spark, sf_dir)
    named = found.select("cluster_id", "component")
    return consensus.build(found, rows).join(named, "cluster_id").select("component", "size", S.digest(F.col("sequence")).alias("digest"), "length", "status", "note")


@query(f"WITH done AS ({_fold_sql()}) SELECT (SELECT count(*) FROM done) AS attempted, (SELECT count(*) FROM done WHERE status <> 'failed') AS ok, (SELECT count(*) FROM done WHERE status = 'failed') AS failed")
def consensus_short_counters(spark, sf_dir):
    rows, found = _short(spark, sf_dir)
    return consensus.counters(found, stash(consensus.build(found, rows), "consensus")).select("attempted", "ok", "failed")


@query()
def consensus_merge(spark, sf_dir):
    rows, found = _clusters(spark, sf_dir)
    return consensus.build(found, rows).select("cluster_id", "size", "organism", "length", "n_count", "n_frac", "gc_percent", "status", "note", S.digest(F.col("sequence")).alias("digest"))


@query()
def consensus_counters(spark, sf_dir):
    rows, found = _clusters(spark, sf_dir)
    return consensus.counters(found, stash(consensus.build(found, rows), "consensus"))


# Reports ----------------------------------------------------------------------------------------------------------

#: An order as a query, its lines as hits of a report, in both dialects. Odd lengths leave no ties to round.
_ALIGN, _SAME = "l_partkey % 200 * 2 + 101", "(l_partkey % 200 * 2 + 101) - l_suppkey % 90"


def _reports(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    hit = F.struct(
        F.concat(F.lit("ACC"), "l_partkey").alias("accession"),
        F.array(F.struct(F.concat(F.lit("ACC"), "l_partkey").alias("accession"), F.concat(F.lit("part "), "l_partkey", F.lit(" [Organism "), F.col("l_suppkey") % 7, F.lit("]")).alias("title"), (F.col("l_suppkey") % 7).alias("taxid"))).alias("description"),
        F.array(F.struct(F.expr(_ALIGN).alias("align_len"), F.expr(_SAME).alias("identity"), (F.col("l_quantity") / 1000).alias("evalue"), F.col("l_extendedprice").alias("bit_score"), F.lit(1).alias("query_from"), F.expr(_ALIGN).alias("query_to"))).alias("hsps"),
    )
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", hit.alias("hit")))).alias("all"))
    search = F.struct(F.lit(1000).alias("query_len"), F.transform("all", lambda x: x["hit"]).alias("hits"))
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(search.alias("search")).alias("results")).alias("report"))).alias("BlastOutput2")))
    return per.select(F.col("l_orderkey").cast("string").alias("query_id"), F.lit(1000).cast("long").alias("query_len"), raw.alias("raw"))


# lines of an order that share a number go by what their hits hold, as arrays of structs are sorted
_LINES = f"""WITH l AS (SELECT *, 'ACC' || l_partkey AS acc, 'part ' || l_partkey || ' [Organism ' || l_suppkey % 7 || ']' AS t, ({_ALIGN})::BIGINT AS a, ({_SAME})::BIGINT AS s FROM lineitem),
 x AS (SELECT l_orderkey::VARCHAR AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, acc, t, l_suppkey % 7, a, s, l_quantity, l_extendedprice) AS rank, acc AS accession, t AS title,
  'Organism ' || l_suppkey % 7 AS organism, l_suppkey % 7 AS taxid, a, s, l_quantity / 1000 AS evalue, l_extendedprice AS bitscore FROM l)"""


@query(f"{_LINES} SELECT query_id, rank, accession, title, organism, round(100.0 * s::DOUBLE / a, 3) AS pident, a AS length, evalue, bitscore, round(a / 1000.0, 3) AS coverage FROM x WHERE rank <= 3")
def json_hits(spark, sf_dir):
    return hits.report_hits(_reports(spark, sf_dir), 3)


@query(f"{_LINES} SELECT query_id, rank, accession, title, taxid::BIGINT AS taxid, NULL::VARCHAR AS organism, round(100.0 * s::DOUBLE / a, 2) AS pident, a AS align_len, evalue, bitscore, round(a / 10.0, 2) AS qcov FROM x WHERE rank <= 3")
def json_search_hits(spark, sf_dir):
    return hits.search_hits(_reports(spark, sf_dir), 3)


@query(f"{_LINES} SELECT query_id, accession, round(100.0 * s::DOUBLE / a, 3) AS pident, round(a / 1000.0, 3) AS coverage, evalue, bitscore FROM x WHERE rank = 1")
def best_hit_summary(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    return hits.best_hits(reports, hits.report_hits(reports, 3)).select("query_id", "accession", "pident", "coverage", "evalue", "bitscore")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders")
def alignment_counts(spark, sf_dir):
    return hits.outcome_counts(_table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", "timed out").alias("error")))


@query(_sql(" SELECT idx, sha256('blastn|nt|JSON2|10|' || sequence) AS key FROM enc WHERE sequence NOT IN (SELECT sequence FROM passing)"))
def uncached_queries(spark, sf_dir):
    # the cache holds the results of the records that pass the quality rules
    key = S.alignment_key(F.col("sequence"), "blastn", "nt", "JSON2", 10).alias("key")
    return hits.uncached(encoding.fasta(spark, sf_dir).select("idx", key), _passing(spark, sf_dir).select(key).distinct())


# Export -----------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id AS record_id, d.n_chars, d.lang, l.quality, l.toxic, l.doc_id % 5 AS n_chars_meta FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_left_join(spark, sf_dir):
    features = _table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang").withColumnRenamed("doc_id", "record_id")
    metadata = _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select(F.col("doc_id").alias("record_id"), (F.col("doc_id") % 5).alias("n_chars"), "quality", "toxic")
    return export.with_metadata(features, metadata)[0]


@query("SELECT (SELECT count(*) FROM documents) AS features_rows, (SELECT count(*) FROM labels) AS metadata_rows, (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id)) AS joined_rows")
def export_counts(spark, sf_dir):
    features = _table(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "record_id")
    metadata = _table(spark, sf_dir, "labels", "doc_id").withColumnRenamed("doc_id", "accession")
    joined = export.with_metadata(features, metadata)[0]
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(features, "features_rows").crossJoin(one(metadata, "metadata_rows")).crossJoin(one(joined, "joined_rows"))

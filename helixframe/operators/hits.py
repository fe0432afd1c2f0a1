"""Tabular hits from nested alignment reports, in two dialects. Input: (query_id, query_len, raw)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import rounded


class ReportError(ValueError):
    """A report that can't be read as the dialect asks for."""


def _get(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _text(v: str, path: str) -> Column:
    """A non-empty text, or null."""
    return F.nullif(_get(v, path, "string"), F.lit(""))


def number(v: str, keys: list[str], default: float | None = 0.0) -> Column:
    """The first of the keys with a value that reads as a number."""
    return F.coalesce(*[_get(v, f"$['{k}']", "double") for k in keys], F.lit(default))


def as_int(x: Column) -> Column:
    """Rounded half to even; 0 where there is no number."""
    return F.coalesce(F.when(~F.isnan(x), F.rint(x)).try_cast("long"), F.lit(0).cast("long"))


def bracket_organism(title: Column) -> Column:
    """The text in the last brackets of a title, or null."""
    return F.when(title.contains("[") & title.contains("]"), F.regexp_replace(F.substring_index(title, "[", -1), r"\]+$", ""))


def _first_hits(rows: DataFrame, max_hits: int) -> DataFrame:
    """The first hits of each query; at least one, whatever max_hits says."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= max(max_hits, 1))


# The spellings of keys in reports.
ALIGN_LEN = ["align_len", "align-len", "alignLen"]
IDENTITY = ["identity", "identity_num", "identity-val", "num_identical"]
EVALUE = ["evalue", "e-value", "expect"]
BITSCORE = ["bit_score", "bitScore", "bit-score"]


def report_hits(reports: DataFrame, max_hits: int = 10) -> DataFrame:
    """First dialect: (query_id, rank, accession, title, organism, pident, length, evalue, bitscore, coverage). All reports of a
    payload; hits without alignments are skipped; coverage is a share of the query; what is missing is '' or 0. A blank payload
    has no hits, one that isn't JSON fails."""
    parsed = reports.where(F.trim("raw") != "").select("query_id", "query_len", F.parse_json("raw").alias("v"))
    each = parsed.select("query_id", "query_len", F.posexplode(F.try_variant_get("v", "$.BlastOutput2", "array<variant>")).alias("r", "report"))
    hit = each.select("query_id", "query_len", "r", F.posexplode(F.try_variant_get("report", "$.report.results.search.hits", "array<variant>")).alias("h", "hit"))
    shaped = hit.select("query_id", "query_len", F.struct("r", "h").alias("at"), "hit", F.try_variant_get("hit", "$.description[0]", "variant").alias("d"), F.try_variant_get("hit", "$.hsps[0]", "variant").alias("hsp")).where("hsp is not null")
    rows = _first_hits(shaped, max_hits)
    title = F.coalesce(_text("d", "$.title"), _text("d", "$.id"), F.lit(""))
    full = rows.withColumns({"title": title, "align": number("hsp", ALIGN_LEN), "same": number("hsp", IDENTITY), "own": F.nullif(_get("hit", "$.len", "double"), F.lit(0.0))})
    pident = F.when(F.col("align") != 0, F.col("same") / F.col("align") * 100.0).otherwise(0.0)
    coverage = F.when((F.col("query_len") != 0) & (F.col("align") != 0), F.col("align") / F.col("query_len")).otherwise(0.0)
    return full.select(
        "query_id", "rank", F.coalesce(_text("d", "$.accession"), _text("d", "$.id"), F.lit("")).alias("accession"), "title", F.coalesce(_text("d", "$.sciname"), bracket_organism(F.col("title")), _get("d", "$.taxid", "string"), F.lit("")).alias("organism"),
        rounded(pident, 3).alias("pident"), as_int(F.coalesce("own", "align")).alias("length"), number("hsp", EVALUE).alias("evalue"), number("hsp", BITSCORE).alias("bitscore"), rounded(coverage, 3).alias("coverage"),
    )


def unreadable(reports: DataFrame) -> DataFrame:
    """(query_id, error) of payloads that the second dialect refuses."""
    v = reports.select("query_id", F.try_parse_json("raw").alias("v"))
    search = F.try_variant_get("v", "$.BlastOutput2[0].report.results.search", "variant")
    return v.select("query_id", F.when(F.col("v").isNull(), "Invalid JSON2 payload").when(search.isNull(), "Unexpected JSON2 schema").alias("error")).where("error is not null")


def search_hits(reports: DataFrame, max_hits: int = 10) -> DataFrame:
    """Second dialect: (query_id, rank, accession, title, taxid, organism, pident, align_len, evalue, bitscore, qcov). The first report
    only; hits without alignments stay with nulls; coverage is a percentage from the query's bounds; unreadable payloads have no hits."""
    v = reports.select("query_id", F.try_parse_json("raw").alias("v")).select("query_id", F.try_variant_get("v", "$.BlastOutput2[0].report.results.search", "variant").alias("s"))
    each = v.select("query_id", _get("s", "$.query_len", "long").alias("query_len"), F.posexplode(F.try_variant_get("s", "$.hits", "array<variant>")).alias("at", "hit"))
    shaped = each.select("query_id", "query_len", "at", "hit", F.try_variant_get("hit", "$.description[0]", "variant").alias("d"), F.try_variant_get("hit", "$.hsps[0]", "variant").alias("hsp"))
    rows = _first_hits(shaped, max_hits).withColumns({"align_len": _get("hsp", "$.align_len", "long"), "identity": _get("hsp", "$.identity", "long"), "x": _get("hsp", "$.query_from", "long"), "y": _get("hsp", "$.query_to", "long")})
    pident = F.when(F.col("align_len") != 0, F.col("identity") * 100 / F.col("align_len"))
    qcov = F.when(F.col("query_len") != 0, (F.abs(F.col("y") - F.col("x")) + 1) * 100 / F.col("query_len"))
    return rows.select(
        "query_id", "rank", F.coalesce(_text("hit", "$.accession"), _get("d", "$.accession", "string")).alias("accession"), _get("d", "$.title", "string").alias("title"), _get("d", "$.taxid", "long").alias("taxid"),
        F.coalesce(_text("d", "$.organism"), _text("d", "$.sciname"), _get("d", "$.taxname", "string")).alias("organism"), rounded(pident, 2).alias("pident"), "align_len", _get("hsp", "$.evalue", "double").alias("evalue"), _get("hsp", "$.bit_score", "double").alias("bitscore"), rounded(qcov, 2).alias("qcov"),
    )


def parse_strictly(reports: DataFrame, max_hits: int = 10) -> DataFrame:
    """As search_hits(), but an unreadable payload is an error."""
    bad = unreadable(reports).limit(1).collect()
    if bad:
        raise ReportError(f"{bad[0]['query_id']}: {bad[0]['error']}")
    return search_hits(reports, max_hits)


def best_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every query with its first hit, whose columns are null where there is none."""
    return queries.select("query_id").join(hits.where("rank = 1").drop("rank"), "query_id", "left")


def outcome_counts(results: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed of (query_id, error)."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def uncached(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries, with a ``key``, that a cache table has no result for."""
    return queries.join(cache.select("key"), "key", "left_anti")

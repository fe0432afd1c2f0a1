"""Quality filter, deduplication and caps. Every input record keeps a row, with the reason it was dropped or ``ok``."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import sequences as S
from ..scratch import stash
from .graph import components


def records_of(fasta: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """(idx, header, record_id, accession, organism, sequence) of a FASTA table. The organism comes from the lookup by
    accession, then by record id, then from the header."""
    h = F.col("header")
    rows = fasta.select("idx", "header", S.record_id(h).alias("record_id"), S.accession(h).alias("accession"), "sequence")
    named = S.header_organism(h)
    if lookup is None:
        return rows.select("*", named.alias("organism"))
    # where there is an accession, it is the record id as well, so one join serves both keys
    found = rows.join(lookup.select(F.col("key").alias("record_id"), F.col("organism").alias("known")), "record_id", "left")
    return found.select(*rows.columns, F.coalesce("known", named).alias("organism"))


def measured(records: DataFrame, alphabet: str = config.Filter.alphabet) -> DataFrame:
    """records with cleaned and normalised ``sequence``, its alphabet, length, n_count, n_frac and gc_percent."""
    mode = config.check_alphabet(alphabet)
    own = [c for c in records.columns if c not in ("sequence", "alphabet", "length", "n_count", "n_frac", "gc_percent")]
    cleaned = records.select(*own, S.clean(F.coalesce("sequence", F.lit(""))).alias("c"))
    kind = cleaned.withColumn("alphabet", S.alphabet(F.col("c"), mode))
    # as a generated row: a condition on what is measured would otherwise be moved before this, and clean a sequence again for each use
    seq = kind.select(*own, F.inline(F.array(F.struct("alphabet", S.normalise(F.col("c"), F.col("alphabet")).alias("sequence")))))
    sized = seq.withColumns({"length": F.length("sequence").cast("long"), "n_count": S.count_of(F.col("sequence"), "N")})
    return sized.withColumns({"n_frac": S.n_frac(F.col("length"), F.col("n_count")), "gc_percent": S.gc_percent(F.col("sequence"), F.col("length"), F.col("n_count"))})


def quality(metrics: DataFrame, min_len: int = config.Filter.min_len, max_n_frac: float = config.Filter.max_n_frac) -> DataFrame:
    """metrics with ``reason``: the first rule that a record breaks, or null."""
    rule = F.when(F.col("length") == 0, "empty_after_clean").when(F.col("length") < min_len, "too_short").when(F.col("n_frac") > max_n_frac, "too_many_N")
    return metrics.withColumn("reason", rule)


def _capped(rows: DataFrame, cap: int) -> DataFrame:
    """(idx) of the first ``cap`` rows of each organism. Tasks cut their share to the cap before it is shuffled."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("organism").orderBy("idx"))).where(F.col("rank") <= cap).select("idx")


def _greedy(cap: int):
    """The sequential rule for organisms tied together by sequences: a first copy is kept unless its sequence was kept before or
    its organism is full; only kept copies count for either."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seen, full, kept = set(), {}, []
        for idx, digest, organism in rows.sort_values("idx").itertuples(index=False):
            if digest in seen or full.get(organism, 0) >= cap:
                continue
            seen.add(digest)
            full[organism] = full.get(organism, 0) + 1
            kept.append(idx)
        return pd.DataFrame({"idx": pd.Series(kept, dtype="int64")})

    return lambda key, rows: run(rows[["idx", "digest", "organism"]])


def keepers(passing: DataFrame, dedupe: bool, cap: int) -> DataFrame:
    """(idx) of what stays of (idx, digest, organism).

    With both rules on, only the first copy of a sequence in each organism can change anything: an organism that is full
    stays full. Organisms without a sequence that another organism has too are plain windows. The others are tied
    together through such sequences; each set of tied organisms is one independent sequential fold of slim rows.
    """
    if not dedupe:
        return _capped(passing, cap) if cap > 0 else passing.select("idx")
    if cap <= 0:
        return passing.groupBy("digest").agg(F.min("idx").alias("idx")).select("idx")
    first = stash(passing.groupBy("digest", "organism").agg(F.min("idx").alias("idx")), "filter-first")
    spread = first.groupBy("digest").agg(F.min("organism").alias("least"), F.max("organism").alias("most")).where("least != most")
    ties = stash(first.join(spread, "digest").select("organism", "least").distinct(), "filter-ties")
    names = stash(ties.select("organism").distinct().withColumn("id", F.monotonically_increasing_id()), "filter-names")
    pairs = ties.join(names.select("organism", F.col("id").alias("a")), "organism").join(names.select(F.col("organism").alias("least"), F.col("id").alias("b")), "least").where("a != b").select("a", "b")
    sets = components(pairs, "filter-sets").join(names, F.col("node") == F.col("id")).select("organism", "root")
    free = _capped(first.join(sets, "organism", "left_anti"), cap)
    tied = first.join(sets, "organism").groupBy("root").applyInPandas(_greedy(cap), "idx long")
    return free.union(tied)


def annotate(records: DataFrame, min_len: int = config.Filter.min_len, max_n_frac: float = config.Filter.max_n_frac, alphabet: str = config.Filter.alphabet, dedupe: bool = False, max_per_organism: int = config.Filter.max_per_organism) -> DataFrame:
    """Every record with its metrics, ``kept``, ``reason`` and ``duplicate_of`` (the kept record of the same sequence)."""
    judged = quality(measured(records, alphabet), min_len, max_n_frac)
    if not dedupe and max_per_organism <= 0:
        return judged.select("*", F.lit("").alias("duplicate_of")).withColumn("reason", F.coalesce("reason", F.lit("ok"))).withColumn("kept", F.col("reason") == "ok")
    name = F.coalesce("accession", "record_id")
    # the rules are worked out once; both what decides about copies and the result read them from here
    judged = stash(judged.withColumn("__digest", F.when(F.col("reason").isNull(), S.digest(F.col("sequence")))), "filter-judged")
    passing = judged.where("reason is null")
    if max_per_organism <= 0:
        first = passing.groupBy(F.col("__digest").alias("d")).agg(F.min("idx").alias("keeper"), F.min_by(name, "idx").alias("keeper_name"))
        met = judged.join(first, F.col("__digest") == F.col("d"), "left")
        copy = F.col("keeper") < F.col("idx")
        out = met.select(*[c for c in judged.columns if c not in ("reason", "__digest")], F.coalesce("reason", F.when(copy, "duplicate").otherwise("ok")).alias("reason"), F.when(copy, F.col("keeper_name")).otherwise(F.lit("")).alias("duplicate_of"))
        return out.withColumn("kept", F.col("reason") == "ok")
    slim = passing.select("idx", F.col("__digest").alias("digest"), "organism", name.alias("name"))
    kept = stash(keepers(slim, dedupe, max_per_organism), "filter-kept")
    flags = slim.join(kept.withColumn("stays", F.lit(True)), "idx", "left")
    if dedupe:
        by = flags.where("stays").select("digest", F.col("idx").alias("keeper"), F.col("name").alias("keeper_name"))
        flags = flags.join(by, "digest", "left")
        decided = F.when(F.col("stays"), "ok").when(F.col("keeper") < F.col("idx"), "duplicate").otherwise("max_per_organism")
        flags = flags.select("idx", decided.alias("decided"), F.when(decided == "duplicate", F.col("keeper_name")).otherwise(F.lit("")).alias("duplicate_of"))
    else:
        flags = flags.select("idx", F.when(F.col("stays"), "ok").otherwise("max_per_organism").alias("decided"), F.lit("").alias("duplicate_of"))
    out = judged.drop("__digest").join(flags, "idx", "left").withColumns({"reason": F.coalesce("reason", "decided"), "duplicate_of": F.coalesce("duplicate_of", F.lit(""))}).drop("decided")
    return out.withColumn("kept", F.col("reason") == "ok")


def reason_counts(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("reason").agg(F.count("*").alias("n"))


def organism_counts(records: DataFrame, top: int | None = None) -> DataFrame:
    """(organism, n), before any filter; the first to appear goes first among equals."""
    n = records.groupBy("organism").agg(F.count("*").alias("n"), F.min("idx").alias("first")).orderBy(F.desc("n"), "first")
    return (n.limit(top) if top else n).select("organism", "n")


def filter_metadata(metadata: DataFrame, kept: DataFrame) -> DataFrame:
    """Metadata rows whose accession is a kept accession or whose uid is a kept record id. One hash join on exploded keys; a
    condition with OR would compare all rows with all."""
    keys = metadata.select("line", F.explode(F.array_compact(F.array(F.struct(F.lit("a").alias("kind"), F.coalesce(F.nullif("accession", F.lit("")), F.nullif("accessionversion", F.lit(""))).alias("key")), F.struct(F.lit("u").alias("kind"), F.nullif("uid", F.lit("")).alias("key"))))).alias("k"))
    ids = kept.select(F.explode(F.array(F.struct(F.lit("a").alias("kind"), F.col("accession").alias("key")), F.struct(F.lit("u").alias("kind"), F.col("record_id").alias("key")))).alias("k"))
    hit = keys.where("k.key is not null").join(ids.where("k.key is not null"), "k", "left_semi").select("line").distinct()
    return metadata.join(hit, "line", "left_semi")


def fasta_header() -> Column:
    """What kept records are written under; fractions as text come from the sink."""
    from ..functions.exact import fixed

    return F.concat("record_id", F.lit(" | accession="), F.coalesce("accession", F.lit("NA")), F.lit(" | len="), F.col("length").cast("string"), F.lit(" | n_frac="), fixed(F.col("n_frac"), 3), F.lit(" | gc="), fixed(F.col("gc_percent"), 1))


__all__ = ["annotate", "filter_metadata", "measured", "quality", "reason_counts", "records_of", "organism_counts", "keepers", "fasta_header"]

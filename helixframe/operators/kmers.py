"""K-mer statistics. Input: (idx, record_id, sequence) with upper-cased sequences, which aren't cleaned here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import config
from ..functions import sequences as S
from ..functions import windows
from ..scratch import stash

#: Letters, about, whose k-mers a task adds up before they become rows.
MANY = 1 << 22
#: Up to so many wanted k-mers are looked for where records are counted; more are joined.
WANTED = 10_000


def sequences_of(fasta: DataFrame) -> DataFrame:
    """(idx, record_id, sequence) of a FASTA table: the header's first token, and the sequence stripped and upper-cased."""
    return fasta.select("idx", S.first_token(F.col("header")).alias("record_id"), F.upper(F.regexp_replace("sequence", r"^\s+|\s+$", "")).alias("sequence"))


def explode_kmers(records: DataFrame, k: int, ignore_n: bool = True, canonical: bool = False, alphabet: str = "AUTO") -> DataFrame:
    """(idx, pos, kmer) of every k-mer."""
    config.check_k(k)
    fold = config.canonical_applies(canonical, config.check_alphabet(alphabet))
    return records.select("idx", F.posexplode(S.kmers(F.col("sequence"), k, ignore_n, fold)).alias("pos", "kmer"))


def _folds(k: int, canonical: bool, alphabet: str) -> bool:
    config.check_k(k)
    return config.canonical_applies(canonical, config.check_alphabet(alphabet))


def _texts(found: np.ndarray | list) -> pa.Array:
    return pa.array(found, pa.binary() if isinstance(found, np.ndarray) else pa.string()).cast(pa.string())


def _places(record: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each record's k-mers begin, and each k-mer's place in its record."""
    begin = np.searchsorted(record, np.arange(n + 1))
    return begin, np.arange(len(record)) - begin[record]


def _rows(records: DataFrame, k: int, *columns: str, wanted: list[str] | None = None, ignore_n: bool = True, canonical: bool = False, alphabet: str = "AUTO") -> DataFrame:
    """columns, total and (kmer, count, first_pos) of each record's distinct k-mers, or of the wanted ones; total is the number of all
    its k-mers. Counted within the record: it needs none of another's, so nothing is shuffled."""
    fold = _folds(k, canonical, alphabet)
    kept = records.select(*columns, "sequence")
    names = [*columns, "total", "kmer", "count", "first_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = None if wanted is None else np.sort(windows.codes([w for w in wanted if len(w) == k], k, ignore_n=False)[3])
        for cells, texts in windows.chunks(batches, len(columns) + 1):
            letters, start, record, code = windows.codes(texts, k, ignore_n, fold)
            begin, pos = _places(record, len(texts))
            total = np.diff(begin)
            if want is not None:
                here = np.isin(code, want)
                start, record, code, pos = start[here], record[here], code[here], pos[here]
                begin, _ = _places(record, len(texts))
            each = [np.unique(code[x:y], return_index=True, return_counts=True) for x, y in zip(begin[:-1], begin[1:])]
            who = np.repeat(np.arange(len(texts)), [len(e[0]) for e in each])
            at = np.concatenate([e[1] + x for e, x in zip(each, begin)])
            n = np.concatenate([e[2] for e in each])
            out = [*[c.take(pa.array(who)) for c in cells], pa.array(total[who], pa.int64()), _texts(windows.spelled(letters, start[at], code[at], k, fold)), pa.array(n, pa.int64()), pa.array(pos[at], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = StructType([*kept.schema.fields[:-1], *StructType.fromDDL("total long, kmer string, count long, first_pos int").fields])
    return kept.mapInArrow(run, schema)


def per_record(records: DataFrame, k: int, **how) -> DataFrame:
    """(idx, kmer, count, first_pos)"""
    return _rows(records, k, "idx", **how).drop("total")


def global_counts(records: DataFrame, k: int, ignore_n: bool = True, canonical: bool = False, alphabet: str = "AUTO") -> DataFrame:
    """(kmer, count, n_records, first): first is where the k-mer first appears. A row without a k-mer stands for all records: its
    n_records is their number, those without k-mers included. K-mers of many records are added up before they become rows."""
    fold = _folds(k, canonical, alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (idx,), texts in windows.chunks(batches, 2, MANY):
            by = pc.sort_indices(idx).to_numpy()  # of records with a k-mer the lowest comes first
            idx, texts = idx.take(pa.array(by)), [texts[i] for i in by]
            letters, start, record, code = windows.codes(texts, k, ignore_n, fold)
            _, pos = _places(record, len(texts))
            order = np.argsort(code, kind="stable")
            code, record = code[order], record[order]
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            other = new.copy()
            other[1:] |= record[1:] != record[:-1]
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(code)))
            holders = np.add.reduceat(other, at, dtype=np.int64) if len(at) else n
            first = order[at]
            none = pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([len(texts)], pa.int64()), idx.slice(0, 1), pa.array([0], pa.int32())], names)
            yield none
            yield pa.RecordBatch.from_arrays([_texts(windows.spelled(letters, start[first], code[at], k, fold)), pa.array(n, pa.int64()), pa.array(holders, pa.int64()), idx.take(pa.array(record[at])), pa.array(pos[first], pa.int32())], names)

    names = ["kmer", "count", "n_records", "i", "p"]
    rows = records.select(F.col("idx").cast("long").alias("idx"), "sequence").mapInArrow(run, "kmer string, count long, n_records long, i long, p int")
    # numbers alone, which Spark adds up in place; a struct to be the least of would have all rows sorted
    added = rows.groupBy("kmer").agg(F.sum("count").alias("count"), F.sum("n_records").alias("n_records"), F.min("i").alias("i"), F.min_by("p", "i").alias("p"))
    return added.select("kmer", "count", "n_records", F.struct(F.col("i").alias("idx"), F.col("p").alias("first_pos")).alias("first"))


def totals(counts: DataFrame) -> DataFrame:
    """One row of global_counts(): total_records (all, also those without k-mers) and total_kmers."""
    return counts.agg(F.coalesce(F.max(F.when(F.col("kmer").isNull(), F.col("n_records"))), F.lit(0)).alias("total_records"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_kmers"))


def motifs(records: DataFrame, k: int = config.Motifs.k, top: int = config.Motifs.top, min_count: int = config.Motifs.min_count, **how) -> DataFrame:
    """(kmer, count, freq, n_records, idf_like, first): the most frequent k-mers; ties go to the first to appear; top <= 0 keeps all.

    Frequencies refer to all k-mers, those below min_count and out of the top included."""
    counts = stash(global_counts(records, k, **how), "kmer-counts")
    ranked = counts.where(F.col("kmer").isNotNull() & (F.col("count") >= min_count))
    order = (F.desc("count"), F.asc("first"))
    ranked = ranked.orderBy(*order).limit(top) if top > 0 else ranked
    out = ranked.crossJoin(F.broadcast(totals(counts)))  # one row
    return out.select("kmer", "count", S.tf(F.col("count"), F.col("total_kmers")).alias("freq"), "n_records", S.idf(F.col("total_records"), F.col("n_records")).alias("idf_like"), "first").orderBy(*order)


def motifs_by_record(records: DataFrame, wanted: DataFrame, k: int = config.Motifs.k, **how) -> DataFrame:
    """(idx, record_id, kmer, count, freq_in_record, first_pos) of the wanted k-mers; shares are of all the record's k-mers."""
    some = [r["kmer"] for r in wanted.select("kmer").limit(WANTED + 1).collect()]
    if len(some) <= WANTED:
        kept = _rows(records, k, "idx", "record_id", wanted=some, **how)
    else:
        kept = _rows(records, k, "idx", "record_id", **how).join(wanted.select("kmer"), "kmer", "left_semi")
    return kept.select("idx", "record_id", "kmer", "count", S.tf(F.col("count"), F.col("total")).alias("freq_in_record"), "first_pos")


def summary(records: DataFrame, k: int, top: int, min_count: int, **how) -> DataFrame:
    """One row: total_records, total_kmers, unique_kmers, unique_after_filters."""
    counts = global_counts(records, k, **how)
    # all of it is one aggregation over the k-mers' counts
    real = F.col("kmer").isNotNull()
    one = counts.agg(
        F.coalesce(F.max(F.when(~real, F.col("n_records"))), F.lit(0)).alias("total_records"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_kmers"),
        F.count_if(real).alias("unique_kmers"), F.count_if(real & (F.col("count") >= min_count)).alias("frequent"),
    )
    kept = F.least("frequent", F.lit(top).cast("long")) if top > 0 else F.col("frequent")
    return one.select("total_records", "total_kmers", "unique_kmers", kept.alias("unique_after_filters"))

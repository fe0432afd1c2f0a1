"""Sequences from the driver's documents, which hold prose: letters become bases in a fixed cycle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters and the bases they stand for; an accented letter becomes N, the rest goes.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz*"
BASES = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTACN"
KEPT = "[^A-Za-zÀ-ÖØ-öø-ÿ]"
#: The same for bytes of Latin-1, which has all letters that stay: what each becomes, and those that go.
_BASE = bytearray(b"N" * 256)
for _letter, _base in zip(LETTERS, BASES):
    _BASE[ord(_letter)] = ord(_base)
_GONE = bytes(x for x in range(256) if not (chr(x).isascii() and chr(x).isalpha() or x >= 0xC0 and x not in (0xD7, 0xF7)))

#: The same in DuckDB, as a common table.
SQL = f"""enc AS (
  SELECT doc_id AS idx, 'DOC' || doc_id || '.1' AS record_id, lang, source, 'DOC' || doc_id || '.1 ' || lang AS header,
         translate(regexp_replace(regexp_replace(text, '{KEPT}', '', 'g'), '[^A-Za-z]', '*', 'g'), '{LETTERS}', '{BASES}') AS sequence
  FROM documents),
met AS (
  SELECT *, length(sequence) AS length, length(sequence) - length(replace(sequence, 'N', '')) AS n_count,
         length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')) AS gc FROM enc),
judged AS (
  SELECT *, CASE WHEN length > 0 THEN n_count::DOUBLE / length ELSE 1.0 END AS n_frac,
         CASE WHEN length = 0 THEN 0.0 WHEN length > n_count THEN gc::DOUBLE / (length - n_count) * 100 ELSE gc::DOUBLE / length * 100 END AS gc_percent FROM met),
quality AS (
  SELECT *, CASE WHEN length = 0 THEN 'empty_after_clean' WHEN length < 200 THEN 'too_short' WHEN n_frac > 0.05 THEN 'too_many_N' END AS reason FROM judged),
passing AS (SELECT * FROM quality WHERE reason IS NULL)"""


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts as bases. A table of bytes takes a tenth of the time that patterns take in the JVM."""
    for b in batches:
        for part in pa.Table.from_batches([b]).to_batches(max_chunksize=1000):
            text = [None if x is None else x.encode("latin-1", "ignore").translate(_BASE, _GONE).decode("ascii") for x in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string())], ["idx", "lang", "source", "sequence"])


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, header, sequence, lang, source), idx being doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("idx"), "lang", "source", "text")
    rows = docs.mapInArrow(_encoded, "idx long, lang string, source string, sequence string")
    return rows.select("idx", F.concat(F.lit("DOC"), "idx", F.lit(".1 "), "lang").alias("header"), "sequence", "lang", "source")

"""The corpus pipeline: documents in, tokens of clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. No stage swallows an error.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import scratch
from helixframe.llm import decontaminate, jaccard_join, language_id, sentence_pieces, suffix_dedup
from helixframe.llm.common import keyed, new_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def of_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents. The pipeline holds its session to small batches for Python workers, as its stages are run after
    they have returned: long texts come ten thousand to a batch otherwise, in a worker and in its JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(scratch.BATCH_ROWS))
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves away documents without a language: no text, or no letter in it. The model is learned from the labelled rows."""
    docs = of_documents(spark, docs)
    found = language_id.identify(docs, language_id.train(docs.where(~language_id.held_out())), carry=COLUMNS[1:])
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked by five-word shingles of similarity 0.8 or more.

    Rows are one document if they share id and text. Other rows of a null or repeated id are documents of their own, linked by
    their texts alone; a null id counts as larger than all others."""
    docs, new = keyed(of_documents(spark, docs), nulls=True)
    found = jaccard_join.join(docs, 5, Fraction(4, 5), id_col="key").select(F.col("doc_id").alias("key"), "component_id")
    found = found.join(new.select("key", F.col("doc_id").alias("id"), F.lit(True).alias("is_new")), "key", "left")
    found = found.withColumn("id", F.when(F.col("is_new"), F.col("id")).otherwise(F.col("key")))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    return docs.join(first.select(F.col("first.key").alias("key")), "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes of strings of 100 bytes that occur earlier; a character cut in two goes whole. Documents of which
    nothing is left go. Rows without an id come after all others, texts of one id in the order of their hashes, and each is cut
    by its own runs."""
    done = suffix_dedup.dedup(of_documents(spark, docs), 100, carry=("lang", "source"))
    rest = done.where("size(spans) = 0 or kept_text != ''").select("doc_id", F.col("kept_text").alias("text"), "lang", "source")
    return rest.withColumn("n_chars", F.length("text").cast("long"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves away documents of whose words at least a twentieth are in passages of 13 words of the benchmark."""
    hits = decontaminate.find_hits(of_documents(spark, docs), table(spark, sf_dir, "benchmark", "item_id", "text"), carry=COLUMNS[1:])
    return decontaminate.judged(hits, carry=COLUMNS[1:]).where("not contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, with digests of ids and of the decoded text."""
    import public_tokenizers

    done = sentence_pieces.transcode(of_documents(spark, docs), public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.digests(done)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: SQL can't express language identification and SentencePiece; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_folder(spark, f"pipeline-{name}")
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    raise ValueError("STAGES is empty")

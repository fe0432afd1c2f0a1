"""The stateless part of the filter over a stream of records. Deduplication and caps need all earlier records and are
batch operators. This is an addition; nothing else in the library needs it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import filter as Q


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(idx, header, sequence) of records in JSON-lines files (header, sequence) that arrive in a folder."""
    return spark.readStream.schema("idx long, header string, sequence string").json(folder)


def judged(records: DataFrame, min_len: int = config.Filter.min_len, max_n_frac: float = config.Filter.max_n_frac, alphabet: str = config.Filter.alphabet) -> DataFrame:
    """Records with metrics and reason, as in the batch filter without deduplication and caps."""
    done = Q.quality(Q.measured(Q.records_of(records), alphabet), min_len, max_n_frac)
    return done.withColumn("reason", F.coalesce("reason", F.lit("ok"))).withColumn("kept", F.col("reason") == "ok")

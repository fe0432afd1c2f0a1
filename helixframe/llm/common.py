"""What the operators of this subpackage share: tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import drop, file_system, free_shuffles, new_folder, small_batches, stash, stash_map, stash_slim


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; Parquet then reads no others."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def cores(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def keyed(df: DataFrame, nulls: bool) -> tuple[DataFrame, DataFrame]:
    """df (doc_id, text and more) with a ``key``, and (key, doc_id) of the keys that aren't ids.

    The key is the id where one row has it. Rows of an id that several rows have, and with ``nulls`` those of none, get a new
    key for each text, outside the range of ids; equal rows share it. Without ``nulls`` a null id has a null key.
    Texts are told apart by 128 bits of hash within their id."""
    from pyspark.sql import functions as F

    several = df.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1" if nulls else "doc_id is not null and n > 1")
    several = stash_slim(several.select(F.col("doc_id").alias("id")), "keys-ids")
    if several.isEmpty():
        return df.withColumn("key", F.col("doc_id")), several.select(F.col("id").alias("key"), F.col("id").alias("doc_id"))
    least, most = df.agg(F.min("doc_id"), F.max("doc_id")).first()
    marks = {"__m1": F.xxhash64("text"), "__m2": F.xxhash64(F.lit(1), "text")}
    texts = df.select("doc_id", *[c.alias(x) for x, c in marks.items()])
    texts = texts.join(several, texts["doc_id"].eqNullSafe(several["id"]), "left_semi").distinct()
    number = F.monotonically_increasing_id()
    new = stash_slim(texts.select(F.col("doc_id").alias("id"), F.col("__m1").alias("m1"), F.col("__m2").alias("m2"), (number + ((most or 0) + 1) if (most or 0) < 1 << 62 else (least - 1) - number).alias("new")), "keys-new")
    drop(several)
    marked = df.withColumns(marks)
    met = marked.join(new, marked["doc_id"].eqNullSafe(new["id"]) & (F.col("__m1") == F.col("m1")) & (F.col("__m2") == F.col("m2")), "left")
    return met.select(*df.columns, F.coalesce("new", "doc_id").alias("key")), new.select(F.col("new").alias("key"), F.col("id").alias("doc_id"))


def in_order(df: DataFrame) -> tuple[DataFrame, bool]:
    """df (doc_id, text and more) with a ``key`` that is never null and orders rows as their ids do, null ids last; and whether
    each row has a key of its own.

    The key is the id where no id is null or repeated. Otherwise rows are numbered by a sort of (id, hash of the text); equal
    rows share a number. The sort cuts an id that very many rows have over many tasks."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    bad = df.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1")
    if bad.isEmpty():
        return df.withColumn("key", F.col("doc_id")), True
    marks = {"__m1": F.xxhash64("text"), "__m2": F.xxhash64(F.lit(1), "text")}
    slim = stash_slim(df.select("doc_id", *[c.alias(x) for x, c in marks.items()]).distinct(), "keys-marks")
    by = (F.col("doc_id").asc_nulls_last(), "__m1", "__m2")
    numbered = slim.repartitionByRange(cores(spark), *by).sortWithinPartitions(*by)
    numbered = stash_slim(numbered.select(F.col("doc_id").alias("id"), F.col("__m1").alias("m1"), F.col("__m2").alias("m2"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")), "keys-numbered")
    drop(slim)
    before, rows = 0, []
    for r in numbered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        rows.append((r["part"], before))
        before += r["n"]
    new = numbered.join(F.broadcast(spark.createDataFrame(rows, "part int, before long")), "part").select("id", "m1", "m2", (F.col("before") + F.col("nth")).alias("key"))
    marked = df.withColumns(marks)
    met = marked.join(new, marked["doc_id"].eqNullSafe(new["id"]) & (F.col("__m1") == F.col("m1")) & (F.col("__m2") == F.col("m2")))
    return met.select(*df.columns, "key"), False


class Shared:
    """A broadcast value whose classes travel with it, so that workers need no installed copy of them."""

    def __init__(self, spark: SparkSession, value) -> None:
        from pyspark import cloudpickle

        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        import pickle

        return pickle.loads(self.sent.value)

    def drop(self) -> None:
        """Frees it everywhere, once no plan needs it any more."""
        self.sent.destroy()


class FileSink:
    """A file of a task attempt. Its name is unique, so that a retried or speculative attempt never overwrites or
    doubles another's; readers open only the files that the manifest of the finished job lists."""

    def __init__(self, folder: str, suffix: str) -> None:
        import os
        import uuid

        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}{suffix}"
        self.uri = f"{folder.rstrip('/')}/{name}"
        self.stream = store.open_output_stream(os.path.join(root, name), compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def read_files(spark: SparkSession, folder: str, uris: list[str]) -> DataFrame:
    """(path, content) of the listed files of a folder, through Spark's own reader.

    The list has one entry per written file, so it grows with the number of tasks, not with rows."""
    from pyspark.sql import functions as F

    if not uris:
        return spark.createDataFrame([], "path string, content binary")
    names = spark.createDataFrame([(u.rsplit("/", 1)[1],) for u in uris], "name string")
    found = spark.read.format("binaryFile").load(folder).select("path", "content")
    return found.join(F.broadcast(names), F.substring_index("path", "/", -1) == F.col("name"), "left_semi")


__all__ = ["FileSink", "Shared", "cores", "drop", "free_shuffles", "in_order", "keyed", "new_folder", "read_files", "small_batches", "stash", "stash_map", "stash_slim", "table"]

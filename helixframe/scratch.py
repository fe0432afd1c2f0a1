"""The scratch folder that all executors share, and tables kept there. Nothing here lives on one machine alone.

What an operator reads only itself it deletes; what a lazy result still reads stays until ``sweep()``, which runs by itself
when the driver's Python ends."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


#: Rows that go to a Python worker at once, and bytes of a row group in the making; both are held by every task.
BATCH_ROWS, ROW_GROUP = 1000, 16 << 20
#: The same of rows that pass a worker as they are, which bytes bound as well.
SLIM_ROWS, BATCH_BYTES = 10_000, 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int | None = None):
    """Keeps batches for Python workers small while a job over long texts runs, by rows and, if given, by bytes, and puts the session's
    settings back."""
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} | ({"spark.sql.execution.arrow.maxBytesPerBatch": str(size)} if size else {})
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir or, where that is unset and all tasks run in the driver's own
    process, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            base = have.get()
        elif (master := spark.sparkContext.master) == "local" or master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="helixframe-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base if ":/" in base else "file://" + base


#: Folders made by a driver, which sweep() deletes.
_made: dict[str, SparkSession] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{scratch(spark).rstrip('/')}/helixframe/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


def sweep() -> None:
    """Deletes every scratch table and file of this driver; lazy results that read them can't be run any more."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may have ended, and its folder gone with it
            delete(spark, path)


atexit.register(sweep)


def file_system(uri: str):
    """(Arrow's file system, path in it) of a URI. Spark's names of object stores that Arrow calls otherwise are understood."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}.get(scheme, scheme) + colon + rest)


#: Writing to a local or mounted folder, Hadoop starts processes that set permissions, four a file, and each counts for a moment as
#: a second copy of its JVM's memory. Without files of checksums and marks of success there are two. Other stores aren't concerned.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.options(**_PLAIN_FILES).option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def stash_map(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType, name: str, rows: int = BATCH_ROWS, size: int | None = None) -> DataFrame:
    """As stash(df.mapInArrow(run, schema), name), but Python workers write the files, so that rows don't go back through the JVM.

    A task attempt writes a file under a name of its own and gives that name; files of attempts that didn't count are deleted before
    the folder is read, so that retried tasks leave no trace."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    path = new_folder(spark, name)
    kinds = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kinds)

    def write(batches):
        import pyarrow.parquet as pq

        stream = writer = file = None
        waiting, size = [], 0

        def flush():
            nonlocal stream, writer, file, waiting, size
            if not waiting:
                return
            if writer is None:
                store, root = file_system(path)
                store.create_dir(root, recursive=True)
                file = f"part-{uuid.uuid4().hex}.parquet"
                stream = store.open_output_stream(f"{root}/{file}", compression=None)
                writer = pq.ParquetWriter(stream, arrow, compression="zstd", compression_level=1, use_dictionary=False, write_statistics=False)
            writer.write_table(pa.Table.from_batches(waiting).cast(arrow))
            waiting, size = [], 0

        for b in run(batches):
            if b.num_rows:
                waiting.append(b)
                size += b.nbytes
            if size >= ROW_GROUP // 2:
                flush()
        flush()
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

    with small_batches(spark, rows, size):
        files = {r["file"] for r in df.mapInArrow(write, "file string").collect()}  # a row a task
    if files:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in store.listStatus(at):
            if x.getPath().getName() not in files:
                store.delete(x.getPath(), False)
        out = spark.read.schema(kinds).parquet(path)
    else:
        out = spark.createDataFrame([], kinds)
    out._stashed_at = path
    return out


def stash_slim(df: DataFrame, name: str) -> DataFrame:
    """As stash(df, name), but Python workers write the files: executors then start no process for a file, and their JVMs hold no
    writers. Not for a df whose last stage runs Python itself, as each of its tasks would have two workers."""
    kinds = StructType([StructField(x.name, x.dataType) for x in df.schema])  # as files are read: all may be null
    return stash_map(df, lambda batches: batches, kinds, name, SLIM_ROWS, BATCH_BYTES)


def drop(*stashed: DataFrame) -> None:
    """Deletes what stash() wrote, once nothing reads it any more."""
    for df in stashed:
        delete(df.sparkSession, df._stashed_at)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and broadcasts of plans that nothing refers to any more, on all executors. It acts
    on what the driver's garbage collection finds, which may otherwise not run for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""FASTA readers. Records are cut by Spark's own line separator, so one large file is read by many tasks, however its headers are
indented.

``idx`` is a record's place over all files in order of path. It comes from counts of each split, so no window runs over
all records in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..scratch import stash


def _trimmed_lines(body: Column) -> Column:
    """Lines without outer white space, joined; inner white space stays."""
    return F.array_join(F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "")


def ordinals(rows: DataFrame, path: str, block: str) -> DataFrame:
    """rows with ``idx`` from 0, by path, block and place in the block. Has one small window over the splits alone."""
    marked = rows.withColumn("__in", F.monotonically_increasing_id())
    local = Window.partitionBy(path, block).orderBy("__in")
    numbered = marked.withColumn("__at", F.row_number().over(local) - 1)
    per_split = rows.groupBy(path, block).agg(F.count("*").alias("__n"))
    before = per_split.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(path, block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return numbered.join(F.broadcast(before), [path, block]).withColumn("idx", (F.col("__before") + F.col("__at")).cast("long")).drop("__in", "__at", "__before", path, block)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(idx, header, body, lead) of each record; lead is the text that stands before the first header of its file, for the file's first
    record alone.

    Every > cuts, and one that no line begins with is put back: white space may precede a header, so that Spark's separator can't
    tell headers from the rest. A split's records are found by a window over its own pieces; what continues from one split into the
    next is known from a row a split, and such pieces alone are read again and joined to their record."""
    text = spark.read.option("lineSep", ">").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value", F.monotonically_increasing_id().alias("k")
    )
    bare = F.rtrim("value", F.lit(" \t\x0b\f"))
    text = text.withColumn("opens", bare.endswith("\n") | bare.endswith("\r"))  # what follows the next > is a header
    per = text.groupBy("path", "block").agg(
        F.max("size").alias("size"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_if("opens").alias("opened"),
        F.max_by("opens", "k").alias("last"), F.min_by(bare == "", "k").alias("blank"), F.min(F.when(F.col("opens"), F.col("k"))).alias("opener"),
    )
    # a file that begins with white space and a header opens with its first piece
    blank = (F.col("block") == 0) & F.col("blank")
    per = per.withColumns({"blank": blank, "opened": F.col("opened") + blank.cast("long"), "last": F.col("last") | (blank & (F.col("n") == 1)), "opener": F.when(blank, F.col("low")).otherwise(F.col("opener"))})
    # after a > at a file's very end no piece comes; sizes tell, of which a byte order mark may be a part
    whole, ordered = Window.partitionBy("path"), Window.partitionBy("path").orderBy("block")
    per = per.withColumn("bare_end", (F.sum("bytes").over(whole).isin([F.col("size"), F.col("size") - 3])) & (F.col("block") == F.max("block").over(whole)) & ~F.col("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$"))
    per = per.withColumn("last", F.col("last") & ~F.col("bare_end")).withColumn("follows", F.coalesce(F.lag("last").over(ordered), F.lit(False)))
    per = per.withColumn("heads", F.col("follows").cast("long") + F.col("opened") - F.col("last").cast("long"))
    earlier, later = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    some = F.when(F.col("heads") > 0, F.col("block"))
    before = F.coalesce(F.sum("heads").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"before": before, "back": F.last(some, ignorenulls=True).over(earlier), "ahead": F.first(some, ignorenulls=True).over(later)})
    splits = stash(per, "fasta-splits")
    ends = splits.where("bare_end").select("path", "block", "size", F.lit("").alias("value"), (F.col("high") + 1).alias("k"), F.lit(False).alias("opens"))
    text = text.unionByName(ends).drop("size")
    # pieces before the first header of a split go to the last record before or, if there is none, before the first record of the file
    own = F.broadcast(splits.select("path", "block", "follows", "opener", "back", "ahead"))
    loose = text.join(own, ["path", "block"]).where(~F.col("follows") & (F.col("k") <= F.coalesce("opener", F.lit((1 << 63) - 1)))).where("back is not null or ahead is not null")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["value"]), ">")
    piece = F.struct("block", "k", "value")
    loose = loose.groupBy("path", F.coalesce("back", "ahead").alias("to")).agg(joined(F.when(F.col("back").isNotNull(), piece)).alias("after"), F.count("back").alias("n_after"), joined(F.when(F.col("back").isNull(), piece)).alias("lead"))
    loose = loose.select("path", F.col("to").alias("block"), F.when(F.col("n_after") > 0, F.concat(F.lit(">"), "after")).alias("after"), "lead")
    at = Window.partitionBy("path", "block").orderBy("k")
    placed = text.withColumn("opens", F.col("opens") | ((F.col("block") == 0) & (F.row_number().over(at) == 1) & (bare == "")))
    placed = placed.join(F.broadcast(splits.select("path", "block", "follows", "heads", "before")), ["path", "block"])
    placed = placed.withColumn("nth", F.sum(F.coalesce(F.lag("opens").over(at), "follows").cast("long")).over(at.rowsBetween(Window.unboundedPreceding, 0))).where("nth > 0")
    whole = placed.groupBy("path", "block", "nth").agg(joined(F.struct("k", "value")).alias("record"), F.first("heads").alias("heads"), F.first("before").alias("before"))
    met = whole.join(loose, ["path", "block"], "left")
    met = met.withColumn("record", F.concat("record", F.when(F.col("nth") == F.col("heads"), F.coalesce("after", F.lit(""))).otherwise("")))
    return met.select(
        (F.col("before") + F.col("nth") - 1).alias("idx"), F.regexp_extract("record", r"^([^\r\n]*)", 1).alias("header"), F.regexp_replace("record", r"^[^\r\n]*", "").alias("body"),
        F.when(F.col("nth") == 1, F.coalesce("lead", F.lit(""))).otherwise("").alias("lead"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(idx, header, sequence). Lines are stripped, blank ones skipped, those before the first header dropped; a header keeps
    what stands after its >, which white space may precede."""
    return _pieces(spark, path).select("idx", F.regexp_replace("header", r"\s+$", "").alias("header"), _trimmed_lines(F.col("body")).alias("sequence"))


def read_records(spark: SparkSession, path: str, uppercase: bool = True, convert_u_to_t: bool = False) -> DataFrame:
    """(idx, identifier, description, sequence), in the dialect that splits trimmed headers and puts lines that stand before
    the first header of a file at the start of its first record."""
    seq = F.concat(_trimmed_lines(F.col("lead")), _trimmed_lines(F.col("body")))
    seq = F.upper(seq) if uppercase else seq
    seq = F.translate(seq, "Uu", "TT") if convert_u_to_t else seq
    ident, description = S.split_header(F.col("header"))
    return _pieces(spark, path).select("idx", ident.alias("identifier"), description.alias("description"), seq.alias("sequence"))

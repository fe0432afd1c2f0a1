"""JSON-lines metadata, cluster files and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Any other keys of a row survive in ``raw``.
FIELDS = "uid string, accession string, accessionversion string, organism string, taxname string, taxid long, title string, slen long, source_db string, query string"
MEMBER = "struct<record_id:string,accession:string,length:long,organism:string,taxid:long>"
CLUSTERS = f"cluster_id string, size long, members array<{MEMBER}>, mean_len double, dominant_organism string, n_unique_organisms long, max_pairwise_sim double, mean_pairwise_sim double"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The known fields, the line itself as ``raw``, and ``line``, which orders rows."""
    text = spark.read.text(path).where(F.trim("value") != "")
    rows = text.select(F.from_json("value", FIELDS, {"mode": "FAILFAST"}).alias("m"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("line"))
    return rows.select("m.*", "raw", "line")


def _name(c: str):
    return F.nullif(F.col(c), F.lit(""))


def _last(rows: DataFrame, key: str, *values: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.max_by(v, "line").alias(v) for v in values])


def organism_lookup(metadata: DataFrame) -> DataFrame:
    """(key, organism) by accession and by uid; rows without an organism are skipped; the last row of a key wins."""
    named = metadata.select(F.coalesce(_name("organism"), _name("taxname")).alias("organism"), F.array_compact(F.array(F.coalesce(_name("accession"), _name("accessionversion")), F.col("uid"))).alias("keys"), "line").where("organism is not null")
    # within a row the uid comes after the accession
    keyed = named.select("organism", F.posexplode("keys").alias("nth", "key"), "line").withColumn("line", F.struct("line", "nth"))
    return _last(keyed, "key", "organism")


def cluster_lookup(metadata: DataFrame) -> DataFrame:
    """(key, organism, taxid) by accession, else uid, else the word None; the last row of a key wins."""
    keyed = metadata.select(F.coalesce(_name("accession"), F.col("uid"), F.lit("None")).alias("key"), F.coalesce(_name("organism"), _name("taxname")).alias("organism"), "taxid", "line").where("key != ''")
    # max_by skips nothing: a later null replaces an earlier value
    return keyed.groupBy("key").agg(F.max_by(F.struct("organism", "taxid"), "line").alias("v")).select("key", "v.organism", "v.taxid")


def consensus_lookup(metadata: DataFrame) -> DataFrame:
    """(key, organism) by accession, else uid; rows with neither are skipped; the last row of a key wins."""
    keyed = metadata.select(F.coalesce(_name("accession"), _name("uid")).alias("key"), "organism", "line").where("key is not null")
    return keyed.groupBy("key").agg(F.max_by(F.struct("organism"), "line").alias("v")).select("key", "v.organism")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTERS).json(path)


def read_features(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header. Types are inferred unless given: long, double, boolean, else string; a column with missing values is
    no long. Cells that read as missing values become nulls."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    rows = reader.csv(path)
    # Cell texts that stand for a missing value.
    missing = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
    blank = rows.select(*[F.when(F.col(f"`{c}`").isin(missing), None).otherwise(F.col(f"`{c}`")).alias(c) for c in rows.columns])
    if schema:
        kinds = spark.createDataFrame([], schema).dtypes
        return blank.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds])
    whole, number = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    # Cell texts that stand for truth values.
    truth = ["True", "TRUE", "true", "False", "FALSE", "false"]
    seen = blank.agg(*[F.struct(F.count(x).alias("n"), F.count_if(x.rlike(whole)).alias("w"), F.count_if(x.rlike(number)).alias("f"), F.count_if(x.isin(truth)).alias("b"), F.count("*").alias("rows")).alias(f"c{i}") for i, x in enumerate(F.col(f"`{c}`") for c in blank.columns)]).first()
    kind = lambda s: "long" if s["n"] and s["w"] == s["n"] == s["rows"] else "double" if s["f"] == s["n"] else "boolean" if s["b"] == s["n"] else "string"
    return blank.select(*[F.trim(F.col(f"`{c}`")).cast(k).alias(c) if (k := kind(seen[i])) != "string" else F.col(f"`{c}`") for i, c in enumerate(blank.columns)])


def read_metadata_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with whatever columns they have."""
    return spark.read.json(path)



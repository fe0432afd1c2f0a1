"""Sharding with a permutation-filled lookup table (operator 1).

Method. Every shard has a permutation of the table's slots, given by an offset and a step that come from its name's
hash; the table's size is prime, so every step visits every slot. Shards take turns and each claims the first free slot
of its own order, until all are taken: shares differ by at most one slot (by weight, where weights are given), and few
keys move when a shard comes or goes. A key's slot is its hash modulo the table's size.

The table has a fixed size, whatever the data: it is broadcast and looked up in constant time by a hash join, and the
data are neither shuffled nor sent to Python.

Defined results: a null key goes to the slot of the empty string; equal keys go to the same shard; an empty table gives
an empty result; columns of the input stay, and ``key_hash``, ``slot`` and ``shard`` replace any of the same names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: 15 hex digits of an MD5, a non-negative 60-bit number that Spark and other engines can both compute.
DIGITS = 15
#: Production parameters: a prime of about a hundred slots for each of the shards.
SHARDS, SLOTS = 16, 1607


def md5_60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill(names: list[str], slots: int, weights: list[float] | None = None) -> list[int]:
    """The number of the shard that owns each slot."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need names, each its own")
    if slots < len(names) or slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be a prime, and not less than the number of shards")
    weights = weights or [1.0] * len(names)
    if len(weights) != len(names) or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    place = [md5_60("offset:" + n) % slots for n in names]
    step = [md5_60("step:" + n) % (slots - 1) + 1 for n in names]
    owner, left, credit, top = [-1] * slots, slots, [0.0] * len(names), max(weights)
    while left:
        for k in range(len(names)):
            credit[k] += weights[k] / top
            if credit[k] < 1 or not left:
                continue
            credit[k] -= 1
            while owner[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % slots
            owner[place[k]] = k
            left -= 1
    return owner


def assign(df: DataFrame, key: str, names: list[str], slots: int, weights: list[float] | None = None) -> DataFrame:
    """df with key_hash, slot and shard (its name)."""
    spark = df.sparkSession
    owner = fill(names, slots, weights)
    lookup = spark.createDataFrame([(i, names[k]) for i, k in enumerate(owner)], "slot int, shard string")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = df.drop(*[c for c in ("slot", "shard", "key_hash") if c != key])
    placed = placed.withColumn("__hash", F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, DIGITS), 16, 10).cast("long")).withColumn("__slot", (F.col("__hash") % slots).cast("int"))
    out = placed.join(F.broadcast(lookup.select(F.col("slot").alias("__at"), F.col("shard").alias("__shard"))), F.col("__slot") == F.col("__at"))
    return out.drop("__at").drop(*[c for c in ("slot", "shard", "key_hash") if c == key]).withColumnsRenamed({"__hash": "key_hash", "__slot": "slot", "__shard": "shard"})


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    # the size of what is placed, read from the texts, for balancing reports on the result
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    placed = assign(rows, "doc_id", shard_names(SHARDS), SLOTS)
    return placed.select("doc_id", "n_bytes", "key_hash", F.col("slot").cast("long").alias("slot"), "shard")


ORACLE = f"""
WITH RECURSIVE names AS (
  SELECT i AS k, printf('shard-%04d', i) AS name FROM range({SHARDS}) t(i)),
prefs AS (
  SELECT k, name, ('0x' || substr(md5('offset:' || name), 1, {DIGITS}))::BIGINT % {SLOTS} AS o,
         ('0x' || substr(md5('step:' || name), 1, {DIGITS}))::BIGINT % {SLOTS - 1} + 1 AS s FROM names),
orders AS (
  SELECT k, list((o + s * j) % {SLOTS} ORDER BY j) AS slots FROM prefs, range({SLOTS}) t(j) GROUP BY k),
turns AS (
  SELECT 0 AS turn, [-1 FOR i IN range(0)]::BIGINT[] AS taken
  UNION ALL
  SELECT turn + 1, list_append(taken, list_filter(orders.slots, lambda x: NOT list_contains(taken, x))[1])
  FROM turns JOIN orders ON orders.k = turn % {SHARDS} WHERE turn < {SLOTS}),
owner AS (
  SELECT unnest(range({SLOTS})) AS turn, unnest(taken) AS slot FROM turns WHERE turn = {SLOTS}),
hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT AS key_hash FROM documents)
SELECT doc_id, n_bytes, key_hash, (key_hash % {SLOTS})::BIGINT AS slot, name AS shard
FROM hashed JOIN owner ON owner.slot = key_hash % {SLOTS} JOIN names ON names.k = owner.turn % {SHARDS}
"""

"""Benchmark decontamination with one Aho-Corasick automaton (operator 4).

Method. Test items are normalised to words and cut into windows of ``window`` consecutive words (a shorter item is one
window). All windows go into one Aho-Corasick automaton, with a space at either end so that matches keep to word
bounds. Each document is normalised the same way, once, and scanned once; a match's end is mapped to word numbers, and
through them to byte offsets of the original text.

The automaton's patterns are broadcast. Their size is checked against ``max_bytes`` before anything is collected;
beyond it the items are dealt into blocks under the bound, each block scans all documents, and the hit words of a
document are united over the blocks, so that the answer stays whole.

Defined results: a null or empty text has no words and no hit; null or wordless items match nothing; a null item_id
marks words but is not listed; repeated items and rows count as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Bytes to what they count as: digits, a-z and all bytes of non-ASCII characters stay, A-Z are lower-cased, the rest parts words.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
SCHEMA = "doc_id long, n_words long, spans array<struct<first:int,last:int,first_byte:int,last_byte:int>>, items array<long>"


def windows(text: str | None, window: int) -> list[bytes]:
    words = (text or "").encode().translate(FOLD).split()
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def automaton(items: list[tuple[int | None, str | None]], window: int):
    import ahocorasick

    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(text, window):
            owners.setdefault(w, set()).add(item)
    out = ahocorasick.Automaton()
    for w, ids in owners.items():
        out.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, frozenset(ids)))
    if owners:
        out.make_automaton()
    return out if owners else None


def scan(text: str | None, found):
    """(number of words, hit word spans [first, last], their byte spans in the original, item ids)."""
    import numpy as np

    raw = (text or "").encode()
    words = raw.translate(FOLD).split()
    if found is None or not words:
        return len(words), [], set()
    hits, items = [], set()
    for end, (n, ids) in found.iter(f" {b' '.join(words).decode('latin-1')} "):
        hits.append((end, n))
        items |= ids
    if not hits:
        return len(words), [], items
    ends = np.cumsum([len(w) + 1 for w in words])  # place of the space after each word
    spans: list[list[int]] = []
    for last, n in sorted((int(np.searchsorted(ends, e)), n) for e, n in hits):
        first = last - n + 1
        while spans and spans[-1][1] >= first - 1:
            first = min(first, spans.pop()[0])
        spans.append([first, last])
    folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[0, folded, 0].astype(np.int8)))
    return len(words), [(a, b, int(edge[2 * a]), int(edge[2 * b + 1])) for a, b in spans], items


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, spans, items) and the columns in carry: spans hold the first and last hit word and the bytes of the
    original they take."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # a window is held about `window` times over, so the bound is on what the automaton holds
    size = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * window
    blocks = -(-size // max_bytes) or 1
    extra = [(c, k) for c, k in docs.dtypes if c in carry]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c, _ in extra])
    if blocks > 1:
        # each block scans the same stashed rows; what is carried meets the united hits by row
        docs = whole = stash(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
        docs, extra = docs.select("doc_id", "__text", "__row"), [("__row", "long")]

    def block(k: int) -> DataFrame:
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = automaton(sent.value, window)
            for b in (x.slice(at, 500) for x in batches for at in range(0, x.num_rows, 500)):
                rows = [scan(t, found) for t in b.column(1).to_pylist()]
                spans = [[dict(zip(("first", "last", "first_byte", "last_byte"), s)) for s in r[1]] for r in rows]
                kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "first_byte", "last_byte")]))
                cols = [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, kind), pa.array([sorted(i for i in r[2] if i is not None) for r in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, *b.columns[2:]], ["doc_id", "n_words", "spans", "items", *[c for c, _ in extra]])

        return docs.mapInArrow(run, SCHEMA + "".join(f", `{c}` {k}" for c, k in extra))

    if blocks == 1:
        return block(0)
    out = block(0)
    for k in range(1, blocks):
        out = out.unionByName(block(k))
    merged = out.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    united = """aggregate(s, cast(array() as array<struct<first:int,last:int,first_byte:int,last_byte:int>>), (done, x) ->
        if(size(done) > 0 and element_at(done, -1).last >= x.first - 1,
           concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, x.last),
                  'first_byte', element_at(done, -1).first_byte, 'last_byte', greatest(element_at(done, -1).last_byte, x.last_byte)))),
           concat(done, array(x))))"""
    done = merged.select("doc_id", "n_words", F.expr(united).alias("spans"), "items", "__row")
    return done.join(whole.select("__row", *carry), "__row").drop("__row") if carry else done.drop("__row")


def judged(hits: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The contract's columns, and those in carry: a document is contaminated if at least a twentieth of its words are hit."""
    n_hit = F.expr("cast(aggregate(spans, 0, (n, s) -> n + s.last - s.first + 1) as long)")
    out = hits.select(*carry, "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(find_hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")))


#: What an empty list of items hashes to, for tests.
NO_ITEMS = hashlib.sha256(b"").hexdigest()

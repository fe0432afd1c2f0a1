"""N-gram Jaccard join with a token-group matrix (operator 7).

Method. A document is its set of distinct word n-grams (64-bit hashes). Documents with equal sets are one class, and only its
smallest id goes on. Two sets of similarity t or more share at least one token among the first n - ceil(t n) + 1 of each, in any
fixed order of all tokens; the order is by document frequency, tokens that occur once first, then by hash. Tokens that occur
in one document can't be shared, so most documents drop out there.

The others are partitioned into groups of similar documents, and the matrix says which tokens each group's union holds.

1. Documents are dealt by a rare token they share into groups, and each group is opened on itself, twice with different
   tokens. The links found make first components. Groups have about four times the root of the number that are dealt
   together, within ``GROUPS``, so that the pairs of a document and a group grow less than its square.
2. Groups are made anew: a component's documents together, single ones by a shared token. The matrix row of a token lists
   the groups whose union holds it. A query document meets, through its tokens, the groups that could hold a partner
   and that are not wholly of its own component; sizes out of range are left away.
3. Only groups whose full token union overlaps the query by at least t of the query's size are opened; the overlaps with
   all members come from one look-up of the query's tokens in the group's token-member bit matrix.

Links are exact: the prefix, size and union bounds lose none. What is returned is a spanning forest of them. Pairs
inside a component that is already known are not compared, so a large group of near copies costs about its size.
Queries that meet one group are dealt out over tasks, with the group's sets beside each lot.

Defined results: a text without words, or null, has an empty set and links with nothing; fewer words than n are one
n-gram; a null id links with nothing and has a null component; equal rows are of one class; rows that share an id but not the text
are documents of their own keys that are linked through it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Forest, components
from . import frequency
from .common import Shared, cores, drop, free_shuffles, keyed, stash, stash_map, stash_slim, table
from .frequency import Packer, Spread, bit_table, mix, repeated

#: A-Z to a-z; words are then what bytes.split() gives, cut at 0x20 and 0x09 to 0x0D.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Frequencies that tell rare tokens from common ones; the first also tells single ones.
LEVELS = (2, 8, 64, 1024)
GROUPS = (64, 4096)
QUERIES = 512
#: About how many groups a row of the matrix lists at most.
ROW = 2048


class Words(dict):
    """word -> 64-bit hash, each word hashed once; cleared when it gets too large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int, words: Words) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list]]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def needed(n, t: Fraction):
    """The least overlap that a partner of a set of n can have."""
    return -(-t.numerator * n // t.denominator)


class Group:
    """The token-member bit matrix of a group: each token of the union, and which members hold it."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.sizes = ids, np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.union, row = np.unique(tokens, return_inverse=True)
        self.bits = np.zeros((len(self.union), (len(sets) + 7) // 8), np.uint8)
        np.bitwise_or.at(self.bits, (row, owner >> 3), np.uint8(1) << (owner & 7).astype(np.uint8))

    def linked(self, query: np.ndarray, t: Fraction) -> list[int]:
        """The numbers of the members that link with a query set."""
        n = len(query)
        if not n or not len(self.union):
            return []
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        hit = at[self.union[at] == query]
        if len(hit) < needed(n, t):  # the bound: the group isn't opened
            return []
        both = np.zeros(self.bits.shape[1] * 8, np.int64)
        for i in range(0, len(hit), 4096):
            both += np.unpackbits(self.bits[hit[i : i + 4096]], axis=1, bitorder="little").sum(0, dtype=np.int64)
        both = both[: len(self.ids)]
        return np.flatnonzero(t.denominator * both >= t.numerator * (n + self.sizes - both)).tolist()


def _edges(found: Forest) -> pa.Table:
    e = found.edges()
    return pa.table({"a": pa.array([x[0] for x in e], pa.int64()), "b": pa.array([x[1] for x in e], pa.int64())})


def self_links(t: Fraction):
    def run(rows: pa.Table) -> pa.Table:
        ids, sets = rows["doc"].to_pylist(), [np.frombuffer(x, np.uint64) for x in rows["tokens"].to_pylist()]
        group, found = Group(ids, sets), Forest()
        for i, s in zip(ids, sets):
            for j in group.linked(s, t):
                found.join(i, ids[j])
        return _edges(found)

    return run


def cross_links(t: Fraction):
    def run(key, queries: pa.Table, members: pa.Table) -> pa.Table:
        found = Forest()
        if queries.num_rows and members.num_rows:
            ids = members["doc"].to_pylist()
            group = Group(ids, [np.frombuffer(x, np.uint64) for x in members["tokens"].to_pylist()])
            for i, x in zip(queries["doc"].to_pylist(), queries["tokens"].to_pylist()):
                for j in group.linked(np.frombuffer(x, np.uint64), t):
                    found.join(i, ids[j])
        return _edges(found)

    return run


def scan(docs: DataFrame, n: int, spread: Spread) -> DataFrame:
    """A row for each document (doc, n, f1, f2: its set's size and 128-bit fingerprint), and rows of packed tokens; stashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = Words(), Packer(spread)
        names = ["doc", "n", "f1", "f2", "range", "packed"]

        def packed(used, data):
            none = pa.nulls(len(used), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used, pa.int32()), pa.array(data, pa.binary())], names)

        for keys, texts in slices(batches):
            sets = [shingles(x, n, words) for x in texts]
            f1 = [int(mix(s).sum()) if len(s) else 0 for s in sets]
            f2 = [int(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum()) if len(s) else 0 for s in sets]  # of other hashes
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), as_long(f1), as_long(f2), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())], names
            )
            for s in sets:
                for used, data in packer.add(s):
                    yield packed(used, data)
        used, data = packer.flush()
        if used:
            yield packed(used, data)

    return stash_map(docs, run, "doc long, n long, f1 long, f2 long, range int, packed binary", "jaccard-scan")


def prefixes(docs: DataFrame, n: int, t: Fraction, spread: Spread, shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc, token): the tokens of each document's prefix that may be in another document too, stashed. shared: (value, n) of
    tokens seen more than once; sizes: (doc, n). Tokens are looked up in bit tables by frequency; where they are too many, tokens are joined to them."""
    spark = docs.sparkSession
    if shared.count() > frequency.MAX_KEYS:
        return stash_slim(_joined_prefixes(docs, n, t, spread, shared, sizes), "jaccard-prefixes")
    sent = Shared(spark, [bit_table(shared.where(F.col("n") >= x), "value", hashed=False) for x in LEVELS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables = Words(), sent.value
        for keys, texts in slices(batches):
            who, what = [], []
            for key, text in zip(keys, texts):
                s = shingles(text, n, words)
                if key is None or not len(s):
                    continue
                value = spread.narrowed(s)
                known = tables[0].has(value)
                room = len(s) - needed(len(s), t) + 1 - int((~known).sum())
                if room <= 0:
                    continue
                s, value = s[known], value[known]
                level = sum(x.has(value).astype(np.int8) for x in tables)
                s = s[np.lexsort((s, level))[:room]]
                who.append(np.full(len(s), key, np.int64))
                what.append(s)
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(what).view(np.int64))], ["doc", "token"])

    out = stash_map(docs, run, "doc long, token long", "jaccard-prefixes")
    sent.drop()
    return out


def _joined_prefixes(docs: DataFrame, n: int, t: Fraction, spread: Spread, shared: DataFrame, sizes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for keys, texts in slices(batches):
            sets = [shingles(x, n, words) if k is not None else np.zeros(0, np.uint64) for k, x in zip(keys, texts)]
            who = np.repeat([k or 0 for k in keys], [len(s) for s in sets]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["doc", "token"])

    tokens = docs.mapInArrow(run, "doc long, token long").join(shared.withColumnRenamed("n", "seen"), F.shiftrightunsigned("token", 64 - spread.bits) == F.col("value"))
    level = sum((F.when(F.col("seen") >= x, 1).otherwise(0) for x in LEVELS), F.lit(0))
    per = tokens.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(level.alias("level"), "token"))).alias("all")).join(sizes, "doc")
    # a set's unshared tokens take their places in the prefix first
    left = F.expr(f"size(all) - ({t.numerator} * n + {t.denominator - 1}) div {t.denominator} + 1")
    return per.where(left > 0).select("doc", F.explode(F.slice("all", F.lit(1), left.cast("int"))).alias("x")).select("doc", F.col("x.token").alias("token"))


def sets_of(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(doc, n, tokens) of the wanted documents, a row for each; stashed. A bit table leaves most of the others away, if it can."""
    sent = Shared(docs.sparkSession, None if wanted.count() > frequency.MAX_KEYS else bit_table(wanted, "doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table_ = Words(), sent.value
        for b in batches:
            keys = b.column(0)
            known = np.asarray(keys.is_valid())
            if table_ is not None:
                known &= table_.has(mix(np.asarray(keys.fill_null(0)).astype(np.int64)))
            own = b.filter(pa.array(known))
            for ids, texts in slices([own]):
                sets = [shingles(x, n, words) for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "n", "tokens"])

    found = docs.mapInArrow(run, "doc long, n long, tokens binary")
    out = stash_slim(found.join(wanted, "doc", "left_semi").dropDuplicates(["doc"]), "jaccard-sets")
    sent.drop()
    return out


def join(df: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark, t = df.sparkSession, Fraction(threshold)
    # up to the links a document is known by a key that stands for one text, which is its id where one row has that
    docs, new = keyed(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), nulls=False)
    docs = docs.select(F.col("key").alias("doc"), "text")
    ids = lambda rows, c: rows.join(new.select(F.col("key").alias(c), F.col("doc_id").alias(f"{c}_id")), c, "left").withColumn(f"{c}_id", F.coalesce(f"{c}_id", c))
    spread = Spread.of((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6, cores(spark))
    scanned = scan(docs, n, spread)
    rows = ids(scanned.where("range is null").select("doc", "n", "f1", "f2"), "doc")

    # classes of equal sets
    classes = stash_slim(rows.where("n > 0 and doc is not null").groupBy("f1", "f2", "n").agg(F.min_by("doc", "doc_id").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "jaccard-classes")
    member = stash_slim(rows.join(classes, ["f1", "f2", "n"], "left").select("doc", "doc_id", "n", *[F.when(F.col("doc").isNotNull(), F.coalesce(a, b)).alias(a) for a, b in (("rep", "doc"), ("least", "doc_id"))]), "jaccard-members")

    # tokens in more than one document, by frequency
    shared = stash(repeated(scanned.where("range is not null")), "jaccard-tokens")
    drop(scanned)
    found = prefixes(docs, n, t, spread, shared, member.where("doc is not null").select("doc", "n").distinct())
    drop(shared)
    own = found.join(member.where("doc = rep").select("doc").distinct(), "doc", "left_semi").distinct()
    own = stash_slim(own, "jaccard-own")
    drop(found, classes)
    often = stash_slim(own.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1"), "jaccard-often")
    at = stash_slim(own.join(often, "token"), "jaccard-open")
    drop(own, often)
    free_shuffles(spark)
    wanted = stash_slim(at.select("doc").distinct(), "jaccard-wanted")
    sets = sets_of(docs, n, wanted)
    drop(wanted)

    # 1. groups by a shared token, opened on themselves
    share = lambda size: F.greatest(F.lit(GROUPS[0]), F.least(F.lit(GROUPS[1]), 4 * F.sqrt(size)))
    lot = lambda size: F.pmod(F.xxhash64("doc"), F.ceil(size / share(size)))
    by_token = at.groupBy("doc").agg(F.min(F.struct("token", "holders")).alias("k0"), F.max(F.struct("token", "holders")).alias("k1"))
    by_token = stash_slim(by_token, "jaccard-keys")
    dealt = by_token.select("doc", F.posexplode(F.array("k0", "k1")).alias("turn", "k")).select("doc", "turn", F.col("k.token").alias("key"), lot(F.col("k.holders")).alias("lot"))
    first = stash(dealt.join(sets.select("doc", "tokens"), "doc").groupBy("turn", "key", "lot").applyInArrow(self_links(t), "a long, b long"), "jaccard-links")
    roots = components(first, "jaccard-roots", stash_slim)

    # 2. groups of components, and of single documents by token; the matrix; the candidates
    size = stash_slim(roots.groupBy("root").agg(F.count("*").alias("size")), "jaccard-sizes")
    labelled = sets.select("doc", "n").join(roots.join(size, "root"), F.col("doc") == F.col("node"), "left").join(by_token.select("doc", "k0"), "doc")
    info = labelled.select(
        "doc", "n", F.coalesce("root", "doc").alias("label"),
        F.when(F.col("root").isNotNull(), F.struct(F.lit(1).alias("whole"), F.col("root").alias("key"), lot(F.col("size")).alias("lot"))).otherwise(F.struct(F.lit(0).alias("whole"), F.col("k0.token").alias("key"), lot(F.col("k0.holders")).alias("lot"))).alias("grp"),
    )
    info = stash_slim(info, "jaccard-groups")
    held = at.select("token", "doc", "holders").join(info, "doc")
    # the pairs inside the largest component at a token need no look
    major = held.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("major"), F.count("*").alias("labels")).where("labels > 1").select("token", "major")
    major = stash_slim(major, "jaccard-major")
    held = stash_slim(held.join(major, "token"), "jaccard-held")
    cell = F.struct("grp", "least", "most", "of_major")
    cells = held.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("label") == F.col("major")).alias("of_major"), F.first("holders").alias("holders"))
    # a row of the matrix lists a token's groups, of which there are about the root of its holders where these are alike; a token of
    # many has several rows. A query document takes the rows of its tokens and makes the groups in them distinct before
    # any becomes a row of its own
    matrix = cells.groupBy("token", F.pmod(F.xxhash64("grp"), F.ceil(F.col("holders") / ROW)).alias("nth")).agg(F.collect_list(cell).alias("row"))
    matrix = stash_slim(matrix.drop("nth"), "jaccard-matrix")
    query = held.where("label != major").select("token", "doc", "n", "label", F.col("grp").alias("own"))
    # overlap >= t * max(sizes), so sizes of partners are within t of each other
    num, den = t.numerator, t.denominator
    meets = f"n * {den} >= c.least * {num} and c.most * {den} >= n * {num} and (c.of_major or own <= c.grp) and not (c.grp.whole = 1 and c.grp.key = label)"
    met = query.join(matrix, "token").select("doc", F.expr(f"transform(filter(row, c -> {meets}), c -> c.grp)").alias("met")).where(F.size("met") > 0)
    cand = stash_slim(met.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met")).select("doc", F.explode("met").alias("grp")), "jaccard-candidates")
    drop(major, held, matrix, at, by_token, size)
    free_shuffles(spark)

    # 3. open the groups
    lots = stash_slim(cand.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("lots")), "jaccard-lots")
    asked = cand.join(lots, "grp").select("doc", "grp", F.pmod(F.xxhash64("doc"), F.col("lots")).alias("part")).join(sets.select("doc", "tokens"), "doc")
    members = info.select("doc", "grp").join(lots, "grp").join(sets.select("doc", "tokens"), "doc").select(*[F.col(c).alias(c) for c in ("doc", "tokens", "grp")], F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("part"))
    second = asked.groupBy("grp", "part").cogroup(members.groupBy("grp", "part")).applyInArrow(cross_links(t), "a long, b long")
    # ids again, and the links of an id's texts through it
    linked = ids(ids(first.union(second), "a"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    through = member.where("doc_id != least").join(new.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    links = stash(linked.union(through).where("a != b"), "jaccard-all-links")
    drop(first, roots, cand, lots, info, sets)
    free_shuffles(spark)
    final = components(links, "jaccard-components", stash_slim)
    drop(links)
    out = member.join(final, F.col("least") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "least").alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents", "doc_id", "text"), 3, Fraction(9, 10))


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""

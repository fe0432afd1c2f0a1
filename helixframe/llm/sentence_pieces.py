"""SentencePiece encoding and decoding with a distinct-chunk table (operator 6).

Method. The model turns spaces into the marker U+2581 and no piece of it has a marker after another character, so no
merge can cross the place where a marked word begins. Each task therefore cuts texts into marked words, keeps a table
of the distinct ones, has the sentencepiece library segment each distinct word once, and joins the ids back by
position (the words of a document, in order, index the table). The model is checked for that property first; a model
without it is applied to whole texts instead. The table is cleared when it reaches ``table_limit`` entries, so memory
stays bounded; a word that comes again is simply segmented again.

A global table would shuffle every word of the corpus twice; the per-task one shuffles nothing, and a retried task
needs only its own input split.

Defined results: a null text counts as empty and gives the begin and end ids alone; a null id is passed through; ties
and repeated rows give a row each; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def words_stand_alone(pieces: list[str]) -> bool:
    """True if no piece has a marker after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


class ChunkTable:
    """Distinct marked words and their ids, as little-endian 16- or 32-bit strings."""

    def __init__(self, model: str, table_limit: int) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.get_piece_size()
        self.code = "H" if n <= 1 << 16 else "I"
        self.alone = words_stand_alone([self.sp.id_to_piece(i) for i in range(n)])
        self.known: dict[str, bytes] = {}
        self.limit = table_limit
        self.odd = re.compile(f"  |^ | $|{MARK}")
        self.marked = re.compile(f"{MARK}+[^{MARK}]*")

    def cut(self, text: str) -> list[str]:
        """The keys of a text's marked words. One marker before a word is implied, other runs are spelled out."""
        if not text:
            return []
        if not self.odd.search(text):
            return text.split(" ")
        return [c[1:] if c[1:] and c[1] != MARK else c for c in self.marked.findall(MARK + text.replace(" ", MARK))]

    def learn(self, keys: set[str]) -> None:
        from array import array

        if len(self.known) > self.limit:
            self.known.clear()
        new = [k for k in keys if k not in self.known]
        plain = [k for k in new if k != MARK]
        # the library puts one marker before each text itself
        ids = self.sp.encode([k[1:].replace(MARK, " ") if k[0] == MARK else k for k in plain], num_threads=1)
        for k, x in zip(plain, ids):
            self.known[k] = array(self.code, x).tobytes()
        if len(plain) < len(new):
            self.known[MARK] = array(self.code, [self.sp.piece_to_id(MARK)]).tobytes()

    def encode(self, texts: list[str]):
        """uint32 arrays of ids, with begin and end."""
        import numpy as np

        dt, ends = ("<u2" if self.code == "H" else "<u4"), (self.sp.bos_id(), self.sp.eos_id())
        if not self.alone:
            for x in self.sp.encode(texts, num_threads=1):
                yield np.array([ends[0], *x, ends[1]], "<u4")
            return
        cuts = [self.cut(t) for t in texts]
        self.learn(set().union(*cuts))
        get = self.known.__getitem__
        for keys in cuts:
            body = np.frombuffer(b"".join(map(get, keys)), dt)
            out = np.empty(len(body) + 2, "<u4")
            out[0], out[-1] = ends
            out[1:-1] = body
            yield out


def groups_of(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def transcode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", table_limit: int = 250_000) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids are little-endian unsigned 32-bit integers with begin and end, decoded is
    what the library's decode(ids) returns. The model is a file that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = None
        for batch in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            chunks = chunks or ChunkTable(model, table_limit)
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            at = 0
            for part in groups_of(texts):
                ids = list(chunks.encode(part))
                decoded = chunks.sp.decode([x.tolist() for x in ids], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(part)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )
                at += len(part)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(transcode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")))

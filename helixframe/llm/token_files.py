"""Token ids in Huffman-coded binary files (operator 2).

Method. Texts are tokenised once, in parallel, and their ids written to the shared folder. Each task counts its ids;
the global counts (a row for each id of the vocabulary, which bounds what the driver gets) give a canonical Huffman code
whose lengths package-merge limits to 16 bits. Documents are then dealt out by ranges of doc_id, and each task writes
files of independent blocks, closed at ``FILE_BYTES``. A block holds its documents' ids and lengths and its bit stream with a checkpoint every 128 ids;
the decoder steps through all lanes of a block at once with one 65,536-entry table.

Tokenising cuts a text before each single space that a visible character follows; the byte-level pattern always cuts
there, so the tokenizers library encodes each distinct chunk once a worker, as long as its table has room, and the chunks'
ids are joined by position.

File: magic, then the length of the code table and the zlib-packed code lengths, then blocks. All numbers are
little-endian. Block: magic, number of documents, ids, checkpoints and bit bytes, then doc ids (int64, with a
byte each that marks a null), ids per document (uint32), checkpoints (uint64), bits. A block holds whole documents.

Defined results: a null text counts as empty and is the end id alone; null doc ids sort first; repeated ids keep a row
each, ordered by a hash of their token ids, so that an id of very many rows is dealt over many files; an empty table writes no file and gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FileSink, cores, new_folder, read_files, stash, table
from .huffman import STEP, Coder, code_lengths

MAGIC, BLOCK_MAGIC = b"HXT1", b"HXB1"
BLOCK_IDS = 1 << 20
#: A file is closed once it has so many bytes; readers take files whole.
FILE_BYTES = 64 << 20
#: What a worker's table of chunks may take: its entries are counted with so many bytes each beside their text and ids.
TABLE_BYTES, ENTRY_BYTES = 96 << 20, 120
#: Texts of so many bytes are tokenised together.
BATCH_BYTES = 16 << 20


class ChunkEncoder:
    """The tokenizers library behind a table of distinct chunks, which is cleared when it takes ``table_bytes``."""

    def __init__(self, path: str, table_bytes: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.code, self.dtype = ("H", "<u2") if self.size <= 1 << 16 else ("I", "<u4")
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.size, bool)
        for token, i in self.tok.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")  # how a byte-level vocabulary writes a space
        # whole texts go to the library where chunks could differ: other pre-tokenizers, special strings in a text
        import json

        kind = (json.loads(self.tok.to_str()).get("pre_tokenizer") or {})
        self.chunked = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        self.cut = re.compile(r"(?= [^\s])")
        # the library's pattern takes these as white space
        space = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
        self.odd = f" {space}|^{space}| $|{space} |\\x00"
        if added:
            self.odd += "|" + "|".join(re.sub(r"([^\w<>])", r"\\\1", x) for x in added)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.limit = table_bytes
        self.clear()

    @classmethod
    def of_worker(cls, path: str, table_bytes: int) -> ChunkEncoder:
        """The encoder of this Python worker, one at a time, which serves its later tasks too. What it knows depends on the
        tokenizer alone. Classes travel anew with each task, so it stands in a module that this library makes in the worker."""
        import sys
        import types

        own = sys.modules.setdefault("helixframe_worker", types.ModuleType("helixframe_worker"))
        if getattr(own, "encoder_of", None) != (path, table_bytes):
            own.encoder, own.encoder_of = cls(path, table_bytes), (path, table_bytes)
        return own.encoder

    def clear(self) -> None:
        """An empty table: numbers of the chunks, and their ids end to end."""
        self.known: dict[str, int] = {}
        self.taken = 0
        self.flat, self.start, self.count, self.used = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def put(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, k = len(self.known), len(keys)
        while n + k > len(self.start):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + k] = self.used + np.cumsum(counts) - counts
        self.count[n : n + k] = counts
        self.known.update(zip(keys, range(n, n + k)))
        self.used += len(ids)
        self.taken += sum(map(len, keys)) + ENTRY_BYTES * k + ids.nbytes

    def learn(self, keys: list[str]) -> None:
        """Keys that begin with NUL stand for the text after it, others for a space and themselves."""
        spaced, alone = [k for k in keys if k[:1] != "\0"], [k for k in keys if k[:1] == "\0"]
        for i in range(0, len(spaced), 512):
            part = spaced[i : i + 512]
            ids = np.array(self.fast([" " + " ".join(part)])[0].ids, self.dtype)
            cut = np.flatnonzero(self.opens[ids])  # a chunk's first id, and no other, begins with a space
            if len(cut) == len(part):
                self.put(part, ids, np.diff(np.append(cut, len(ids))))
            else:
                alone += part
        for i in range(0, len(alone), 512):
            part = alone[i : i + 512]
            got = [e.ids for e in self.fast([k[1:] if k[:1] == "\0" else " " + k for k in part])]
            self.put(part, np.array([x for e in got for x in e], self.dtype), np.array([len(e) for e in got], np.int64))

    def fast(self, texts: list[str]):
        return self.tok.encode_batch_fast(texts, add_special_tokens=False)

    def numbers(self, keys: list[str], distinct: bool = True) -> np.ndarray:
        known = self.known
        new = [k for k in keys if k not in known]
        self.learn(new if distinct else list(dict.fromkeys(new)))
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def gathered(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered chunks end to end, number of ids of each text); ends: where each text's chunks end."""
        n = self.count[at]
        total = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[at] - (total - n), n) + np.arange(total[-1] if len(n) else 0)]
        upto = np.concatenate([[0], total])
        return ids, np.diff(upto[ends], prepend=0)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, 16 or 32 bits each, in bytes. Texts aren't null."""
        import pyarrow.compute as pc

        if self.taken > self.limit:
            self.clear()
        odd = np.asarray(pc.match_substring_regex(texts, self.odd)) if self.chunked else np.ones(len(texts), bool)
        out: list[bytes] = [b""] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            cuts = pc.split_pattern(texts.take(pa.array(plain)), " ")
            ends = np.asarray(cuts.offsets)[1:].astype(np.int64)
            coded = cuts.values.dictionary_encode()
            number = self.numbers(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
            first = np.concatenate([[0], ends[:-1]])
            number[first] = self.numbers(["\0" + x for x in cuts.values.take(pa.array(first)).to_pylist()], distinct=False)
            self.fill(out, plain, number, ends)
        rest = np.flatnonzero(odd)
        if len(rest):
            raw = texts.take(pa.array(rest)).to_pylist()
            whole = [i for i, t in enumerate(raw) if not self.chunked or self.special and self.special.search(t)]
            for i, e in zip(whole, self.fast([raw[i] for i in whole]) if whole else []):
                out[rest[i]] = np.array(e.ids, self.dtype).tobytes()
            own = [i for i in range(len(raw)) if i not in set(whole)] if whole else list(range(len(raw)))
            chunks = [["\0" + c for c in self.cut.split(raw[i]) if c] for i in own]
            keys = list(dict.fromkeys(k for c in chunks for k in c))
            if keys:
                index = dict(zip(keys, self.numbers(keys).tolist()))
                self.fill(out, rest[own], np.array([index[k] for c in chunks for k in c], np.int64), np.cumsum([len(c) for c in chunks]))
        return out

    def fill(self, out: list[bytes], which: np.ndarray, number: np.ndarray, ends: np.ndarray) -> None:
        ids, counts = self.gathered(number, ends)
        raw, at = ids.tobytes(), np.concatenate([[0], np.cumsum(counts) * ids.itemsize]).tolist()
        for k, x, y in zip(which.tolist(), at, at[1:]):
            out[k] = raw[x:y]


def tokenise(df: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Rows (doc_id, ids), ids as little-endian 16-bit integers, or 32-bit ones for a vocabulary of more than 65,536; and rows
    (id, n), how often each id occurs in a task's documents, which the other two columns are null in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        coder, waiting, size, total = None, [], 0, np.zeros(0, np.int64)
        names = ["doc_id", "ids", "id", "n"]

        def done() -> tuple[np.ndarray, pa.RecordBatch]:
            b = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            last = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
            ids = pa.array([x + last for x in coder.encode(b.column(1).fill_null(""))], pa.binary())
            size = pc.sum(pc.binary_length(ids)).as_py() or 0
            # an array's bytes stand one after another
            n = np.bincount(np.frombuffer(ids.buffers()[2], coder.dtype, size // np.dtype(coder.dtype).itemsize) if size else [], minlength=len(total)).astype(np.int64)
            n[: len(total)] += total
            return n, pa.RecordBatch.from_arrays([b.column(0), ids, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())], names)

        for batch in batches:
            coder = coder or ChunkEncoder.of_worker(tokenizer, table_bytes)
            length, at = np.asarray(pc.binary_length(batch.column(1).fill_null(""))).cumsum(), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + BATCH_BYTES - size, "right")))
                waiting.append(batch.slice(at, to - at))
                size += int(length[to - 1] - (length[at - 1] if at else 0))
                at = to
                if size >= BATCH_BYTES - (1 << 16):
                    total, out = done()
                    waiting, size = [], 0
                    yield out
        if waiting:
            total, out = done()
            yield out
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.array(used), pa.array(total[used])], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, id long, n long")


def id_counts(tokens: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs, from the tasks' own counts; the driver gets a row for each id that occurs."""
    out = np.zeros(vocab, np.int64)
    for r in tokens.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def pack_block(coder: Coder, keys: list[int | None], ids: np.ndarray, counts: list[int]) -> bytes:
    bits, marks = coder.encode(ids)
    head = BLOCK_MAGIC + struct.pack("<IQQQ", len(keys), len(ids), len(marks), len(bits))
    doc = np.array([0 if k is None else k for k in keys], "<i8").tobytes() + bytes(k is None for k in keys)
    return head + doc + np.array(counts, "<u4").tobytes() + marks.astype("<u8").tobytes() + bits


def unpack(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, list[int]]]:
    """(doc ids, ids, ids per document) of each block of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", data, 4)
    coder, at = Coder(np.frombuffer(zlib.decompress(data[8 : 8 + n]), np.uint8)), 8 + n
    while at < len(data):
        if data[at : at + 4] != BLOCK_MAGIC:
            raise ValueError("a block is damaged")
        docs, ids, marks, bits = struct.unpack_from("<IQQQ", data, at + 4)
        at += 32
        keys = np.frombuffer(data, "<i8", docs, at).tolist()
        nulls = data[at + 8 * docs : at + 9 * docs]
        counts = np.frombuffer(data, "<u4", docs, at + 9 * docs).tolist()
        at += 13 * docs
        found = coder.decode(data[at + 8 * marks : at + 8 * marks + bits], np.frombuffer(data, "<u8", marks, at), ids)
        yield [None if x else k for k, x in zip(keys, nulls)], found, counts
        at += 8 * marks + bits


def write_files(tokens: DataFrame, lengths: np.ndarray, dtype: str, folder: str, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Writes tokens in ascending doc_id order, a range of ids a task. The manifest: file, ids, in that order."""
    spark = tokens.sparkSession
    table_ = zlib.compress(lengths.astype(np.uint8).tobytes(), 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, coder, keys, parts, size, total, done = None, Coder(lengths), [], [], 0, 0, []

        def flush():
            ids = np.frombuffer(b"".join(parts), dtype)
            sink.write(pack_block(coder, keys, ids, [len(p) // ids.itemsize for p in parts]))

        def close():
            sink.close()
            done.append((TaskContext.get().partitionId(), len(done), sink.uri, total))

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if sink is None:
                    sink = FileSink(folder, ".hxt")
                    sink.write(MAGIC + struct.pack("<I", len(table_)) + table_)
                keys.append(key)
                parts.append(ids)
                n = len(ids) // np.dtype(dtype).itemsize
                size, total = size + n, total + n
                if size >= BLOCK_IDS:
                    flush()
                    keys, parts, size = [], [], 0
                    if sink.size >= file_bytes:
                        close()
                        sink, total = None, 0
        if sink is not None:
            if keys:
                flush()
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["part", "nth", "uri", "n"])

    by = (F.col("doc_id"), F.xxhash64("ids"))
    ordered = tokens.repartitionByRange(cores(spark), *by).sortWithinPartitions(*by, "ids")
    # a row for each file; sorting it in Spark would run the job twice
    return sorted((r.asDict() for r in ordered.mapInArrow(run, "part long, nth long, uri string, n long").collect()), key=lambda r: (r["part"], r["nth"]))


def read_documents(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, ids), ids as little-endian 32-bit integers, decoded block by block from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = 0
                for keys, ids, counts in unpack(data):
                    ends = np.cumsum(counts)
                    raw, at = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.rsplit("/", 1)[1]] * len(keys)), pa.array(keys, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array([raw[x:y] for x, y in zip(at, at[1:])], pa.binary())],
                        ["file", "doc_id", "start", "ids"],
                    )
                    start += len(ids)

    docs = read_files(spark, folder, [m["uri"] for m in manifest]).mapInArrow(run, "file string, doc_id long, start long, ids binary")
    before, rows = 0, []
    for m in manifest:
        rows.append((m["uri"].rsplit("/", 1)[1], before))
        before += m["n"]
    # a row for each file
    offsets = F.broadcast(spark.createDataFrame(rows, "file string, before long"))
    return docs.join(offsets, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")


def export(df: DataFrame, tokenizer: str, end_id: int | None = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[dict]]:
    """Tokenises, codes and writes; gives the folder and the manifest of its files in order."""
    spark = df.sparkSession
    probe = ChunkEncoder(tokenizer, 0)
    vocab = max(probe.size, (end_id or 0) + 1)
    tokens = stash(tokenise(df, tokenizer, end_id, id_col, text_col), "tokens")
    folder = folder or new_folder(spark, "token-files")
    return folder, write_files(tokens.where("id is null").select("doc_id", "ids"), code_lengths(id_counts(tokens, vocab)), probe.dtype, folder)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, manifest = export(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    docs = read_documents(spark, folder, manifest)
    return docs.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


__all__ = ["STEP", "export", "read_documents", "tokenise", "op2_token_files"]

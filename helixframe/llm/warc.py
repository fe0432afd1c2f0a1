"""WARC archives and a salvage reader (operator 3).

Writing. Each row becomes a WARC/1.1 record in a gzip member of its own. Of records with equal payloads of at least
``revisit_from`` bytes, the one with the smallest page_id is the response and the others are revisits that refer to it.
Which payloads repeat is found by an aggregation on their SHA-256 that adds up before it shuffles; only digests that
occur more than once are joined back, by a join of two plain exchanges, which Spark splits where a payload is hot.

Reading. The salvage reader goes through an archive record by record and checks the gzip checksum, the version line, the
lengths and the block digest. After a failed check it searches for the next valid member (or, outside gzip, the next
version line at a line's start), goes on from there, and logs the bytes between as a quarantined gap.

Defined results: a null payload counts as empty; a null url is written as ``urn:none``; a null page_id is written as
such and takes part in no revisit; rows that tie on page_id and payload are all responses if they are the smallest;
an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FileSink, new_folder, read_files, stash, table

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, at long, size long, type string, record_id string, refers_to string, target string, payload_digest string, payload_bytes long, payload binary, gap string"
#: An archive is closed once it has so many bytes; readers take archives whole.
ARCHIVE_BYTES = 32 << 20
#: So many bytes of a member go to the decompressor at once.
WINDOW = 1 << 15


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def from_urn(x: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        **({} if refers_to is None else {"WARC-Profile": PROFILE, "WARC-Refers-To": urn(refers_to)}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Found:
    """A record, or a gap if ``gap`` says why its bytes were quarantined."""

    at: int
    size: int
    head: dict = field(default_factory=dict)
    block: bytes = b""
    gap: str | None = None


def parse(raw: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at a version line; ValueError if a check fails.

    Headers may be of any length. They end before the next line that begins with a version, so that a search in damaged
    data stops there."""
    if not raw.startswith(VERSION, at):
        raise ValueError("no version line")
    line = raw.find(b"\n" + VERSION, at)
    end = raw.find(b"\r\n\r\n", at, line if line >= 0 else len(raw))
    if end < 0:
        raise ValueError("headers don't end")
    head = {}
    for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("a header has no colon")
        head[k.strip().lower()] = v.strip()
    if not (n := head.get("content-length", "")).isdigit():
        raise ValueError("no content length")
    block = raw[end + 4 : end + 4 + int(n)]
    if len(block) < int(n):
        raise ValueError("the block is cut short")
    stop = end + 4 + int(n)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("no end mark after the block")
    kind, _, digest = head.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError("block digest differs")
    return head, block, stop + 4


def member(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """As parse(), for a gzip member."""
    z, parts, end = zlib.decompressobj(31), [], at
    try:
        # in windows, as the decompressor copies what it is given beyond the member's end
        while not z.eof and end < len(data):
            parts.append(z.decompress(data[end : end + WINDOW]))
            end = min(end + WINDOW, len(data))
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not z.eof:
        raise ValueError("the member is cut short")
    raw = b"".join(parts)
    head, block, stop = parse(raw)
    if stop != len(raw):
        raise ValueError("more than a record in a member")
    return head, block, end - len(z.unused_data)


class Starts:
    """Where records may begin in an archive. Each search goes on from where the last one ended, so that many gaps don't
    search the same bytes again."""

    def __init__(self, data: bytes) -> None:
        self.data, self.line, self.gz = data, -1, -1

    def next_line(self, at: int) -> int:
        """The place of the next version line at a line's start, or the archive's end."""
        if self.line < at:
            line = at
            while (line := self.data.find(VERSION, line)) > 0 and self.data[line - 1 : line] != b"\n":
                line += 1
            self.line = line if line >= 0 else len(self.data)
        return self.line

    def next_gzip(self, at: int) -> int:
        if self.gz < at:
            gz = self.data.find(GZIP, at)
            self.gz = gz if gz >= 0 else len(self.data)
        return self.gz

    def after(self, at: int) -> int:
        """The place of the next member whose text begins with a version line, or of the next version line."""
        line = self.next_line(at)
        while (gz := self.next_gzip(at)) < line:
            try:
                if zlib.decompressobj(31).decompress(self.data[gz : gz + 4096], 16).startswith(VERSION[:5]):
                    return gz
            except zlib.error:
                pass
            at = gz + 1
        return line


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive that pass the checks, and the gaps between them."""
    at, starts = 0, Starts(data)
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                head, block, end = member(data, at)
            else:
                head, block, end = parse(data, at)
            yield Found(at, end - at, head, block)
            at = end
            continue
        except ValueError as e:
            why = str(e)
        end = starts.after(at + 1)
        # a candidate that fails its own checks makes another gap, from its start
        yield Found(at, end - at, gap=why)
        at = end


def payload_of(block: bytes) -> tuple[dict, bytes]:
    """(HTTP headers, body) of an HTTP response."""
    top, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:])}, body


def with_revisits(pages: DataFrame, revisit_from: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to)"""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= revisit_from
    repeated = rows.where(long_enough & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(stash(repeated, "repeated-payloads"), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(long_enough & (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Writes a record for each row (page_id, url, html); the manifest lists the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, done = None, []
        for b in batches:
            for row in zip(*(b.column(i) for i in range(5))):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if sink is None:
                    sink = FileSink(folder, ".warc.gz")
                sink.write(record(page_id, url, payload, digest, refers_to))
                if sink.size >= archive_bytes:
                    sink.close()
                    done.append(sink.uri)
                    sink = None
        if sink is not None:
            sink.close()
            done.append(sink.uri)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["uri"])

    return sorted(r["uri"] for r in with_revisits(pages, revisit_from).mapInArrow(run, "uri string").collect())


def read_archives(spark: SparkSession, folder: str, uris: list[str]) -> DataFrame:
    """A row for each record, and for each gap one whose ``gap`` says what failed."""
    names = ["path", "at", "size", "type", "record_id", "refers_to", "target", "payload_digest", "payload_bytes", "payload", "gap"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                path, data, rows, size = path.as_py(), data.as_py(), [], 0
                for x in salvage(data):
                    http, body = payload_of(x.block)
                    n = http.get("content-length", "")
                    rows.append((path, x.at, x.size, x.head.get("warc-type"), x.head.get("warc-record-id"), x.head.get("warc-refers-to"), x.head.get("warc-target-uri"), x.head.get("warc-payload-digest"), int(n) if n.isdigit() else None, body, x.gap))
                    size += len(body)
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return read_files(spark, folder, uris).mapInArrow(run, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    found = read_archives(spark, folder, write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = F.when(F.col("type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", ""))
    return found.where("gap is null").select(
        page("record_id").try_cast("long").alias("page_id"), whole.alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").try_cast("long").alias("refers_to")
    )

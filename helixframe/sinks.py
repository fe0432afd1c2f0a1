"""Writers. A stage's table becomes one file where users expect one: Spark sorts and writes it to the shared folder in parts, by
many tasks, and the driver joins the parts in their order into one file through Hadoop's file systems, a buffer at a time.
Paths without a scheme are local; on a cluster, give URIs that all machines reach."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.exact import fixed
from .scratch import delete, file_system, new_folder


def uri(path: str | Path) -> str:
    """A local path as a URI; URIs stay."""
    return str(path) if "://" in str(path) else f"file://{Path(path).resolve()}"


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def fasta_text(header: Column, sequence: Column, width: int = 80) -> Column:
    """A record: its header, and the sequence in lines of a width; an empty sequence has none."""
    body = F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return F.when(F.length(sequence) > 0, F.concat(F.lit(">"), header, F.lit("\n"), body)).otherwise(F.concat(F.lit(">"), header))


def _one_file(lines: DataFrame, path: str | Path, *order: Column | str, head: str = "") -> str | Path:
    """lines.value, sorted, as one text file after a head. Ranges of the order are sorted and written by a task each; rows don't
    pass through the driver's memory."""
    spark = lines.sparkSession
    parts = new_folder(spark, "sink")
    sorted_ = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    sorted_.select("value").write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    source, target = at(parts).getFileSystem(conf), at(uri(path)).getFileSystem(conf)
    target.mkdirs(at(uri(path)).getParent())
    found = [x.getPath() for x in source.globStatus(at(f"{parts}/part-*"))]
    target.setWriteChecksum(False)  # a local file has one of checksums beside it otherwise
    out = target.create(at(uri(path)), True)
    target.setWriteChecksum(True)
    try:
        out.write(bytearray(head.encode()))
        for part in sorted(found, key=lambda p: int(p.getName().split("-")[1])):
            into = source.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 16, False)
            into.close()
    finally:
        out.close()
    delete(spark, parts)
    return path


def write_fasta(records: DataFrame, path: str | Path, header: Column, order: str = "idx", width: int = 80) -> str | Path:
    return _one_file(records.select(F.col(order), fasta_text(header, F.coalesce("sequence", F.lit("")), width).alias("value")), path, order)


def write_jsonl(rows: DataFrame, path: str | Path, *order: str) -> str | Path:
    """A JSON object for each row; nulls are written."""
    own = [c for c in rows.columns if not c.startswith("__")]
    return _one_file(rows.select(*order, F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("value")), path, *order)


def write_lines(rows: DataFrame, path: str | Path, value: str, *order: str) -> str | Path:
    return _one_file(rows.select(*order, F.col(value).alias("value")), path, *order)


def _cell(c: Column) -> Column:
    """A CSV cell, quoted where it has to be."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_csv(rows: DataFrame, path: str | Path, columns: Sequence[str], digits: dict[str, int] | None = None, order: Sequence[Column | str] = ()) -> str | Path:
    """A header and the rows, lines ending in CRLF; digits: columns written with so many digits after the point."""
    digits = digits or {}
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [f"__o{i}" for i in range(len(by))]
    ready = rows.select(*[fixed(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in columns], *[o.alias(k) for o, k in zip(by, keys)])
    body = ready.select(*keys, F.concat(F.concat_ws(",", *[_cell(F.col(c)) for c in columns]), F.lit("\r")).alias("value"))
    return _one_file(body, path, *keys, head=",".join(columns) + "\r\n")


def write_text(path: str | Path, text: str) -> str | Path:
    """A small file that the driver made itself."""
    if "://" in str(path):
        store, name = file_system(str(path))
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(name) as out:
            out.write(text.encode())
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_bytes(text.encode())
    return path


def write_small_csv(path: str | Path, columns: Sequence[str], rows: Iterable[Sequence]) -> str | Path:
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(columns)
    writer.writerows(rows)
    return write_text(path, out.getvalue())


def write_manifest(path: str | Path, values: dict) -> str | Path:
    return write_text(path, json.dumps(values, indent=2, ensure_ascii=False))


def write_parquet(rows: DataFrame, path: str | Path) -> str | Path:
    rows.write.mode("overwrite").parquet(uri(path))
    return path

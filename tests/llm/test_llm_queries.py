"""The registered queries against DuckDB, and from a driver elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from helixframe.llm import queries

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def key(r):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in queries.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert sorted(got, key=key) == sorted(rel.select(", ".join(cols)).fetchall(), key=key)


def test_contract_columns(spark):
    want = {
        "op2_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
        "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op6_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    for name, kinds in want.items():
        assert dict(queries.queries()[name](spark, DATA).dtypes) == kinds


def test_workers_need_no_copy_of_the_library(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in ("op5_language_id", "op7_jaccard"):
    assert e.queries()[name](s, {DATA!r}).count() == 200
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]

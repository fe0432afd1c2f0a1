"""Every query of the library against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from helixframe.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: These take SQL a long time or are run by other tests.
SLOW = {"similarity_capped"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c



def key(r):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()]
    if name not in registry.oracle_sql() or name in SLOW:
        assert got
        return
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = [tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in rel.select(", ".join(cols)).fetchall()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_has_the_library_without_the_optional_part(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "LLM", False)
    assert set(e.queries()) == set(registry.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200

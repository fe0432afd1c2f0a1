import numpy as np
import pytest


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)

    return make


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.fixture
def words(rng):
    """Texts of invented words."""
    pool = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]

    def make(n):
        return [str(x) for x in rng.choice(pool, n)]

    return make

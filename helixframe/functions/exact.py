"""Rounding and fixed-point text from the exact binary value, which Spark's own functions, working on the shortest
decimal, don't give. For sinks and small results only: these run in Python, on Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Text with so many digits after the point; null stays null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}").astype(object)

    return run(value.cast("double"))


def rounded(value: Column, digits: int) -> Column:
    """Half to even on the exact value; null stays null."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(float(v), digits)).astype(float)

    return run(value.cast("double"))


def mask_secret(secret: str | None) -> str | None:
    return f"{secret[:4]}…" if secret else secret

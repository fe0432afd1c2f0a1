"""Feature tables joined with metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of key columns, in order of preference.
KEYS = [("record_id", "record_id"), ("record_id", "accession"), ("accession", "accession")]


def join_keys(features: DataFrame, metadata: DataFrame) -> tuple[str, str] | None:
    return next(((a, b) for a, b in KEYS if a in features.columns and b in metadata.columns), None)


def with_metadata(features: DataFrame, metadata: DataFrame) -> tuple[DataFrame, tuple[str, str] | None]:
    """(features with the metadata of the same key, the key columns). Null keys match null keys; a feature row with several
    metadata rows is repeated; metadata columns whose names are taken get _meta; without a common key features stay as they are."""
    keys = join_keys(features, metadata)
    if keys is None:
        return features, None
    left, right = keys
    taken = set(features.columns)
    names = {c: f"{c}_meta" if c in taken and not (c == right == left) else c for c in metadata.columns}
    other = metadata.select(*[F.col(f"`{c}`").alias(names[c]) for c in metadata.columns if not (c == right == left)], F.col(f"`{right}`").cast(dict(features.dtypes)[left]).alias("__key"))
    return features.join(other, F.col(f"`{left}`").eqNullSafe(F.col("__key")), "left").drop("__key"), keys

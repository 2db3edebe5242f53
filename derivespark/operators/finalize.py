"""Delivery: columns, types, order and labels by a specification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spec type and Spark type.
TYPES = {"text": "string", "integer": "bigint", "float": "double", "date": "date", "datetime": "timestamp", "boolean": "boolean"}


def set_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    for c, label in labels.items():
        df = df.withMetadata(c, {"label": label})
    return df


def labels_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["label"] for f in df.schema if "label" in f.metadata}


def conform(df: DataFrame, spec: Sequence[Mapping]) -> DataFrame:
    """The spec's variables (``variable, type, label``) in its order, cast; a missing one is an error, others are dropped. A
    value that does not fit its type becomes NULL."""
    missing = [s["variable"] for s in spec if s["variable"] not in df.columns]
    if missing:
        raise ValueError(f"missing variables: {', '.join(missing)}")
    out = df.select(*[F.col(s["variable"]).try_cast(TYPES[s.get("type", "text")]).alias(s["variable"]) for s in spec])
    return set_labels(out, {s["variable"]: s["label"] for s in spec if s.get("label")})


def write_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet in key order: ranges of keys, sorted within."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)

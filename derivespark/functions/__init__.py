"""Column helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def predicate(condition: Column | str) -> Column:
    """A condition as a Column; NULL counts as not met."""
    return F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))


def formula(value: Column | str) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def ordering(order: Sequence[str]) -> Column:
    """One sortable value for the list: ascending, NULLS LAST in every member."""
    return F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])


def ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def descending(order: Sequence[str]) -> list[Column]:
    """The exact reverse of ``ascending``."""
    return [F.col(c).desc_nulls_first() for c in order]


def need(df: DataFrame, *names: str) -> None:
    """Names are compared exactly: Spark alone would take ``t`` for ``T``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fail_if(bad: Column, message: str, value: Column) -> Column:
    """``value``, or an error when the row is computed; no action is needed to find it."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``, the folder that driver and executors share; where it is unset, as in tests,
    in a temporary one, but never on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='spark-')}/{label}-{uuid.uuid4().hex}"

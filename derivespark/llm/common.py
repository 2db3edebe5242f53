"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import string
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side with at most this many rows of a few numbers stays under some tens of MB.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset (tests), a new one. On a
    cluster it must be set: executors do not see the driver's local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While a Python step over whole texts is written: batches of few rows, so that a worker's memory follows the text of
    a few documents and not of Spark's usual 10,000. The session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_id(docs: DataFrame) -> Column:
    """``doc_id`` as a long; ids of another kind have no such number and are refused."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"doc_id is {kind}: this operator takes whole numbers; number the documents first")
    return F.col("doc_id").cast("long").alias("doc_id")


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of steps that are written go now: Spark drops them when the driver collects garbage, which
    by itself may be half an hour later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a saved, narrow table) marked for broadcast if its counted rows are within ``limit``; else as it is, for
    a shuffle join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if df.count() <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, and faster, unless a character beyond ASCII has a lower case."""
    others = text.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{Nd}\p{P}\p{Z}]")
    return F.when(others, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"_{i}_" for i in range(n + len(taken))) if c not in taken][:n]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for edges ``(a, b)``: component is the smallest node reachable.

    Contraction: each round every group takes the least of its own and its neighbours' labels, the pointers are jumped
    until all stand at a root, and the edges are drawn anew between roots, until none is left. A group that no neighbour
    joins in a round meets a smaller one in the next, so two rounds halve the groups at least, whatever the order of the
    ids; a chain of pointers halves with each jump. Every step is written to the shared folder, an edge once.
    """
    drawn = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    drawn = saved(drawn.where("a < b").distinct(), label + "-edges")
    labels = None
    while labels is None or drawn.limit(1).count():
        both = drawn.unionByName(drawn.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), label + "-roots")
        moved = True
        while moved:
            jump = roots.select(F.col("a").alias("to"), F.col("to").alias("next"))
            after = saved(roots.join(jump, "to").select("a", F.col("to").alias("was"), F.col("next").alias("to")), label + "-roots")
            moved = after.where("was <> to").limit(1).count() > 0
            roots = after.select("a", "to")
        if labels is None:
            labels = roots.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            at = roots.select(F.col("a").alias("component"), "to")
            labels = saved(labels.join(at, "component", "left").select("node", F.coalesce("to", "component").alias("component")), label)
        ends = [roots.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        apart = drawn.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
        drawn = saved(apart.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), label + "-edges")
    return labels

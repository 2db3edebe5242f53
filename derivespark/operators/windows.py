"""Flags and sequence numbers within groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ascending, descending, fail_if, need, ordering, predicate, scratch


def _beside(df: DataFrame, side: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``side`` (a row for each group ``by``, NULL keys too). Spark splits the rows of a busy
    group, or moves none of them if the side is small."""
    names = {c: f"_group_{i}" for i, c in enumerate(by)}
    on = F.lit(True)
    for c, k in names.items():
        on = on & F.col(c).eqNullSafe(F.col(k))
    return df.join(side.withColumnsRenamed(names), on, "left").drop(*names.values())


def _decided(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> Column:
    """An order in which only wholly equal records tie."""
    return ordering([*order, *[c for c in df.columns if c not in [*by, *order]]])


def extreme_flag(df: DataFrame, target: str, by: Sequence[str], order: Sequence[str], mode: str = "first", true_value: str = "Y", restrict: Column | str | None = None, on_ties: str = "pick", large_groups: bool = False) -> DataFrame:
    """Flag one first or last record per group; with ``restrict`` only rows that meet it compete and all rows stay.

    One pass: whether a row competes is part of the window's partition. ``on_ties='error'`` fails if several records are
    extreme; ``'pick'`` needs an order that decides.

    With ``large_groups`` no task takes a whole group: the extreme of each group is an aggregate, which combines before
    the shuffle, and is joined to the rows. Ties are decided by the other columns; wholly equal records are flagged alike.
    """
    need(df, *by, *order)
    competes = predicate(restrict) if restrict is not None else F.lit(True)
    if large_groups:
        best = {"first": F.min, "last": F.max}[mode]
        key = _decided(df, by, order) if on_ties == "pick" else ordering(order)
        side = df.filter(competes).groupBy(*by).agg(best(ordering(order) if on_ties == "error" else key).alias("_best"))
        joined = _beside(df, side, by)
        hit = competes & F.coalesce(key == F.col("_best"), F.lit(False))
        if on_ties == "error":
            ties = joined.filter(hit).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
            joined = _beside(joined, ties, by)
            value = fail_if(hit & (F.col("_n") > 1), f"several extreme records for {target}", F.when(hit, F.lit(true_value)))
            return joined.withColumn(target, value).drop("_best", "_n")
        return joined.withColumn(target, F.when(hit, F.lit(true_value))).drop("_best")
    sort = {"first": ascending, "last": descending}[mode](order)
    marked = df.withColumn("_competes", competes)
    window = Window.partitionBy(*by, "_competes").orderBy(*sort)
    hit = F.when(F.col("_competes") & (F.row_number().over(window) == 1), F.lit(true_value))
    if on_ties == "error":
        marked = marked.withColumn("_rank", F.rank().over(window))
        tied = F.count(F.when(F.col("_rank") == 1, 1)).over(Window.partitionBy(*by, "_competes")) > 1
        hit = fail_if(F.col("_competes") & tied, f"several extreme records for {target}", hit)
    return marked.withColumn(target, hit).drop("_competes", "_rank")


def restrict_derivation(df: DataFrame, fn: Callable[[DataFrame], DataFrame], filter: Column | str) -> DataFrame:
    """Apply a row-preserving derivation to the rows that meet ``filter``; the rest (NULL included) pass with NULL."""
    meets = predicate(filter)
    return fn(df.filter(meets)).unionByName(df.filter(~meets), allowMissingColumns=True)


def obs_number(df: DataFrame, target: str, by: Sequence[str], order: Sequence[str] | None = None, *, large_groups: bool = False, ranges: int | None = None) -> DataFrame:
    """1, 2, ... per group in ``order``; without it, and after it, all columns decide.

    With ``large_groups`` the rows are sorted into ``ranges`` (default: Spark's shuffle partitions) by group and order and
    written; a range numbers its own rows of a group from what the ranges before hold of it. At most one group goes on
    from a range into the next, so these sums are a row or so for each range. An action."""
    rest = [c for c in df.columns if c not in [*by, *(order or [])]]
    keys = ascending([*(order or []), *rest])
    if not large_groups:
        return df.withColumn(target, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "numbered")
    within = [*ascending(by), *keys]
    df.repartitionByRange(ranges, *within).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("_before", before).filter("_before IS NOT NULL").drop("_n")  # fewer rows than ranges
    names = {c: f"_group_{i}" for i, c in enumerate([*by, "_range"])}
    on = F.lit(True)
    for c, k in names.items():
        on = on & F.col(c).eqNullSafe(F.col(k))
    local = rows.withColumn(target, F.row_number().over(Window.partitionBy("_range", *by).orderBy(*keys)))
    joined = local.join(F.broadcast(before.withColumnsRenamed(names)), on, "left")
    return joined.withColumn(target, (F.col(target) + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, target)


def max_value_flag(df: DataFrame, target: str, by: Sequence[str], value: str, true_value: str = "Y", large_groups: bool = False) -> DataFrame:
    """Flag every record whose value equals the greatest of its group; with ``large_groups`` by an aggregate and a join."""
    if large_groups:
        joined = _beside(df, df.groupBy(*by).agg(F.max(value).alias("_most")), by)
        return joined.withColumn(target, F.when(F.col(value) == F.col("_most"), F.lit(true_value))).drop("_most")
    return df.withColumn(target, F.when(F.col(value) == F.max(value).over(Window.partitionBy(*by)), F.lit(true_value)))


def last_or_visit_flag(df: DataFrame, target: str, by: Sequence[str], order: Sequence[str], visit_col: str, visit, true_value: str = "Y", large_groups: bool = False) -> DataFrame:
    """Flag the records at ``visit``; in a group without that visit, the last record. With ``large_groups`` both are found by
    one aggregate and joined to the rows; ties are decided by the other columns, wholly equal records are flagged alike."""
    at = predicate(F.col(visit_col) == visit)
    if large_groups:
        key = _decided(df, by, order)
        joined = _beside(df, df.groupBy(*by).agg(F.max(at).alias("_has"), F.max(key).alias("_last")), by)
        return joined.withColumn(target, F.when(at | (~F.col("_has") & (key == F.col("_last"))), F.lit(true_value))).drop("_has", "_last")
    has = F.max(at).over(Window.partitionBy(*by))
    last = F.row_number().over(Window.partitionBy(*by).orderBy(*descending(order))) == 1
    return df.withColumn(target, F.when(at | (~has & last), F.lit(true_value)))

"""Merges onto a base table; the base never gains or loses rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fail_if, need, ordering, predicate, scratch


def _attach(df: DataFrame, side: DataFrame, by: Sequence[str], add: Mapping[str, str], null_keys_match: bool = False, broadcast: bool = False) -> DataFrame:
    """Left join of ``side`` (keys ``by``) giving each target of ``add`` from its column."""
    keys = {c: f"_by_{i}" for i, c in enumerate(by)}
    values = {t: f"_add_{i}" for i, t in enumerate(add)}
    right = side.select(*[F.col(c).alias(k) for c, k in keys.items()], *[F.col(add[t]).alias(v) for t, v in values.items()])
    on = None
    for c, k in keys.items():
        one = F.col(c).eqNullSafe(F.col(k)) if null_keys_match else F.col(c) == F.col(k)
        on = one if on is None else on & one
    joined = df.drop(*add).join(F.broadcast(right) if broadcast else right, on, "left")
    return joined.withColumnsRenamed({v: t for t, v in values.items()}).drop(*keys.values())


def merge_vars(df: DataFrame, add: DataFrame, targets: Mapping[str, str], by: Sequence[str], mode: str = "first", order: Sequence[str] | None = None, filter: Column | str | None = None, null_keys_match: bool = False) -> DataFrame:
    """Columns of the first or last record of ``add`` per key, several in one join. Without ``order`` a key with more
    than one record is an error. The record is found by a partial aggregate, so a busy key stays cheap."""
    need(add, *by, *targets.values(), *(order or []))
    need(df, *by)
    rows = add if filter is None else add.filter(predicate(filter))
    taken = F.struct(*[F.col(s).alias(f"v{i}") for i, s in enumerate(targets.values())])
    if order:
        pick = {"first": F.min_by, "last": F.max_by}[mode](taken, ordering([*order, *[c for c in targets.values() if c not in order]]))
    else:
        pick = fail_if(F.count(F.lit(1)) > 1, "duplicate_records", F.first(taken))
    one = rows.groupBy(*by).agg(pick.alias("_record"))
    one = one.select(*by, *[F.col(f"_record.v{i}").alias(f"_value_{i}") for i in range(len(targets))])
    return _attach(df, one, by, {t: f"_value_{i}" for i, t in enumerate(targets)}, null_keys_match)


def merge_var(df: DataFrame, add: DataFrame, target: str, source: str, by: Sequence[str], mode: str = "first", order: Sequence[str] | None = None, filter: Column | str | None = None, null_keys_match: bool = False) -> DataFrame:
    return merge_vars(df, add, {target: source}, by, mode, order, filter, null_keys_match)


def lookup_join(df: DataFrame, lookup: DataFrame, target: str, source: str, by: Sequence[str], null_keys_match: bool = False) -> DataFrame:
    """A value from a lookup table with unique keys. Spark broadcasts the lookup when its measured size allows."""
    need(lookup, *by, source)
    one = lookup.groupBy(*by).agg(fail_if(F.count(F.lit(1)) > 1, "duplicate lookup keys", F.first(source)).alias("_value"))
    return _attach(df, one, by, {target: "_value"}, null_keys_match)


def derive_base(df: DataFrame, by: Sequence[str], target: str = "BASE", source: str = "AVAL", flag: str = "ABLFL", flag_value: str = "Y") -> DataFrame:
    """The flagged record's value on all records of its group, by a window instead of a self-join. More than one flagged
    record in a group is an error."""
    need(df, *by, source, flag)
    group, flagged = Window.partitionBy(*by), F.col(flag) == flag_value
    value = F.max(F.when(flagged, F.col(source))).over(group)
    return df.withColumn(target, fail_if(F.count(F.when(flagged, 1)).over(group) > 1, "duplicate baseline records", value))


def exists_flag(df: DataFrame, add: DataFrame, target: str, by: Sequence[str], filter: Column | str | None = None, at_or_before: tuple[str, str] | None = None, true_value: str = "Y", false_value: str = "N") -> DataFrame:
    """``true_value`` if ``add`` has a record with the key that passes ``filter``. With ``at_or_before=(add column, df
    column)`` some such record must not be later than the row's own value: the least per key decides."""
    rows = add if filter is None else add.filter(predicate(filter))
    least = F.min(at_or_before[0]) if at_or_before else F.lit(1)
    marks = rows.groupBy(*by).agg(least.alias("_least"), F.count(F.lit(1)).alias("_n"))
    joined = _attach(df, marks, by, {"_exists_n": "_n", "_exists_least": "_least"})
    hit = F.col("_exists_n").isNotNull()
    if at_or_before:
        hit = predicate(F.col("_exists_least") <= F.col(at_or_before[1]))
    return joined.withColumn(target, F.when(hit, F.lit(true_value)).otherwise(F.lit(false_value))).drop("_exists_n", "_exists_least")


@dataclass(frozen=True)
class Pick:
    """Columns (``target: source``) of the first or last record per key that passes ``filter``; without ``order`` a second
    record is an error."""

    targets: Mapping[str, str]
    order: Sequence[str] | None = None
    mode: str = "first"
    filter: Column | str | None = None


@dataclass(frozen=True)
class Exists:
    """``true_value`` if some record passes ``filter`` and, with ``at_or_before=(add column, df column)``, is not later."""

    target: str
    filter: Column | str | None = None
    at_or_before: tuple[str, str] | None = None
    true_value: str = "Y"
    false_value: str = "N"


@dataclass(frozen=True)
class Summary:
    """``aggregate`` of ``value`` over the records that pass ``filter``."""

    target: str
    aggregate: Callable[[Column], Column]
    value: Column | str
    filter: Column | str | None = None


def merge_all(df: DataFrame, add: DataFrame, by: Sequence[str], wanted: Sequence[Pick | Exists | Summary]) -> DataFrame:
    """Everything that ``df`` takes from ``add`` by one key: one scan, one conditional aggregate and one join, however many
    merges there are. Each gives what ``merge_vars``, ``exists_flag`` or ``merge_summary`` gives alone."""
    need(add, *by)
    need(df, *by)
    sums, values, flags = [], {}, []
    for i, w in enumerate(wanted):
        passes = predicate(w.filter) if w.filter is not None else F.lit(True)
        if isinstance(w, Pick):
            need(add, *w.targets.values(), *(w.order or []))
            taken = F.when(passes, F.struct(*[F.col(s).alias(f"v{k}") for k, s in enumerate(w.targets.values())]))
            if w.order:
                rank = F.when(passes, ordering([*w.order, *[c for c in w.targets.values() if c not in w.order]]))
                one = {"first": F.min_by, "last": F.max_by}[w.mode](taken, rank)
            else:
                one = fail_if(F.count_if(passes) > 1, "duplicate_records", F.first(taken, ignorenulls=True))
            sums.append(one.alias(f"_m{i}"))
            values |= {t: F.col(f"_m{i}.v{k}") for k, t in enumerate(w.targets)}
        elif isinstance(w, Exists):
            least = F.min(F.when(passes, F.col(w.at_or_before[0]))) if w.at_or_before else F.max(F.when(passes, 1))
            sums.append(least.alias(f"_m{i}"))
            values[f"_exists_{i}"] = F.col(f"_m{i}")
            flags.append((i, w))
        else:
            value = F.expr(w.value) if isinstance(w.value, str) else w.value
            sums.append(w.aggregate(F.when(passes, value)).alias(f"_m{i}"))
            values[w.target] = F.col(f"_m{i}")
    one = add.groupBy(*by).agg(*sums)
    one = one.select(*by, *[v.alias(f"_value_{i}") for i, v in enumerate(values.values())])
    out = _attach(df, one, by, {t: f"_value_{i}" for i, t in enumerate(values)})
    for i, w in flags:
        found = F.col(f"_exists_{i}")
        hit = predicate(found <= F.col(w.at_or_before[1])) if w.at_or_before else found.isNotNull()
        out = out.withColumn(w.target, F.when(hit, F.lit(w.true_value)).otherwise(F.lit(w.false_value)))
    return out.drop(*[f"_exists_{i}" for i, _ in flags])


def pool_groups(df: DataFrame, target: str, group: str, arm: str, least: int, pooled: str = "900") -> DataFrame:
    """``target``: the group, or ``pooled`` for groups (sites, say) that have fewer than ``least`` rows in some ``arm``.

    An arm that a group lacks counts as none. If the pool itself has too few rows in some arm, the group with the fewest
    rows that is not pooled, of several the smallest by name, joins it; as that one has enough rows in every arm, so has
    the pool then. Without such a group all are in the pool, however small. NULL groups are NULL and not counted, nor are
    rows without an arm. Rows are counted by group and arm, these counts are written, and one row per group is joined
    back. An action."""
    need(df, group, arm)
    counts = df.where(F.col(group).isNotNull() & F.col(arm).isNotNull()).groupBy(F.col(group).cast("string").alias("_group"), F.col(arm).alias("_arm")).agg(F.count(F.lit(1)).alias("_n"))
    path = scratch(df.sparkSession, "pool-counts")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    arms = counts.agg(F.count_distinct("_arm").alias("_arms"))
    per = counts.groupBy("_group").agg(F.min("_n").alias("_min"), F.count("_arm").alias("_have"), F.sum("_n").alias("_rows"))
    per = per.join(F.broadcast(arms)).withColumn("_small", (F.col("_min") < least) | (F.col("_have") < F.col("_arms")))  # a single row
    pool = counts.join(per.where("_small").select("_group"), "_group", "left_semi").groupBy("_arm").agg(F.sum("_n").alias("_n"))
    pool = pool.agg(F.coalesce(F.min("_n"), F.lit(0)).alias("_least"), F.count("_arm").alias("_in")).join(F.broadcast(arms))
    short = pool.select(((F.col("_in") > 0) & ((F.col("_least") < least) | (F.col("_in") < F.col("_arms")))).alias("_short"))
    order = F.struct("_rows", "_group")
    extra = per.where("NOT _small").agg(F.min_by("_group", order).alias("_next"))
    told = per.join(F.broadcast(short)).join(F.broadcast(extra))  # single rows
    inside = F.col("_small") | (F.col("_short") & F.col("_group").eqNullSafe(F.col("_next")))
    path = scratch(df.sparkSession, "pool-groups")
    told.select("_group", F.when(inside, F.lit(pooled)).otherwise(F.col("_group")).alias("_pooled")).write.parquet(path)
    told = df.sparkSession.read.schema("_group string, _pooled string").parquet(path)
    joined = df.drop(target).join(told, F.col(group).cast("string") == F.col("_group"), "left")
    return joined.withColumn(target, F.coalesce("_pooled", F.col(group).cast("string"))).drop("_group", "_pooled")


def merge_coalesce(df: DataFrame, target: str, merges: Sequence[Mapping]) -> DataFrame:
    """The first non-null result of several ``merge_var`` calls, each given by its keyword arguments."""
    names = [f"_choice_{i}" for i in range(len(merges))]
    for name, how in zip(names, merges, strict=True):
        df = merge_var(df, target=name, **how)
    return df.withColumn(target, F.coalesce(*names)).drop(*names)

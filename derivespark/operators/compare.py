"""Comparison of a produced dataset with an oracle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 60
#: Numbers in one array of copies.
COPIES = 10_000
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def _date(c: Column, kind: str) -> Column:
    """Numbers are days since 1960-01-01."""
    return F.date_add(F.lit("1960-01-01").cast("date"), c.cast("int")) if _number(kind) else F.to_date(c)


def _joined(ours: DataFrame, oracle: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    left = ours.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"a{i}") for i, v in enumerate(variables)])
    right = oracle.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"b{i}") for i, v in enumerate(variables)])
    return left.join(right, [f"k{i}" for i in range(len(keys))])


def _canonical(v: str, c: Column, kinds: tuple[str, str], own: str) -> Column:
    """The form in which equal values are equal on both sides, whatever their types."""
    if v.endswith(("DT", "DTM")) or "date" in kinds:
        return _date(c, own).cast("string")
    if any(map(_number, kinds)):
        return (c.try_cast("double") + 0.0).cast("string")
    return c.cast("string")


def match_records(ours: DataFrame, oracle: DataFrame, variables: Sequence[str], keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """``k0.., a0.., b0.., kind, n``: records of both sides that belong together, for keys that may repeat.

    Equal records of a key are matched first, as many as both sides have (``kind`` equal); the others are paired in the
    order of their values (paired), and what one side has too many is unpaired (ours, oracle). ``n`` counts equal pairs.
    Records are counted before they are paired, so m and n records of a key give max(m, n) pairs at most, never m times n.
    NULL keys match nothing.

    Both sides are counted in one frame, first the copies from a partition, so that many copies of a record are dealt out,
    then all; each step in ``tasks`` partitions (default: Spark's shuffle partitions), which Spark does not put together."""
    tasks = tasks or int(ours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = [f"k{i}" for i in range(len(keys))]
    kinds = [(dict(ours.dtypes)[v], dict(oracle.dtypes)[v]) for v in variables]
    canon = [f"c{i}" for i in range(len(variables))]
    a, b = ([f"{x}{i}" for i in range(len(variables))] for x in "ab")
    known = F.lit(True)
    for c in k:
        known = known & F.col(c).isNotNull()

    def told(i: int, side: int) -> Column | None:
        """The value that a canonical form stands for, where it is no other than that."""
        v, own = variables[i], kinds[i][side]
        dated = v.endswith(("DT", "DTM")) or "date" in kinds[i]
        if own == "double" and not dated:
            return F.col(f"c{i}").cast("double")
        return F.col(f"c{i}") if own == "string" and not dated and not any(map(_number, kinds[i])) else None

    def key(i: int, side: int) -> Column:
        """As a comparison has it: text beside another type is read as that."""
        own, other = (dict(df.dtypes)[keys[i]] for df in ((ours, oracle), (oracle, ours))[side])
        whole = other in ("tinyint", "smallint", "int")
        return (F.col(keys[i]).cast("bigint" if whole else other) if own == "string" != other else F.col(keys[i])).alias(f"k{i}")

    named = lambda df, x: df.select(*[key(i, "ab".index(x)) for i in range(len(keys))], *[F.col(v).alias(f"{x}{i}") for i, v in enumerate(variables)])
    sides = [named(ours, "a"), named(oracle, "b")]
    types = [[(x, s.schema[x].dataType) for i, x in enumerate(xs)] for s, xs in zip(sides, (a, b), strict=True)]
    kept = [x for side, xs in enumerate((a, b)) for i, x in enumerate(xs) if told(i, side) is None]

    def rows(side: int) -> DataFrame:
        forms = [_canonical(v, F.col(f"{'ab'[side]}{i}"), kinds[i], kinds[i][side]).alias(f"c{i}") for i, v in enumerate(variables)]
        other = [F.lit(None).cast(kind).alias(x) for x, kind in types[1 - side] if x in kept]
        counts = [F.lit(int(side == s)).cast("long").alias(n) for s, n in enumerate(("n_a", "n_b"))]
        return sides[side].where(known).select(*k, *forms, *[x for x, _ in types[side] if x in kept], *other, *counts, F.spark_partition_id().alias("_from"))

    def counted(df: DataFrame, by: list[str]) -> DataFrame:
        # one of the values with equal forms
        return df.repartition(tasks, *by).groupBy(*by).agg(*[F.sum(n).alias(n) for n in ("n_a", "n_b")], *[F.min(x).alias(x) for x in kept])

    both = counted(counted(rows(0).unionByName(rows(1)), [*k, *canon, "_from"]), [*k, *canon])
    values = lambda side: [(F.col(x) if x in kept else told(i, side)).alias(x) for i, x in enumerate((a, b)[side])]
    same = both.where("n_a > 0 AND n_b > 0").select(*k, *values(0), *values(1), F.lit("equal").alias("kind"), F.least("n_a", "n_b").alias("n"))

    theirs = F.col("n_b") > F.col("n_a")
    own = [F.when(~theirs, x).alias(name) for x, name in zip(values(0), a, strict=True)] + [F.when(theirs, x).alias(name) for x, name in zip(values(1), b, strict=True)]
    rest = both.where("n_a <> n_b").select(*k, theirs.alias("_theirs"), *own, F.abs(F.col("n_a") - F.col("n_b")).alias("_more")).repartition(tasks, *k)
    order = Window.partitionBy(*k, "_theirs").orderBy(*a, *b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = _copies(rest.withColumn("_before", F.sum("_more").over(order) - F.col("_more"))).withColumn("_nth", F.col("_before") + F.col("_i"))
    place = Window.partitionBy(*k).orderBy("_nth", "_theirs")  # ours, then the oracle's record of that number
    pairs = each.withColumns({"_met": F.lag("_nth").over(place), "_next": F.lead(F.struct("_nth", *b)).over(place)}).where("_met IS NULL OR _met <> _nth")
    paired = F.coalesce(F.col("_next._nth") == F.col("_nth"), F.lit(False))
    kind = F.when(F.col("_theirs"), "oracle").when(paired, "paired").otherwise("ours")
    one = F.lit(1).cast("long").alias("n")
    pairs = pairs.select(*k, *a, *[F.when(paired, F.col(f"_next.{x}")).otherwise(F.col(x)).alias(x) for x in b], kind.alias("kind"), one)
    for side, name in enumerate(("ours", "oracle")):
        empty = [F.lit(None).cast(kind).alias(x) for x, kind in types[1 - side]]
        mine = sides[side].where(~known).select("*", *empty, F.lit(name).alias("kind"), one)
        pairs = pairs.unionByName(mine)
    return same.unionByName(pairs)


def _copies(df: DataFrame) -> DataFrame:
    """A row for each of ``_more`` copies, numbered from 1 in ``_i``; no array has more than ``COPIES`` numbers."""
    some = df.withColumn("_at", F.explode(F.sequence(F.lit(0), F.floor((F.col("_more") - 1) / COPIES))))
    last = F.least(F.col("_more"), (F.col("_at") + 1) * COPIES)
    return some.withColumn("_i", F.explode(F.sequence(F.col("_at") * COPIES + 1, last))).drop("_at")


KINDS = ("equal", "paired", "ours", "oracle")


def match_summary(matched: DataFrame) -> DataFrame:
    """``kind, n_pairs, n_keys``: pairs of each kind, and the keys that have some."""
    keys = [c for c in matched.columns if c[0] == "k" and c[1:].isdigit()]
    per = matched.groupBy(*keys).agg(*[F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind) for kind in KINDS])  # a row a key
    sums = per.agg(*[x for kind in KINDS for x in (F.sum(kind).alias(kind), F.count(kind).alias(f"n_{kind}"))])
    rows = [F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("n_pairs"), F.col(f"n_{kind}").alias("n_keys")) for kind in KINDS]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n_keys > 0")


def _agree(v: str, a: Column, b: Column, kinds: tuple[str, str], tol: float) -> Column:
    if v.endswith(("DT", "DTM")) or "date" in kinds:
        return _date(a, kinds[0]) == _date(b, kinds[1])
    if any(map(_number, kinds)):  # a number stored as text is a number; text that is none agrees with nothing
        return F.abs(a.try_cast("double") - b.try_cast("double")) <= tol
    return a.cast("string") == b.cast("string")


def compare_datasets(ours: DataFrame, oracle: DataFrame, variables: Sequence[str], keys: Sequence[str], id_var: str, tolerance: Mapping[str, float] | None = None, default_tol: float = 1e-6, round_digits: Mapping[str, int] | None = None, repeated: str = "join") -> DataFrame:
    """``variable, status, value_agree, value_agree_rounded, n_joined, na_agree``, a row per variable; percent to 1 decimal.

    Status is the first that holds of not_produced, not_in_oracle, id (value_agree is then the share of our rows whose id
    the oracle has), join_key, all_missing, compared. Values agree only if both are non-NULL; na_agree is the
    share of rows that are NULL on both sides or on neither. Where either side is a number both are compared as numbers. One key join and one aggregate serve up to ``CHUNK`` variables.

    Records that share a key on both sides are all joined with each other; with ``repeated="match"`` they are matched by
    ``match_records`` on all variables, so that n_joined is no more than the records of either side.
    """
    if repeated not in ("join", "match"):
        raise ValueError(f"unknown way {repeated} for repeated keys")
    tolerance, round_digits = tolerance or {}, round_digits or {}
    both = [v for v in variables if v in ours.columns and v in oracle.columns and v not in keys and v != id_var]
    kinds = {v: (dict(ours.dtypes)[v], dict(oracle.dtypes)[v]) for v in both}
    percent = lambda x: F.round(F.lit(100.0) * x, 1)
    share = lambda hit: F.try_divide(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n"))
    matched = match_records(ours, oracle, both, keys).where("kind IN ('equal', 'paired')") if repeated == "match" and both else None
    parts = []
    for at in range(0, len(both), CHUNK):
        some = both[at : at + CHUNK]
        sums, rows = [F.coalesce(F.sum("n"), F.lit(0)).alias("n_joined")], []
        for i, v in enumerate(some):
            a, b = (F.col(f"{x}{i + at if matched is not None else i}") for x in "ab")
            same = F.coalesce(_agree(v, a, b, kinds[v], tolerance.get(v, default_tol)), F.lit(False))
            rounded = same
            if v in round_digits and all(map(_number, kinds[v])):
                rounded = F.coalesce(F.abs(F.round(a.cast("double"), round_digits[v]) - b.cast("double")) <= tolerance.get(v, default_tol), F.lit(False))
            sums += [F.count(a).alias(f"pa{i}"), F.count(b).alias(f"pb{i}"), share(same).alias(f"s{i}"), share(rounded).alias(f"r{i}"), share(a.isNull() == b.isNull()).alias(f"m{i}")]
            empty = (F.col(f"pa{i}") == 0) & (F.col(f"pb{i}") == 0)
            rows.append(
                F.struct(
                    F.lit(v).alias("variable"),
                    F.when(empty, "all_missing").otherwise("compared").alias("status"),
                    F.when(~empty, percent(F.col(f"s{i}"))).alias("value_agree"),
                    (F.when(~empty, percent(F.col(f"r{i}"))) if v in round_digits else F.lit(None).cast("double")).alias("value_agree_rounded"),
                    F.col("n_joined"),
                    percent(F.col(f"m{i}")).alias("na_agree"),
                )
            )
        pairs = _joined(ours, oracle, some, keys).withColumn("n", F.lit(1).cast("long")) if matched is None else matched
        parts.append(pairs.agg(*sums).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*"))
    told = [(v, "not_produced" if v not in ours.columns else "not_in_oracle" if v not in oracle.columns else "join_key", None, None, None, None) for v in variables if v not in both and not (v == id_var and v in ours.columns and v in oracle.columns)]
    schema = "variable string, status string, value_agree double, value_agree_rounded double, n_joined long, na_agree double"
    if told:
        parts.append(ours.sparkSession.createDataFrame(told, schema))
    if id_var in variables and id_var in ours.columns and id_var in oracle.columns:
        known = oracle.select(F.col(id_var).alias("_id")).distinct().withColumn("_hit", F.lit(1))
        share = ours.select(id_var).join(known, F.col(id_var) == F.col("_id"), "left").agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
        parts.append(share.select(F.lit(id_var).alias("variable"), F.lit("id").alias("status"), percent(F.col("x")).alias("value_agree"), F.lit(None).cast("double").alias("value_agree_rounded"), F.col("n").alias("n_joined"), F.lit(None).cast("double").alias("na_agree")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_headline(acc: DataFrame, ours: DataFrame, oracle: DataFrame) -> DataFrame:
    """``n_compared, n_full, n_partial, mean_agree`` without the id variable, and the row counts of both sides."""
    done = F.col("status") == "compared"
    head = acc.agg(
        F.count_if(done).alias("n_compared"),
        F.count_if(done & (F.col("value_agree") == 100)).alias("n_full"),
        F.count_if(done & (F.col("value_agree") < 100)).alias("n_partial"),
        F.round(F.avg(F.when(done, F.col("value_agree"))), 1).alias("mean_agree"),
    )
    sides = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((ours, "n_ours"), (oracle, "n_oracle"))]
    return head.join(F.broadcast(sides[0])).join(F.broadcast(sides[1]))  # single rows


def mismatch_rows(ours: DataFrame, oracle: DataFrame, var: str, keys: Sequence[str], tol: float = 1e-6, extra: Sequence[str] = ()) -> DataFrame:
    """Joined rows whose values differ or are not both present: the keys, ``extra`` columns of ours, ``ours``, ``oracle``."""
    kinds = (dict(ours.dtypes)[var], dict(oracle.dtypes)[var])
    left = ours.select(*keys, *extra, F.col(var).alias("ours"))
    joined = left.join(oracle.select(*keys, F.col(var).alias("oracle")), list(keys))
    same = F.coalesce(_agree(var, F.col("ours"), F.col("oracle"), kinds, tol), F.lit(False))
    return joined.filter(~same)


def mismatch_distribution(mismatches: DataFrame, column: str) -> DataFrame:
    return mismatches.groupBy(column).agg(F.count(F.lit(1)).alias("n_mismatch"))


def silent_errors(acc: DataFrame, status: DataFrame, checks: DataFrame) -> DataFrame:
    """Variables that ran, failed no check, were compared, and agree in less than 100 %."""
    failed = checks.filter("status = 'FAIL'").select("variable").distinct()
    ran = status.filter("status = 'executed'").select("variable").distinct()
    return acc.filter("status = 'compared' AND value_agree < 100").select("variable", "value_agree").join(ran, "variable", "left_semi").join(failed, "variable", "left_anti")

"""Summary-statistic tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicate, scratch

#: Operation, scale, decimals shown, order.
OPERATIONS = {
    "n": ("any", 0, 1),
    "count": ("categorical", 0, 2),
    "pct": ("categorical", 1, 3),
    "mean": ("numeric", 1, 4),
    "sd": ("numeric", 2, 5),
    "median": ("numeric", 1, 6),
    "q1": ("numeric", 1, 7),
    "q3": ("numeric", 1, 8),
    "min": ("numeric", 1, 9),
    "max": ("numeric", 1, 10),
}
STATISTICS = {
    "n": lambda x: F.count(x).cast("double"),
    "mean": F.avg,
    "sd": F.stddev_samp,
    "median": None,  # the quantiles have ways of their own
    "q1": None,
    "q3": None,
    "min": F.min,
    "max": F.max,
}


def method_spec(operations: Sequence[str], categorical: bool = False) -> list[dict]:
    """The operations in registry order with pattern, scale and order; unknown, repeated or unfit ones are refused."""
    if len(set(operations)) != len(operations):
        raise ValueError("an operation is repeated")
    for name in operations:
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name}")
        if OPERATIONS[name][0] == ("numeric" if categorical else "categorical"):
            raise ValueError(f"{name} does not fit the variable")
    ordered = sorted(operations, key=lambda name: OPERATIONS[name][2])
    return [{"operation": n, "scale": OPERATIONS[n][0], "pattern": "XX" + ("." + "X" * OPERATIONS[n][1]) * bool(OPERATIONS[n][1]), "order": OPERATIONS[n][2]} for n in ordered]


QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}
#: Steps of the sketched distribution, and its accuracy, by which a quantile is enclosed; a bracket of at most so many rows is
#: sorted.
STEPS, ACCURACY, SORTED_ROWS = 200, 10_000, 500_000


def exact_quantiles(rows: DataFrame, quantiles: Sequence[str]) -> DataFrame:
    """``(_key, <quantile>, ...)`` for a written table ``(_key, x)``: exact, with linear interpolation, for groups of any size.
    NaN ranks, and shows, as infinity. An action.

    A mergeable sketch of each group's distribution encloses the two ranks of a quantile between two values; it is sure
    within one part in ``ACCURACY``, and a step is taken on either side. While a bracket may hold over ``SORTED_ROWS`` rows,
    a sketch of these alone encloses the ranks more closely. Then the rows below a bracket are counted and its values
    counted one by one, of which a running sum finds the ranks. No task ever holds the values of a group."""
    spark = rows.sparkSession
    x = rows.select("_key", F.when(F.isnan("x"), float("inf")).otherwise(F.col("x")).alias("x")).where("x is not null")
    named = {n: QUANTILES[n] for n in quantiles}
    grid = [i / STEPS for i in range(STEPS + 1)]
    bracket = F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    state = x.groupBy("_key").agg(F.count("x").alias("n")).select("_key", "n", *[bracket.alias(n) for n in named])
    inside = lambda n: F.coalesce(F.col(f"{n}.low") <= F.col("x"), F.lit(True)) & F.coalesce(F.col("x") <= F.col(f"{n}.high"), F.lit(True))
    held = None
    while True:
        path = scratch(spark, "quantiles")
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if held is None:
            held = state.agg(F.max("n")).first()[0] or 0
        if held <= SORTED_ROWS:
            break
        joined = x.join(state, "_key")
        sketch = [F.percentile_approx(F.when(inside(n), F.col("x")), grid, ACCURACY).alias(f"_grid_{n}") for n in named]
        counts = [c for n in named for c in (F.count_if(F.col("x") < F.col(f"{n}.low")).alias(f"_below_{n}"), F.count_if(inside(n)).alias(f"_in_{n}"))]
        found = joined.groupBy("_key").agg(F.first("n").alias("n"), *[F.first(n).alias(n) for n in named], *sketch, *counts)

        def closer(n: str, p: float) -> Column:
            values, size = F.col(f"_grid_{n}"), F.col(f"_in_{n}")
            at = F.lit(p) * (F.col("n") - 1) - F.col(f"_below_{n}")
            low = F.floor(F.floor(at) / size * STEPS).cast("int") - 1  # a step further out than the rank
            high = F.ceil((F.ceil(at) + 1) / size * STEPS).cast("int") + 1
            lower = F.when(low >= 0, F.get(values, low)).otherwise(F.col(f"{n}.low"))
            upper = F.when(high <= STEPS, F.get(values, high)).otherwise(F.col(f"{n}.high"))
            return F.struct(lower.alias("low"), upper.alias("high")).alias(n)

        state = found.select("_key", "n", *[closer(n, p) for n, p in named.items()])
        held = held * 6 // STEPS
    one = x.join(state, "_key").select("_key", "n", "x", F.explode(F.array(*[F.struct(F.lit(n).alias("q"), F.lit(p).alias("p"), F.col(n).alias("b")) for n, p in named.items()])).alias("s"))
    one = one.select("_key", "n", "s.q", "s.p", (F.col("x") < F.col("s.b.low")).alias("below"), "x", F.col("s.b.high").alias("high"))
    one = one.withColumn("below", F.coalesce("below", F.lit(False))).where("below or high is null or x <= high")
    counted = one.groupBy("_key", "n", "q", "p", F.when(~F.col("below"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("_key", "q").orderBy(F.asc_nulls_first("x")))
    at = F.col("p") * (F.col("n") - 1)
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    found = counted.withColumn("upto", upto).groupBy("_key", "q").agg(pick(F.floor(at)).alias("low"), pick(F.ceil(at)).alias("high"), F.first(at - F.floor(at)).alias("part"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    wide = [F.max(F.when(F.col("q") == n, F.col("value"))).alias(n) for n in named]
    return found.withColumn("value", value).groupBy("_key").agg(*wide)


def _statistic(name: str, x: Column, accuracy: int | None) -> Column:
    if name in QUANTILES:
        return F.percentile_approx(x, QUANTILES[name], accuracy)
    return STATISTICS[name](x)


def analysis(df: DataFrame, output: str, analysis_id: str, variable: str, operations: Sequence[str], grouping: Sequence[str] = (), analysis_set: Column | str | None = None, data_subset: Column | str | None = None, accuracy: int | None = None) -> DataFrame:
    """``output, analysis_id, <grouping>, level, operation, op_order, value, display``, a row per statistic and group.

    Numeric statistics of a variable are one aggregate; count and pct are per level, with the rows of the analysis
    set in the group, before ``data_subset``, as denominator. NULL group keys form a group. Quantiles are exact for groups of
    any size, by ``exact_quantiles``, for which groups and values are written once and read by all statistics; with
    ``accuracy`` mergeable sketches give them within one part in ``accuracy`` of the rank, without an action.
    """
    categorical = "count" in operations or "pct" in operations
    spec = method_spec(operations, categorical)
    base = df if analysis_set is None else df.filter(predicate(analysis_set))
    rows = base if data_subset is None else base.filter(predicate(data_subset))
    numeric = [m["operation"] for m in spec if m["operation"] in STATISTICS]
    parts = []
    if numeric:
        x = F.col(variable) if categorical else F.col(variable).cast("double")
        exact = [n for n in numeric if n in QUANTILES and not accuracy]
        if exact:
            path = scratch(df.sparkSession, "analysis")
            rows.select(F.struct(F.lit(0).alias("_all"), *grouping).alias("_key"), x.alias("x")).write.parquet(path)
            kept = df.sparkSession.read.parquet(path)
            wide = kept.groupBy("_key").agg(F.count("x"), *[_statistic(n, F.col("x"), accuracy).alias(n) for n in numeric if n not in exact])
            found = exact_quantiles(kept, exact).withColumnRenamed("_key", "_of")
            wide = wide.join(found, F.col("_key").eqNullSafe(F.col("_of")), "left").select(*[F.col(f"_key.{g}").alias(g) for g in grouping], *numeric)
        else:
            wide = rows.groupBy(*grouping).agg(*[_statistic(n, x, accuracy).alias(n) for n in numeric])
        stats = F.array(*[F.struct(F.lit(n).alias("operation"), F.col(n).cast("double").alias("value")) for n in numeric])
        parts.append(wide.select(*grouping, F.lit(None).cast("string").alias("level"), F.explode(stats).alias("_s")).select(*grouping, "level", "_s.*"))
    if categorical:
        counted = rows.filter(F.col(variable).isNotNull()).groupBy(*grouping, F.col(variable).cast("string").alias("level")).agg(F.count(F.lit(1)).cast("double").alias("count"))
        denominator = base.groupBy(*grouping).agg(F.count(F.lit(1)).cast("double").alias("_rows"))
        on = F.lit(True)
        right = denominator.withColumnsRenamed({g: f"_g_{g}" for g in grouping})
        for g in grouping:
            on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        joined = counted.join(right, on) if grouping else counted.join(F.broadcast(right), on)  # without groups it is one row
        joined = joined.withColumn("pct", F.try_divide(F.lit(100.0) * F.col("count"), F.col("_rows")))
        stats = F.array(*[F.struct(F.lit(n).alias("operation"), F.col(n).alias("value")) for n in ("count", "pct") if n in operations])
        parts.append(joined.select(*grouping, "level", F.explode(stats).alias("_s")).select(*grouping, "level", "_s.*"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order, shown = F.lit(None).cast("int"), F.lit(None).cast("string")
    for m in spec:
        mine = F.col("operation") == m["operation"]
        order = F.when(mine, F.lit(m["order"])).otherwise(order)
        shown = F.when(mine, F.format_string(f"%.{OPERATIONS[m['operation']][1]}f", F.col("value"))).otherwise(shown)
    shown = F.when(F.col("value").isNotNull(), shown)
    return out.select(F.lit(output).alias("output"), F.lit(analysis_id).alias("analysis_id"), *grouping, "level", "operation", order.alias("op_order"), "value", shown.alias("display"))


def analysis_table(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """The results of several analyses, one below the other; a grouping column that one lacks is NULL there."""
    out = None
    for spec in specs:
        one = analysis(df, **spec)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out

"""Records and aggregates: parameters, summaries, first per key, doses over intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fail_if, formula, need, ordering, predicate
from .joins import _attach

SUMMARIES = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}


def compute_param(df: DataFrame, paramcd: str, param: str | None, parameters: Sequence[str], value: Column | str, by: Sequence[str], avalu: str | None = None, filter: Column | str | None = None, constant_parameters: Sequence[str] = (), constant_by: Sequence[str] | None = None) -> DataFrame:
    """Append a record per group whose AVAL is a formula over the AVAL of other parameters, each named by its PARAMCD.

    A group needs every parameter, non-NULL; two records of one parameter in a group are an error. ``constant_parameters``
    hold per ``constant_by`` (e.g. the subject) and serve all its groups. Columns other than ``by`` are NULL in new
    records; records that already have this PARAMCD are replaced.
    """
    if paramcd in [*parameters, *constant_parameters]:
        raise ValueError("a parameter cannot be computed from itself")
    need(df, *by, "PARAMCD", "AVAL")
    rows = df if filter is None else df.filter(predicate(filter))

    def wide(names: Sequence[str], keys: Sequence[str]) -> DataFrame:
        own = lambda p: F.when(F.col("PARAMCD") == p, F.col("AVAL"))
        count = lambda p: F.count(F.when(F.col("PARAMCD") == p, 1))
        sums = [fail_if(count(p) > 1, f"duplicate_records: {p}", F.max(own(p))).alias(p) for p in names]
        return rows.filter(F.col("PARAMCD").isin(list(names))).groupBy(*keys).agg(*sums)

    made = wide(parameters, by)
    if constant_parameters:
        made = _attach(made, wide(constant_parameters, constant_by or by), constant_by or by, {p: p for p in constant_parameters})
    for p in [*parameters, *constant_parameters]:
        made = made.filter(F.col(p).isNotNull())
    made = made.withColumn("AVAL", formula(value).cast("double")).withColumn("PARAMCD", F.lit(paramcd))
    extra = {"PARAM": param, "AVALU": avalu}
    made = made.withColumns({c: F.lit(v) for c, v in extra.items() if v is not None}).drop(*[p for p in [*parameters, *constant_parameters] if p not in by])
    return df.filter(~predicate(F.col("PARAMCD") == paramcd)).unionByName(made, allowMissingColumns=True)


def summary_record(df: DataFrame, paramcd: str, param: str | None, by: Sequence[str], summary_fun: str, analysis_var: str = "AVAL", filter: Column | str | None = None) -> DataFrame:
    """Append a record per group with the mean, median, min, max or sum of ``analysis_var``, NULLs left out; records that
    already have this PARAMCD are replaced and not summarised."""
    need(df, *by, "PARAMCD", analysis_var)
    others = df.filter(~predicate(F.col("PARAMCD") == paramcd))
    rows = others if filter is None else others.filter(predicate(filter))
    made = rows.groupBy(*by).agg(SUMMARIES[summary_fun](analysis_var).cast("double").alias("_summary"))
    made = made.withColumns({"PARAMCD": F.lit(paramcd), analysis_var: F.col("_summary")} | ({"PARAM": F.lit(param)} if param is not None else {}))
    return others.unionByName(made.drop("_summary"), allowMissingColumns=True)


def merge_summary(df: DataFrame, add: DataFrame, target: str, by: Sequence[str], agg: Column, filter: Column | str | None = None) -> DataFrame:
    """An aggregate of the filtered records of ``add`` per key, merged on; no records give NULL."""
    rows = add if filter is None else add.filter(predicate(filter))
    return _attach(df, rows.groupBy(*by).agg(agg.alias("_summary")), by, {target: "_summary"})


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole record per key in ``order``, ties by all columns."""
    rest = [c for c in df.columns if c not in order]
    whole = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*by).agg(F.min_by(whole, ordering([*order, *rest])).alias("_record"))
    return picked.select("_record.*")


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def interval_dose(df: DataFrame, target: str, bounds: Sequence[str], doses: Sequence[Column | str], last: str) -> DataFrame:
    """Cumulative dose over the intervals that ``bounds`` (dates) cut, the k-th at ``doses[k]`` a day, up to ``last``
    inclusive. An interval without a start adds nothing; one without an end runs to ``last``."""
    total = F.lit(0.0)
    for k, dose in enumerate(doses):
        start = F.to_date(bounds[k])
        stop = F.to_date(last)
        if k + 1 < len(bounds):
            stop = F.least(stop, F.coalesce(F.date_sub(F.to_date(bounds[k + 1]), 1), stop))
        days = F.greatest(F.coalesce(F.datediff(stop, start) + 1, F.lit(0)), F.lit(0))
        total = total + days * F.coalesce(formula(dose).cast("double"), F.lit(0.0))
    return df.withColumn(target, F.when(F.col(last).isNotNull(), total))

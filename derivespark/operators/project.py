"""Row-wise derivations: copies, formulas, conditions, categories, codelists."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fail_if, formula, need, predicate


def assign(df: DataFrame, target: str, from_: str | None = None, literal=None) -> DataFrame:
    """Copy a column, or set a constant: exactly one of the two."""
    if (from_ is None) == (literal is None):
        raise ValueError("assign takes either from_ or literal")
    if from_ is not None:
        need(df, from_)
    return df.withColumn(target, F.lit(literal) if from_ is None else F.col(from_))


def compute_var(df: DataFrame, target: str, value: Column | str) -> DataFrame:
    """Row arithmetic; divide with ``try_divide`` (NULL on a zero divisor)."""
    return df.withColumn(target, formula(value))


def assign_conditional(df: DataFrame, target: str, condition: Column | str, true_value, else_value=None) -> DataFrame:
    """``true_value`` where the condition is met; otherwise, or if it is NULL, ``else_value``."""
    if isinstance(condition, str) and re.search(rf"\b{re.escape(target)}\b", re.sub(r"'[^']*'", "", condition)):
        raise ValueError(f"the condition reads its own target {target}")
    return df.withColumn(target, F.when(predicate(condition), F.lit(true_value)).otherwise(F.lit(else_value)))


def categorize(df: DataFrame, target: str, from_: str, breaks: Sequence[float], labels: Sequence[str], right: bool = True, include_lowest: bool = True) -> DataFrame:
    """Labels of the intervals between ``breaks``: ``(a, b]`` if ``right``, else ``[a, b)``; ``include_lowest`` closes the
    outermost open edge. Values outside, NULL and NaN give NULL."""
    if len(breaks) < 2 or any(a >= b for a, b in zip(breaks, breaks[1:], strict=False)) or len(labels) != len(breaks) - 1:
        raise ValueError("breaks must increase strictly and have one more member than labels")
    need(df, from_)
    x, last = F.col(from_).cast("double"), len(labels) - 1

    def inside(i: int) -> Column:
        low, high = breaks[i], breaks[i + 1]
        closed_low = not right or (include_lowest and i == 0)
        closed_high = right or (include_lowest and i == last)
        return (x >= low if closed_low else x > low) & (x <= high if closed_high else x < high)

    out = F.when(x.isNull() | F.isnan(x), F.lit(None))
    for i, label in enumerate(labels):
        out = out.when(inside(i), F.lit(label))
    return df.withColumn(target, out)


#: A codelist has at most so many codes; a variable with more is an error, found before its values meet in one task.
MAX_CODES = 100_000


def codelist_from_data(df: DataFrame, var: str, max_codes: int = MAX_CODES) -> DataFrame:
    """``(code, decode)``: the distinct non-null values in order, numbered from 1. More than ``max_codes`` are an error."""
    values = df.select(F.col(var).cast("string").alias("decode")).where(F.col("decode").isNotNull()).distinct().limit(max_codes + 1)
    code = F.row_number().over(Window.orderBy("decode")).cast("long")
    return values.select(fail_if(code > max_codes, f"more than {max_codes} codes", code).alias("code"), "decode")


def codelist_var(df: DataFrame, target: str, from_: str, codelist: DataFrame, decode_to_code: bool = True) -> DataFrame:
    """The code of a decode, or the decode of a code; no match gives NULL, a repeated key is an error."""
    need(df, from_)
    key, value = ("decode", "code") if decode_to_code else ("code", "decode")
    one = codelist.groupBy(F.col(key).alias("_code_key")).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_value"))
    one = one.select("_code_key", fail_if(F.col("_n") > 1, f"codelist has a repeated {key}", F.col("_value")).alias("_code_value"))
    joined = df.join(one, F.col(from_).cast("string") == F.col("_code_key").cast("string"), "left")
    return joined.withColumn(target, F.col("_code_value")).drop("_code_key", "_code_value")


def to_bds(df: DataFrame, paramcd_from: str, aval_from: str) -> DataFrame:
    """``PARAMCD`` and ``AVAL`` of a findings table."""
    need(df, paramcd_from, aval_from)
    return df.withColumns({"PARAMCD": F.col(paramcd_from), "AVAL": F.col(aval_from).cast("double")})


def keyword_flag(df: DataFrame, target: str, value: str, contains: Mapping[str, Sequence[str]] | None = None, equals: Mapping[str, Sequence[str]] | None = None, exclude: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``value`` where a column contains any of its strings, or equals any of its values and no column is in ``exclude``."""
    hit = F.lit(False)
    for column, words in (contains or {}).items():
        hit = hit | predicate(F.col(column).rlike("|".join(rf"\Q{w}\E" for w in words)))
    same = F.lit(bool(equals))
    for column, values in (equals or {}).items():
        same = same & predicate(F.col(column).isin(list(values)))
    for column, values in (exclude or {}).items():
        same = same & ~predicate(F.col(column).isin(list(values)))
    return df.withColumn(target, F.when(hit | same, F.lit(value)))


def param_label(df: DataFrame, target: str, test: str, unit: str) -> DataFrame:
    """``TEST (UNIT)``; without a unit the test alone."""
    return df.withColumn(target, F.when(F.col(unit).isNull() | (F.col(unit) == ""), F.col(test)).otherwise(F.concat(F.col(test), F.lit(" ("), F.col(unit), F.lit(")"))))


def keep_where(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(predicate(condition))



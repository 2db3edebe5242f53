"""Dates: partial ISO-8601 strings, durations, shifts, study days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import need

PARTS = ("year", "month", "day", "hour", "minute", "second")
#: Fixed pattern: YYYY[-MM[-DD[THH[:MM[:SS]]]]], a single dash for a missing part.
ISO = r"^(\d{4}|-)(?:-(\d{2}|-)(?:-(\d{2}|-)(?:[T ](\d{2}|-)(?::(\d{2}|-)(?::(\d{2}|-)(?:\.\d+)?)?)?)?)?)?$"


def impute_dtc(df: DataFrame, target: str, dtc: str, output: str = "dt", highest_imputation: str = "D", date_imputation: str = "first", time_imputation: str | None = None) -> DataFrame:
    """A date or timestamp from a partial ISO string, with ``<stem>DTF`` (and ``<stem>TMF`` for timestamps).

    A missing year gives NULL. A missing month is filled only if ``highest_imputation`` is M or Y, a missing day if it is
    D, M or Y; a missing month makes the day missing. ``first`` fills with the least, ``last`` with the greatest value. The
    flags name the highest part filled and are NULL if none was or there is no result. Impossible dates give NULL.
    """
    suffix = {"dt": "DT", "dtm": "DTM"}[output]
    stem = target[: -len(suffix)]
    if not target.endswith(suffix) or target == dtc or dtc in (stem + "DTF", stem + "TMF"):
        raise ValueError(f"the target must end in {suffix} and differ from the source")
    if time_imputation is not None and output != "dtm":
        raise ValueError("time_imputation needs a timestamp")
    if highest_imputation not in "YMD" or date_imputation not in ("first", "last") or time_imputation not in (None, "first", "last"):
        raise ValueError("unknown imputation")
    need(df, dtc)
    last, late, (name,) = date_imputation == "last", time_imputation == "last", _helpers(df, 1)

    def read(text: Column) -> Column:  # the whole and six parts; the pattern admits no line break
        part = lambda i: F.when(F.size(text) == 7, F.nullif(F.nullif(F.get(text, F.lit(i)), F.lit("")), F.lit("-")))
        return F.struct(*[part(i).alias(n) for i, n in enumerate(PARTS, 1)])

    def settle(parts: Column) -> Column:
        year, month, day, hour, minute, second = (parts[n] for n in PARTS)
        day = F.when(month.isNotNull(), day)  # without a month the day says nothing
        hour = F.when(day.isNotNull(), hour)
        minute = F.when(hour.isNotNull(), minute)
        second = F.when(minute.isNotNull(), second)
        allowed = year.isNotNull() if highest_imputation in "MY" else year.isNotNull() & month.isNotNull()
        date = F.try_to_date(F.concat_ws("-", year, F.coalesce(month, F.lit("12" if last else "01")), F.coalesce(day, F.lit("01"))), "yyyy-MM-dd")
        value = F.when(allowed, F.when(day.isNull(), F.last_day(date)).otherwise(date) if last else date)
        if output == "dtm":
            clock = F.concat_ws(":", F.coalesce(hour, F.lit("23" if late else "00")), F.coalesce(minute, F.lit("59" if late else "00")), F.coalesce(second, F.lit("59" if late else "00")))
            value = F.try_to_timestamp(F.concat(value.cast("string"), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))
        date_flag = F.when(month.isNull(), F.lit("M")).when(day.isNull(), F.lit("D"))
        time_flag = F.when(hour.isNull(), F.lit("H")).when(minute.isNull(), F.lit("M")).when(second.isNull(), F.lit("S"))
        return F.struct(value.alias("value"), date_flag.alias("date_flag"), time_flag.alias("time_flag"))

    lines = F.split(F.regexp_replace(F.trim(F.col(dtc).cast("string")), ISO, "\n$1\n$2\n$3\n$4\n$5\n$6"), "\n")
    found = F.col(name)
    flags = {stem + "DTF": found["date_flag"]} | ({stem + "TMF": found["time_flag"]} if output == "dtm" else {})
    out = df.withColumn(name, _bound(_bound(lines, read), settle))
    return out.withColumns({target: found["value"]} | {c: F.when(found["value"].isNotNull(), flag) for c, flag in flags.items()}).drop(name)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used and wherever the expression is moved to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _helpers(df: DataFrame, n: int) -> list[str]:
    """Names of helper columns that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"_part{i}" for i in range(n + len(taken))) if c not in taken][:n]


def dtm_to_dt(df: DataFrame, source: str) -> DataFrame:
    if not source.endswith("DTM"):
        raise ValueError("the source must end in DTM")
    return df.withColumn(source[:-1], F.to_date(source))


def whole_years(start: Column, end: Column) -> Column:
    """Anniversaries passed, toward zero."""
    def passed(a: Column, b: Column) -> Column:
        return F.year(b) - F.year(a) - (F.date_format(b, "MMdd") < F.date_format(a, "MMdd")).cast("int")

    return F.when(end >= start, passed(start, end)).otherwise(-passed(end, start))


def whole_months(start: Column, end: Column) -> Column:
    def passed(a: Column, b: Column) -> Column:
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")

    return F.when(end >= start, passed(start, end)).otherwise(-passed(end, start))


def duration(df: DataFrame, target: str, start: str, end: str, out_unit: str = "days", add_one: bool = False, trunc_out: bool | None = None) -> DataFrame:
    """Time from ``start`` to ``end`` in days, months or years, as a double. Truncated (the default for years) means whole
    units toward zero; else days keep the time of day, months are days / 30.4375 and years days / 365.25. ``add_one`` adds
    one if the end is not before the start."""
    if out_unit not in ("days", "months", "years"):
        raise ValueError("out_unit is days, months or years")
    need(df, start, end)
    whole = out_unit == "years" if trunc_out is None else trunc_out
    a, b = F.col(start), F.col(end)
    dates = all(dict(df.dtypes)[c] == "date" for c in (start, end))
    stamp = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    days = F.datediff(b, a).cast("double") if dates else (stamp(b) - stamp(a)) / F.lit(86_400_000_000.0)
    if out_unit == "days":
        out = F.when(days >= 0, F.floor(days)).otherwise(F.ceil(days)).cast("double") if whole else days
    elif whole:
        out = (whole_years if out_unit == "years" else whole_months)(F.to_date(a), F.to_date(b)).cast("double")
    else:
        out = days / (365.25 if out_unit == "years" else 30.4375)
    return df.withColumn(target, out + F.when(F.lit(add_one) & (days >= 0), 1.0).otherwise(0.0))


def date_shift(df: DataFrame, target: str, source: str, days: int) -> DataFrame:
    if isinstance(days, bool) or int(days) != days:
        raise ValueError("days must be whole")
    return df.withColumn(target, F.date_add(F.to_date(source), int(days)))


def study_day(df: DataFrame, target: str, date: str, ref: str) -> DataFrame:
    """1 on the reference day, -1 the day before: there is no day 0."""
    days = F.datediff(F.to_date(date), F.to_date(ref))
    return df.withColumn(target, F.when(days >= 0, days + 1).otherwise(days))

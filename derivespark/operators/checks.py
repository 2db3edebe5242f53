"""Data checks, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "variable string, check string, status string, details string"


def codelist_violations(df: DataFrame, var: str, codelist: DataFrame, key: str = "decode") -> DataFrame:
    """Non-null values of ``var`` outside the codelist, with their rows."""
    values = df.where(F.col(var).isNotNull()).groupBy(F.col(var).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return values.join(codelist.select(F.col(key).cast("string").alias("value")).distinct(), "value", "left_anti")


def codelists_violations(df: DataFrame, codelists: Mapping[str, DataFrame], key: str = "decode") -> DataFrame:
    """``variable, value, n_rows``: non-null values of each variable outside its codelist, all variables in one pass: a row
    is expanded to its values, which are counted and joined to one table of all codelists."""
    values = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in codelists])
    counted = df.select(F.explode(values).alias("_v")).select("_v.*").where(F.col("value").isNotNull()).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    known = None
    for v, codes in codelists.items():
        one = codes.select(F.lit(v).alias("variable"), F.col(key).cast("string").alias("value"))
        known = one if known is None else known.unionByName(one)
    return counted.join(known.distinct(), ["variable", "value"], "left_anti")


def key_sets_duplicates(df: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """``key_set, n_duplicates``: rows beyond the first of each key, for several sets of key columns in one pass by grouping
    sets: a row is expanded to its keys, which are counted before the shuffle."""
    columns = list(dict.fromkeys(c for keys in key_sets.values() for c in keys))
    named = {c: f"_k{i}" for i, c in enumerate(columns)}
    sets = ", ".join("(" + ", ".join(f"_k{columns.index(c)}" for c in keys) + ")" for keys in key_sets.values())
    rows = df.select(*[F.col(c).alias(k) for c, k in named.items()])
    sql = f"SELECT grouping_id({', '.join(named.values())}) AS _set, count(*) AS _n FROM {{rows}} GROUP BY GROUPING SETS ({sets})"
    counted = df.sparkSession.sql(sql, rows=rows)
    bits = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for name, keys in key_sets.items()}
    told = F.array(*[F.struct(F.lit(name).alias("key_set"), F.lit(b).cast("long").alias("bits")) for name, b in bits.items()])
    per = counted.groupBy(F.col("_set").cast("long").alias("_set")).agg(F.sum(F.col("_n") - 1).alias("n"))
    names = df.sparkSession.range(1).select(F.explode(told).alias("t")).select("t.*")
    return names.join(per, F.col("bits") == F.col("_set"), "left").select("key_set", F.coalesce("n", F.lit(0)).cast("long").alias("n_duplicates"))


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n_duplicates``: rows beyond the first of each key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def run_checks(df: DataFrame, checks: Sequence[tuple[str, str]], keys: Sequence[str] = (), codelists: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``variable, check, status (PASS, FAIL, MANUAL), details`` for ``(variable, check)`` pairs. An action.

    ``not_all_na``, ``non_negative`` and ``flag_rate`` of all variables are one aggregate; the values of all variables with a
    codelist are another, by one expansion, joined to one table of all codelists; key uniqueness is a third. So any number
    of checks is three jobs at most. A column that is absent fails these three; a check that does not apply to the column
    is MANUAL.
    """
    spark, kinds = df.sparkSession, dict(df.dtypes)
    wanted, results, listed = {}, {}, {}
    for variable, check in checks:
        k = f"{variable}:{check}"
        if check == "not_all_na":
            if variable not in kinds:
                results[variable, check] = ("FAIL", "column is absent")
            else:
                wanted[k] = F.count(F.col(variable))
        elif check == "non_negative":
            if variable not in kinds:
                results[variable, check] = ("FAIL", "column is absent")
            elif kinds[variable] in ("string", "date", "timestamp", "boolean", "binary"):
                results[variable, check] = ("MANUAL", "not a number")
            else:
                wanted[k] = F.count_if(F.col(variable) < 0)
        elif check == "flag_rate":
            if variable not in kinds:
                results[variable, check] = ("FAIL", "column is absent")
            else:
                wanted[k] = F.count_if(F.col(variable).isNotNull() & (F.col(variable).cast("string") != ""))
        elif check == "imputation_flag":
            stem = variable.removesuffix("DTM") if variable.endswith("DTM") else variable.removesuffix("DT")
            results[variable, check] = ("PASS", f"{stem}DTF present") if f"{stem}DTF" in kinds else ("MANUAL", f"{stem}DTF absent")
        elif check == "key_uniqueness":
            present = [c for c in keys if c in kinds]
            n = key_duplicates(df, present).first()[0] if present else None
            results[variable, check] = ("MANUAL", "no key column present") if n is None else ("FAIL" if n else "PASS", f"{n} duplicated key rows")
        elif check == "values_in_ct":
            if variable not in kinds or variable not in (codelists or {}):
                results[variable, check] = ("MANUAL", "compare with the codelist")
            else:
                listed[variable] = codelists[variable]
        else:
            raise ValueError(f"unknown check {check}")
    if listed:
        outside = codelists_violations(df, listed).groupBy("variable").agg(F.sum("n_rows").alias("n")).collect()  # a row per variable
        n_of = {r["variable"]: r["n"] for r in outside}
        results |= {(v, "values_in_ct"): ("FAIL" if n_of.get(v) else "PASS", f"{n_of.get(v, 0)} values outside the codelist") for v in listed}
    if wanted:
        row = df.agg(*[v.alias(f"c{i}") for i, v in enumerate(wanted.values())]).first()
        for k, n in zip(wanted, row, strict=True):
            variable, check = k.rsplit(":", 1)
            bad = n > 0 if check == "non_negative" else n == 0
            results[variable, check] = ("FAIL" if bad else "PASS", f"{n} rows")
    return spark.createDataFrame([(v, c, *results[v, c]) for v, c in checks], RESULT)


def check_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n_checks"))


def _digest(df: DataFrame, kind: str) -> Column:
    """A number from all columns of a row: Spark's own hash, or 60 bits of the MD5 of the columns as text, which other
    engines can compute."""
    if kind == "xxhash64":
        return F.xxhash64(*df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def table_snapshot(df: DataFrame, source: str, digest: str = "xxhash64") -> DataFrame:
    """One row: ``source, n_rows, n_columns, columns, digest_sum, digest_xor``. The digest does not depend on row order."""
    h = _digest(df, digest)
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("digest_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest_xor"))
    return row.select(F.lit(source).alias("source"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("columns"), "digest_sum", "digest_xor")


def snapshot_rollup(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n_rows").alias("n_rows"), F.bit_xor(F.xxhash64("source", "digest_sum", "digest_xor")).alias("digest"))


def snapshot_tree(df: DataFrame, source: str, key: str, width: int, *, fanout: int = 16, levels: int = 4, digest: str = "xxhash64") -> DataFrame:
    """``source, level, range, n_rows, digest_sum, digest_xor``: a snapshot of ``df`` by ranges of a whole-number key.

    Ranges of level 0 have ``width`` keys, those of a level above ``fanout`` times as many; a NULL key is in the NULL range. The
    borders do not depend on the data, so snapshots of different days compare. Rows are digested once, into the ranges of
    level 0; the others are summed from these."""
    h = _digest(df, digest)
    at = F.floor(F.col(key) / width).cast("long")
    leaves = df.groupBy(at.alias("range")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("digest_sum"), F.bit_xor(h).alias("digest_xor"))
    above = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("range") / fanout**k).cast("long").alias("range")) for k in range(levels)])
    each = leaves.select("n_rows", "digest_sum", "digest_xor", F.explode(above).alias("r")).select("r.*", "n_rows", "digest_sum", "digest_xor")
    summed = each.groupBy("level", "range").agg(F.sum("n_rows").alias("n_rows"), F.sum("digest_sum").cast("decimal(38,0)").alias("digest_sum"), F.bit_xor("digest_xor").alias("digest_xor"))
    return summed.select(F.lit(source).alias("source"), "level", "range", "n_rows", "digest_sum", "digest_xor")


def changed_ranges(before: DataFrame, after: DataFrame, *, fanout: int = 16) -> DataFrame:
    """The ranges of level 0 in which two snapshot trees differ, found from the top: below a range that agrees nothing is
    looked at. An action for each level."""
    levels = before.agg(F.max("level")).first()[0]
    if levels is None:
        levels = after.agg(F.max("level")).first()[0] or 0
    values = ("n_rows", "digest_sum", "digest_xor")
    parents = None
    for level in range(levels, -1, -1):
        one, two = (t.where(F.col("level") == level).select("range", *values) for t in (before, after))
        if parents is not None:
            below = F.floor(F.col("range") / fanout).cast("long")
            one, two = (t.withColumn("parent", below).join(F.broadcast(parents), F.col("parent").eqNullSafe(F.col("changed")), "left_semi").drop("parent") for t in (one, two))
        two = two.withColumnsRenamed({c: f"_{c}" for c in ("range", *values)})
        joined = one.join(two, F.col("range").eqNullSafe(F.col("_range")), "full")
        same = F.lit(True)
        for c in values:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        found = [(r[0],) for r in joined.where(~same).select(F.coalesce("range", "_range")).collect()]  # a level of what has changed
        parents = before.sparkSession.createDataFrame(found, "changed long")
        if not found:
            break
    return parents.select(F.col("changed").alias("range"))


#: Runs of neighbouring ranges that are read by a predicate on the key; more are joined.
READ_RUNS = 500


def changed_rows(before: DataFrame, after: DataFrame, ranges: DataFrame, key: str, width: int) -> DataFrame:
    """``<key>, change, n_before, n_after``: keys whose rows differ, within the ``ranges`` that differ.

    Runs of such ranges become a predicate on the key, which reaches the scan, so nothing else of the tables is read. Rows
    are compared as multisets by counting them on both sides: repeated keys and rows multiply nothing."""
    found = sorted((r["range"] for r in ranges.where("range IS NOT NULL").distinct().collect()))  # as many as have changed
    runs: list[list[int]] = []
    for r in found:
        if runs and r == runs[-1][1]:
            runs[-1][1] = r + 1
        else:
            runs.append([r, r + 1])
    nulls = ranges.where("range IS NULL").limit(1).count() > 0
    if len(runs) <= READ_RUNS:
        wanted = F.col(key).isNull() if nulls else F.lit(False)
        for low, high in runs:
            wanted = wanted | ((F.col(key) >= low * width) & (F.col(key) < high * width))
        one, two = before.where(wanted), after.where(wanted)
    else:
        at = F.floor(F.col(key) / width).cast("long")
        one, two = (t.join(F.broadcast(ranges.distinct()) if len(found) < 100_000 else ranges.distinct(), at.eqNullSafe(F.col("range")), "left_semi") for t in (before, after))
    columns = before.columns
    both = one.select(*columns, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(two.select(*columns, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    differ = both.groupBy(*columns).agg(F.sum("_b").alias("_b"), F.sum("_a").alias("_a")).where("_a <> _b")
    per = differ.groupBy(key).agg(F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("n_before"), F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("n_after"))
    change = F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed").otherwise("changed")
    return per.select(key, change.alias("change"), "n_before", "n_after")

"""The operators on the small tables that fix their behaviour."""

import contextlib
import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from derivespark.operators import agree, analysis, checks, compare, dates, finalize, joins, project, records, windows
from derivespark.sources.dataset_json import dataset_json_meta, dataset_ndjson_meta, read_dataset_json, read_dataset_ndjson, write_dataset_ndjson


@contextlib.contextmanager
def settings(spark, wanted):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_conditional(spark):
    df = spark.createDataFrame([("Pbo",), ("",), ("Xan_Lo",), (None,)], "ARMCD string")
    assert column(project.assign_conditional(df, "FL", "ARMCD != ''", "Y", "N"), "FL") == ["Y", "N", "Y", "N"]
    ages = spark.createDataFrame([(17,), (30,), (None,)], "AGE int")
    assert column(project.assign_conditional(ages, "ADULT", "AGE >= 18", "yes"), "ADULT") == [None, "yes", None]
    with pytest.raises(ValueError):
        project.assign_conditional(ages, "AGE", "AGE >= 18", "yes")


def test_categorize_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 18.0, 65.0, 200.0, 201.0, None, float("nan"))], "AGE double")
    labels = ["<18", "18-64", ">=65"]
    right = column(project.categorize(df, "G", "AGE", [0, 18, 65, 200], labels), "G")
    left = column(project.categorize(df, "G", "AGE", [0, 18, 65, 200], labels, right=False), "G")
    assert right == [None, "<18", "<18", "18-64", ">=65", None, None, None]
    assert left == [None, "<18", "18-64", ">=65", ">=65", None, None, None]
    open_edges = project.categorize(df, "G", "AGE", [0, 18, 65, 200], labels, right=False, include_lowest=False)
    assert column(open_edges, "G")[4] is None
    for breaks in ([0], [0, 0], [1, 0]):
        with pytest.raises(ValueError):
            project.categorize(df, "G", "AGE", breaks, ["x"] * (len(breaks) - 1))


def test_codelist(spark):
    df = spark.createDataFrame([("WHITE",), ("ASIAN",), ("BLACK",), ("ASIAN",), (None,)], "RACE string")
    codes = project.codelist_from_data(df, "RACE")
    assert sorted(map(tuple, codes.collect())) == [(1, "ASIAN"), (2, "BLACK"), (3, "WHITE")]
    assert column(project.codelist_var(df, "RACEN", "RACE", codes), "RACEN") == [3, 1, 2, 1, None]
    with pytest.raises(PySparkException):
        project.codelist_var(df, "RACEN", "RACE", codes.union(codes)).collect()


@pytest.mark.parametrize(
    ("dtc", "highest", "how", "date", "flag"),
    [
        ("2020-02", "D", "first", dt.date(2020, 2, 1), "D"),
        ("2020-02", "M", "first", dt.date(2020, 2, 1), "D"),
        ("2020-02", "Y", "last", dt.date(2020, 2, 29), "D"),
        ("2020", "M", "last", dt.date(2020, 12, 31), "M"),
        ("2020", "D", "first", None, None),
        ("2020-02-30", "Y", "first", None, None),
        ("2020---15", "M", "first", dt.date(2020, 1, 1), "M"),
        ("2020-03-05T10", "D", "first", dt.date(2020, 3, 5), None),
        ("-", "Y", "first", None, None),
        ("", "Y", "first", None, None),
        ("2020-03-05x", "Y", "first", None, None),
        (None, "Y", "first", None, None),
    ],
)
def test_impute_date(spark, dtc, highest, how, date, flag):
    df = spark.createDataFrame([(dtc, "KEEP")], "DTC string, XTMF string")
    row = dates.impute_dtc(df, "XDT", "DTC", highest_imputation=highest, date_imputation=how).first()
    assert (row.XDT, row.XDTF, row.XTMF) == (date, flag, "KEEP")


def test_impute_datetime(spark):
    df = spark.createDataFrame([("2020-03-05T10",), ("2020-03-05",), ("2020-03-05T10:11:12",)], "DTC string")
    out = dates.impute_dtc(df, "XDTM", "DTC", output="dtm", time_imputation="last")
    got = [(str(r.XDTM), r.XDTF, r.XTMF) for r in out.collect()]
    assert got == [("2020-03-05 10:59:59", None, "M"), ("2020-03-05 23:59:59", None, "H"), ("2020-03-05 10:11:12", None, None)]
    for bad in ({"target": "X"}, {"target": "XDTM", "output": "dt"}, {"target": "XDT", "time_imputation": "first"}):
        with pytest.raises(ValueError):
            dates.impute_dtc(df, **({"dtc": "DTC"} | bad))


def test_duration_and_study_day(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2000, 2, 29), d(2023, 2, 28)), (d(2000, 2, 29), d(2023, 3, 1)), (d(2020, 1, 2), d(2020, 1, 1)), (None, d(2020, 1, 1))], "A date, B date")
    assert column(dates.duration(df, "Y", "A", "B", "years"), "Y") == [22.0, 23.0, 0.0, None]
    assert column(dates.duration(df, "D", "A", "B", add_one=True), "D")[2] == -1.0
    assert column(dates.study_day(df, "DY", "B", "A"), "DY")[2:] == [-1, None]
    assert column(dates.study_day(df, "DY", "A", "A"), "DY")[0] == 1
    with pytest.raises(ValueError):
        dates.date_shift(df, "C", "A", 1.5)


def test_merges(spark):
    base = spark.createDataFrame([("S1",), ("S2",), (None,)], "ID string")
    add = spark.createDataFrame([("S1", 2, "b"), ("S1", 1, "a"), ("S1", None, "z"), (None, 1, "n")], "ID string, N int, V string")
    merged = joins.merge_var(base, add, "X", "V", ["ID"], "first", ["N"])
    assert sorted(map(str, column(merged, "X"))) == ["None", "None", "a"]
    assert "z" in column(joins.merge_var(base, add, "X", "V", ["ID"], "last", ["N"]), "X")
    assert "n" in column(joins.merge_var(base, add, "X", "V", ["ID"], "first", ["N"], null_keys_match=True), "X")
    with pytest.raises(PySparkException):
        joins.merge_var(base, add, "X", "V", ["ID"]).collect()
    with pytest.raises(PySparkException):
        joins.lookup_join(base, add, "X", "V", ["ID"]).collect()
    flagged = spark.createDataFrame([("S1", 1.0, "Y"), ("S1", 2.0, "Y")], "ID string, AVAL double, ABLFL string")
    with pytest.raises(PySparkException):
        joins.derive_base(flagged, ["ID"]).collect()
    with pytest.raises(ValueError):
        joins.merge_var(base, add, "X", "v", ["ID"])


def test_parameters(spark):
    rows = [("S1", 1, "WEIGHT", 80.0), ("S1", 0, "HEIGHT", 200.0), ("S2", 1, "WEIGHT", 70.0)]
    df = spark.createDataFrame(rows, "ID string, V int, PARAMCD string, AVAL double")
    how = {"paramcd": "BMI", "param": "Index", "parameters": ["WEIGHT"], "value": "WEIGHT / pow(HEIGHT / 100, 2)", "by": ["ID", "V"], "constant_parameters": ["HEIGHT"], "constant_by": ["ID"]}
    out = records.compute_param(df, **how)
    made = out.filter("PARAMCD = 'BMI'").collect()
    assert [(r.ID, r.V, r.AVAL, r.PARAM) for r in made] == [("S1", 1, 20.0, "Index")]
    assert records.compute_param(out, **how).count() == out.count() == 4
    with pytest.raises(PySparkException):
        records.compute_param(df.union(df), **how).collect()
    total = records.summary_record(df, "TOT", None, ["ID"], "sum").filter("PARAMCD = 'TOT'")
    assert sorted((r.ID, r.AVAL) for r in total.collect()) == [("S1", 280.0), ("S2", 70.0)]


def test_flags(spark):
    df = spark.createDataFrame([("S1", 1, 5.0), ("S1", 2, 5.0), ("S1", None, 7.0), ("S2", 1, 1.0)], "ID string, N int, X double")
    out = windows.extreme_flag(df, "FL", ["ID"], ["N"], "first", restrict="X < 6")
    assert sorted((r.ID, str(r.N)) for r in out.filter("FL = 'Y'").collect()) == [("S1", "1"), ("S2", "1")]
    assert out.count() == 4
    last = windows.extreme_flag(df, "FL", ["ID"], ["N"], "last").filter("FL = 'Y'")
    assert sorted(str(r.N) for r in last.collect()) == ["1", "None"]
    with pytest.raises(PySparkException):
        windows.extreme_flag(df, "FL", ["ID"], ["X"], "first", on_ties="error").collect()
    seq = windows.obs_number(df, "SEQ", ["ID"], ["N"])
    assert sorted((r.ID, str(r.N), r.SEQ) for r in seq.collect()) == [("S1", "1", 1), ("S1", "2", 2), ("S1", "None", 3), ("S2", "1", 1)]


def test_checks(spark):
    df = spark.createDataFrame([("A", "S1", 64, ""), ("A", "S1", None, ""), ("A", "S2", 45, "Y")], "STUDYID string, USUBJID string, AGE int, ABLFL string")
    wanted = [("AGE", "not_all_na"), ("AGE", "non_negative"), ("ABLFL", "flag_rate"), ("USUBJID", "key_uniqueness"), ("ABLFL", "values_in_ct"), ("ASTDT", "imputation_flag")]
    got = {(r.variable, r.check): (r.status, r.details) for r in checks.run_checks(df, wanted, ["USUBJID"]).collect()}
    assert got["AGE", "not_all_na"][0] == got["AGE", "non_negative"][0] == got["ABLFL", "flag_rate"][0] == "PASS"
    assert got["USUBJID", "key_uniqueness"] == ("FAIL", "1 duplicated key rows")
    assert got["ABLFL", "values_in_ct"][0] == got["ASTDT", "imputation_flag"][0] == "MANUAL"
    assert checks.run_checks(df, [("X", "key_uniqueness")], ["NOPE"]).first().status == "MANUAL"
    unset = df.withColumn("ABLFL", F.lit(""))
    assert checks.run_checks(unset, [("ABLFL", "flag_rate")]).first().status == "FAIL"


def test_analysis(spark):
    assert [m["operation"] for m in analysis.method_spec(["sd", "n", "mean"])] == ["n", "mean", "sd"]
    assert [m["pattern"] for m in analysis.method_spec(["sd", "n", "mean"])] == ["XX", "XX.X", "XX.XX"]
    for bad in (["n", "n"], ["nope"]):
        with pytest.raises(ValueError):
            analysis.method_spec(bad)
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), (None, 4.0)], "G string, X double")
    rows = analysis.analysis(df, "T", "A1", "X", ["n", "sd", "mean"], ["G"]).collect()
    shown = {(r.G, r.operation): r.display for r in rows}
    assert shown["A", "mean"] == "1.5" and shown["A", "sd"] == "0.71" and shown[None, "sd"] is None and shown[None, "n"] == "1"


def test_compare(spark):
    ours = spark.createDataFrame([("S1", 1.04, None, dt.date(1960, 1, 2)), ("S2", 2.0, "x", None)], "ID string, A double, B string, CDT date")
    oracle = spark.createDataFrame([("S1", 1.0, None, 1.0), ("S3", 2.0, "x", None)], "ID string, A double, B string, CDT double")
    got = {r.variable: r for r in compare.compare_datasets(ours, oracle, ["ID", "A", "B", "CDT", "Z"], ["ID"], "ID", round_digits={"A": 1}).collect()}
    assert (got["ID"].status, got["ID"].value_agree) == ("id", 50.0)
    assert (got["A"].value_agree, got["A"].value_agree_rounded) == (0.0, 100.0)
    assert got["B"].status == "all_missing" and got["Z"].status == "not_produced"
    assert (got["CDT"].status, got["CDT"].value_agree) == ("compared", 100.0)
    loose = compare.compare_datasets(ours, oracle, ["A"], ["ID"], "ID", tolerance={"A": 0.5}).first()
    assert loose.value_agree == 100.0


def test_agreement(spark):
    votes = [(1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (2, 1, "a"), (2, 2, "b"), (2, 3, "b"), (3, 1, "a"), (3, 2, "b"), (3, 3, "c"), (4, 1, None)]
    df = spark.createDataFrame(votes, "item int, voter int, label string")
    got = {r["item"]: (r.votes, r.label, r.unanimous, r.needs_review) for r in agree.consensus_vote(df, "item", "voter", "label").collect()}
    assert got == {1: ("a:3", "a", True, False), 2: ("a:1; b:2", "b", False, False), 3: ("a:1; b:1; c:1", None, False, True), 4: ("", None, False, True)}
    first = {r["item"]: r.label for r in agree.consensus_vote(df, "item", "voter", "label", "first").collect()}
    assert first == {1: "a", 2: "a", 3: "a", 4: None}
    assert agree.accept({"x": 0.9}, {"x": 0.8}) == (True, []) and not agree.accept({"x": 0.7}, {"x": 0.8})[0]


def test_conform(spark):
    df = spark.createDataFrame([("1", "x")], "A string, B string")
    out = finalize.conform(df, [{"variable": "A", "type": "integer", "label": "Number"}])
    assert out.columns == ["A"] and out.first().A == 1 and finalize.labels_of(out) == {"A": "Number"}
    with pytest.raises(ValueError):
        finalize.conform(df, [{"variable": "Z"}])


def document(columns, rows, **more):
    return {"datasetJSONVersion": "1.1.0", "itemGroupOID": "IG.DM", "name": "DM", "label": "Demographics", "records": len(rows or []), "columns": [{"itemOID": f"IT.{c[0]}", "name": c[0], "label": c[0].title(), "dataType": c[1], **({"targetDataType": c[2]} if len(c) > 2 else {})} for c in columns]} | ({"rows": rows} if rows is not None else {}) | more


def written(tmp_path, doc):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc))
    return str(path)


def test_dataset_json(spark, tmp_path):
    columns = [("STUDYID", "string"), ("AGE", "integer"), ("TRTSDT", "date", "Date"), ("ADTM", "datetime", "Datetime")]
    rows = [["A", 1, "2014-01-02", "2024-01-01T12:30:00+02:00"], ["", None, None, "2014-01-02T11:45"], [None, "NA", "2014-01-03", None]]
    path = written(tmp_path, document(columns, rows))
    got = read_dataset_json(spark, path).collect()
    assert [(r.STUDYID, r.AGE, r.TRTSDT, r.ADTM) for r in got] == [("A", 1.0, dt.date(2014, 1, 2), dt.datetime(2024, 1, 1, 10, 30)), ("", None, None, dt.datetime(2014, 1, 2, 11, 45)), (None, None, dt.date(2014, 1, 3), None)]
    headers, cols = dataset_json_meta(spark, path)
    assert (headers.first()["name"], headers.first()["records"], cols.count()) == ("DM", 3, 4)


def test_dataset_json_partial_dates_stay_text(spark, tmp_path):
    path = written(tmp_path, document([("D", "date", "Date")], [["2010-04-30"], ["2010-04"], [None]]))
    assert column(read_dataset_json(spark, path), "D") == ["2010-04-30", "2010-04", None]


@pytest.mark.parametrize(("kind", "cell"), [("float", "not a number"), ("float", [1, 2]), ("float", True), ("integer", 1.5), ("boolean", "yes")])
def test_dataset_json_bad_cells(spark, tmp_path, kind, cell):
    path = written(tmp_path, document([("A", kind)], [[cell]]))
    with pytest.raises(PySparkException):
        read_dataset_json(spark, path).collect()


def test_dataset_json_without_rows(spark, tmp_path):
    columns = [("A", "integer")]
    assert read_dataset_json(spark, written(tmp_path, document(columns, None, records=0))).count() == 0
    with pytest.raises(ValueError):
        read_dataset_json(spark, written(tmp_path, document(columns, None, records=3)))
    with pytest.raises(ValueError):
        read_dataset_json(spark, written(tmp_path, document([], [])))
    with pytest.raises(PySparkException):
        read_dataset_json(spark, written(tmp_path, document(columns, [[1, 2]]))).collect()


def test_imputation_parses_once(spark):
    df = spark.createDataFrame([("2024-02",), ("2024-02-30",), ("2024---15T10",), ("x",), (None,), ("2024-02-03T04:05:06.7",)], "ADTC string")
    out = dates.impute_dtc(df, "ADTM", "ADTC", output="dtm", highest_imputation="M", date_imputation="last", time_imputation="last")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_") == 1
    got = [tuple(str(v) if v is not None else None for v in r[1:]) for r in out.collect()]
    assert got == [("2024-02-29 23:59:59", "D", "H"), (None, None, None), ("2024-12-31 23:59:59", "M", "H"), (None, None, None), (None, None, None), ("2024-02-03 04:05:06", None, None)]


def test_absent_columns_fail(spark):
    df = spark.createDataFrame([(1, "x")], "A int, T string")
    got = {(r.variable, r.check): r.status for r in checks.run_checks(df, [("B", "non_negative"), ("B", "flag_rate"), ("T", "non_negative"), ("A", "non_negative")]).collect()}
    assert got == {("B", "non_negative"): "FAIL", ("B", "flag_rate"): "FAIL", ("T", "non_negative"): "MANUAL", ("A", "non_negative"): "PASS"}


def test_compare_numbers_as_text_and_missing_values(spark):
    ours = spark.createDataFrame([(1, 1.0, None), (2, 2.5, "b"), (3, None, None)], "K int, V double, T string")
    oracle = spark.createDataFrame([(1, "1", None), (2, "x", "b"), (3, None, "c")], "K int, V string, T string")
    got = {r.variable: (r.value_agree, r.na_agree) for r in compare.compare_datasets(ours, oracle, ["V", "T"], ["K"], "ID").collect()}
    assert got == {"V": (33.3, 100.0), "T": (33.3, 66.7)}


@pytest.mark.parametrize("value, whole", [("2020-01-01 10:30:00", True), ("2020-01-01T10:30+05:30", True), ("2020-01-01T10:30:00+0530", False), ("2020-01-01T10:30:00+15:30", False), ("2020-01-01T10:30:00+14:00", True), ("2020-01-01T24:00:00", False), ("2020-02-30T10:00:00", False)])
def test_dataset_json_datetimes(spark, tmp_path, value, whole):
    got = read_dataset_json(spark, written(tmp_path, document([("D", "datetime", "Datetime")], [[value], [""], [None]])))
    assert ("D__raw" in got.columns) == whole and (got.where("D IS NULL").count() == 2 or not whole)


def test_dataset_json_empty_date_is_missing(spark, tmp_path):
    assert column(read_dataset_json(spark, written(tmp_path, document([("D", "date", "Date")], [["2010-04-30"], [""]]))), "D") == [dt.date(2010, 4, 30), None]


def test_dataset_ndjson(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted",\n[line]', dt.date(2020, 1, 2), True), (2, None, None, None)], "N int, T string, D date, B boolean")
    kinds = [{"name": "N", "dataType": "integer"}, {"name": "T", "dataType": "string"}, {"name": "D", "dataType": "date", "targetDataType": "Date"}, {"name": "B", "dataType": "boolean"}]
    path = f"file://{tmp_path}/nd"
    write_dataset_ndjson(df, path, "X", kinds, records=2)
    got = sorted(tuple(r) for r in read_dataset_ndjson(spark, path).drop("D__raw").collect())
    assert got == [(1.0, 'a "quoted",\n[line]', dt.date(2020, 1, 2), True), (2.0, None, None, None)]
    header, columns = dataset_ndjson_meta(spark, path)
    assert (header.first().records, [r["name"] for r in columns.orderBy("position").collect()]) == (2, ["N", "T", "D", "B"])


def test_snapshot_digests(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "A int, B string")
    for kind in ("xxhash64", "md5"):
        one, other = (checks.table_snapshot(d, "t", kind).first() for d in (df, df.orderBy("A", ascending=False).repartition(3)))
        assert one == other and one.n_rows == 2
        assert checks.table_snapshot(df.withColumn("B", F.coalesce("B", F.lit(""))), "t", kind).first().digest_sum != one.digest_sum


def test_codelists_are_bounded(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("V"))
    assert project.codelist_from_data(df, "V", max_codes=20).count() == 20
    with pytest.raises(PySparkException):
        project.codelist_from_data(df, "V", max_codes=19).collect()


def test_sketched_quantiles(spark):
    df = spark.range(10_001).select((F.col("id") % 2).alias("G"), F.col("id").cast("double").alias("V"))
    for r in analysis.analysis(df, "T", "A", "V", ["median", "q1", "q3"], ["G"], accuracy=1000).collect():
        assert abs(r["value"] - {"median": 5000, "q1": 2500, "q3": 7500}[r.operation]) <= 20


@pytest.mark.parametrize("limit", [500_000, 50])
def test_exact_quantiles_of_any_group(spark, monkeypatch, limit, capsys):
    import numpy as np

    monkeypatch.setattr(analysis, "SORTED_ROWS", limit)
    rng = np.random.default_rng(8)
    groups = {"a": np.exp(10 * rng.normal(size=3000)), "b": np.round(rng.normal(size=2001)), "c": np.full(500, 7.0), "d": np.array([1.0]), "e": np.array([1.0, np.inf]), None: np.array([3.0, 1.0, 2.0, 10.0]), "big": rng.permutation(1_000_000) * 0.5 if limit > 50 else rng.permutation(20_000) * 0.5}
    import pandas as pd

    rows = pd.concat([pd.DataFrame({"g": pd.Series([g] * len(x), dtype=object), "x": x}) for g, x in groups.items()] + [pd.DataFrame({"g": ["none"], "x": [None]})])
    df = spark.createDataFrame(rows, "g string, x double").replace(float("nan"), None, "x")
    out = analysis.analysis(df, "T", "A", "x", ["n", "median", "q1", "q3"], ["g"])
    out.explain()
    assert "percentile" not in capsys.readouterr().out
    got = {(r.g, r.operation): r.value for r in out.collect()}
    for g, x in groups.items():
        for op, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            want = np.quantile(x, p)
            assert got[g, op] == pytest.approx(want, rel=1e-12) or (g == "e" and np.isinf(got[g, op])), (g, op)
        assert got[g, "n"] == len(x)
    assert [got["none", op] for op in ("n", "q1", "median", "q3")] == [0.0, None, None, None]
    alone = analysis.analysis(df.where("g = 'a'"), "T", "A", "x", ["median"])
    assert alone.first().value == pytest.approx(np.median(groups["a"]))


def test_flags_and_numbers_of_large_groups(spark):
    """As the window forms, on groups with NULL keys, ties and equal rows; no task holds a large group."""
    rows = [(g, i % 7 if i % 5 else None, i) for g, n in (("big", 4000), (None, 30), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(40)
    known = lambda d, c: {(r.g, r.id): r[c] for r in d.collect()}
    for mode in ("first", "last"):
        for restrict in (None, "id % 2 = 1"):
            pair = [windows.extreme_flag(df, "FL", ["g"], ["o", "id"], mode, restrict=restrict, large_groups=large) for large in (False, True)]
            assert known(pair[0], "FL") == known(pair[1], "FL")
    for ranges in (1, 30):
        got = windows.obs_number(df, "N", ["g"], ["o"], large_groups=True, ranges=ranges)
        assert known(got, "N") == known(windows.obs_number(df, "N", ["g"], ["o"]), "N") and got.columns == ["g", "o", "id", "N"]
    assert known(windows.max_value_flag(df, "FL", ["g"], "o", large_groups=True), "FL") == known(windows.max_value_flag(df, "FL", ["g"], "o"), "FL")
    for visit in (6, 99):
        pair = [windows.last_or_visit_flag(df, "FL", ["g"], ["o", "id"], "o", visit, large_groups=large) for large in (False, True)]
        assert known(pair[0], "FL") == known(pair[1], "FL")
    with pytest.raises(PySparkException, match="several extreme"):
        windows.extreme_flag(df, "FL", ["g"], ["o"], on_ties="error", large_groups=True).collect()
    windows.extreme_flag(df.where("g = 'one'"), "FL", ["g"], ["o"], on_ties="error", large_groups=True).collect()
    same = spark.createDataFrame([("a", 1)] * 3, "g string, o int")
    assert sorted(column(windows.obs_number(same, "N", ["g"], ["o"], large_groups=True), "N")) == [1, 2, 3]
    fine = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "134217728"}
    with settings(spark, fine):
        placed = windows.obs_number(df.where("g = 'big'"), "N", ["g"], ["o"], large_groups=True, ranges=400)
        placed = windows.extreme_flag(placed, "FL", ["g"], ["o", "id"], large_groups=True)
        assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 0.05 * 4000


def test_checks_in_one_pass(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), (None, "y", 2), ("b", None, None)], "p string, q string, n int")
    codes = lambda *x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "code long, decode string")
    lists = {"p": codes("a"), "q": codes("x", "y"), "n": codes("1")}
    got = {(r.variable, r.value): r.n_rows for r in checks.codelists_violations(df, lists).collect()}
    assert got == {("p", "b"): 2, ("n", "2"): 1}
    told = {r.variable: (r.status, r.details) for r in checks.run_checks(df, [(v, "values_in_ct") for v in lists], codelists=lists).collect()}
    assert told == {"p": ("FAIL", "2 values outside the codelist"), "q": ("PASS", "0 values outside the codelist"), "n": ("FAIL", "1 values outside the codelist")}
    sets = {"p": ["p"], "pq": ["p", "q"], "all": ["p", "q", "n"]}
    assert {r.key_set: r.n_duplicates for r in checks.key_sets_duplicates(df, sets).collect()} == {"p": 1, "pq": 0, "all": 0}
    assert {r.n_duplicates for r in checks.key_sets_duplicates(df.limit(0), sets).collect()} == {0}


def test_repeated_keys_are_matched(spark):
    ours = spark.createDataFrame([(1, 1.0, "a")] * 3 + [(1, 2.0, "b"), (2, 5.0, None), (2, 5.0, None), (3, 1.0, "x"), (None, 9.0, "n")], "k int, v double, t string")
    oracle = spark.createDataFrame([(1, "1", "a")] * 2 + [(1, "7", "b"), (1, "8", "c"), (2, "5", None), (4, "1", "y")], "k int, v string, t string")
    got = sorted((str(r.k0), r.kind, r.a0, r.b0, r.a1, r.b1, r.n) for r in compare.match_records(ours, oracle, ["v", "t"], ["k"]).collect())
    assert {g[:2] + (g[6],) for g in got} == {("1", "equal", 2), ("1", "paired", 1), ("2", "equal", 1), ("2", "ours", 1), ("3", "ours", 1), ("4", "oracle", 1), ("None", "ours", 1)} and len(got) == 8
    many = spark.createDataFrame([(1, i) for i in range(2000)], "k int, v int")
    told = {r.kind: (r.n_pairs, r.n_keys) for r in compare.match_summary(compare.match_records(many, many, ["v"], ["k"])).collect()}
    assert told == {"equal": (2000, 1)}
    acc = compare.compare_datasets(many, many, ["v"], ["k"], "k", repeated="match").first()
    assert (acc.n_joined, acc.value_agree) == (2000, 100.0)


def test_matched_records_are_dealt_out(spark):
    """As matched in plain Python, with NULLs, copies and keys stored as text; no task gets most of the pairs."""
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    side = lambda n, key: [(key(int(rng.integers(40))), None if rng.random() < 0.1 else float(rng.integers(4)), "xyz"[rng.integers(3)] if rng.random() < 0.9 else None) for _ in range(n)]
    left = side(900, lambda i: i or None) + [(7, 1.0, "x")] * 25_000
    right = side(1200, lambda i: str(i) if i else None) + [("7", 1.0, "x")] * 15_000
    expected = Counter()
    for key in range(1, 40):
        ours, oracle = Counter(r[1:] for r in left if r[0] == key), Counter(r[1:] for r in right if r[0] == str(key))
        expected.update({("equal", key, r, r): n for r, n in (ours & oracle).items()})
        a, b = (sorted(x.elements(), key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r)) for x in (ours - oracle, oracle - ours))
        for i in range(max(len(a), len(b))):
            mine, theirs = a[i] if i < len(a) else (None, None), b[i] if i < len(b) else (None, None)
            expected["paired" if i < min(len(a), len(b)) else "ours" if i < len(a) else "oracle", key, mine, theirs] += 1
    expected.update(("ours", None, r[1:], (None, None)) for r in left if r[0] is None)
    expected.update(("oracle", None, (None, None), r[1:]) for r in right if r[0] is None)
    frames = spark.createDataFrame(left, "k int, v double, t string"), spark.createDataFrame(right, "k string, v double, t string")
    for tasks in (1, 5):
        got = Counter()
        for r in compare.match_records(*frames, ["v", "t"], ["k"], tasks=tasks).collect():
            got[r.kind, None if r.k0 is None else int(r.k0), (r.a0, r.a1), (r.b0, r.b1)] += r.n
        assert got == expected
    kinds = Counter(x[0] for x in expected for _ in range(expected[x]))
    assert {r.kind: (r.n_pairs, r.n_keys) for r in compare.match_summary(compare.match_records(*frames, ["v", "t"], ["k"])).collect()} == {kind: (n, len({x[1] for x in expected if x[0] == kind})) for kind, n in kinds.items()}
    many = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    with settings(spark, {"spark.sql.shuffle.partitions": "16"}):
        found = compare.match_records(many, many.withColumn("v", F.lit(2)), ["v"], ["k"])
        assert found.groupBy(F.spark_partition_id()).agg(F.count("k0").alias("n")).agg(F.max("n"), F.sum("n")).first()[:] == (pytest.approx(250, abs=150), 4000)


def test_snapshot_trees_find_what_changed(spark, tmp_path, capsys):
    rows = [(i, f"v{i}") for i in range(0, 20_000, 2)] + [(None, "n"), (4, "twice"), (4, "twice")]
    path = f"file://{tmp_path}/a"
    spark.createDataFrame(rows, "id long, v string").repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(path)
    before = spark.read.parquet(path)
    trees = lambda a, b: (checks.snapshot_tree(x, "t", "id", 100, fanout=4) for x in (a, b))
    assert checks.changed_ranges(*trees(before, before), fanout=4).collect() == []
    changed = [r for r in rows if r[0] != 150 and r != (None, "n")] + [(151, "new"), (-7, "below"), (None, "m")]
    changed.remove((4, "twice"))
    after = spark.createDataFrame([(i, "other" if i == 9000 else v) for i, v in changed], "id long, v string")
    ranges = checks.changed_ranges(*trees(before, after), fanout=4)
    assert sorted(column(ranges, "range"), key=str) == sorted([0, 1, 90, -1, None], key=str)
    out = checks.changed_rows(before, after, ranges, "id", 100)
    want = {150: ("removed", 1, 0), 151: ("added", 0, 1), -7: ("added", 0, 1), 9000: ("changed", 1, 1), 4: ("removed", 1, 0), None: ("changed", 1, 1)}
    assert {r.id: (r.change, r.n_before, r.n_after) for r in out.collect()} == want
    with settings(spark, {"spark.sql.maxMetadataStringLength": "10000"}):
        checks.changed_rows(before, after, ranges, "id", 100).explain()
    assert "GreaterThanOrEqual(id,9000)" in capsys.readouterr().out  # the predicate reaches the scan
    whole = checks.changed_rows(before, spark.createDataFrame([], "id long, v string"), checks.changed_ranges(*trees(before, after.limit(0)), fanout=4), "id", 100)
    assert whole.count() == before.select("id").distinct().count()


def test_merges_of_one_source_are_one_join(spark, capsys):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", None), (None, 2)], "id string, d int")
    add = spark.createDataFrame([("a", 2, 5.0), ("a", 4, 1.0), ("b", 2, None), ("b", None, 7.0), ("x", 1, 1.0), (None, 1, 1.0)], "id string, t int, v double")
    how = [
        joins.Pick({"FIRST": "v", "AT": "t"}, ["t"], "first", "t > 0"), joins.Pick({"LAST": "v"}, ["t"], "last"), joins.Pick({"ONE": "v"}, None, "first", "t = 4"),
        joins.Exists("ANY", "v > 4"), joins.Exists("EARLY", "t > 0", ("t", "d")), joins.Summary("SUM", F.sum, "v * 2", "t IS NOT NULL"),
    ]
    got = joins.merge_all(df, add, ["id"], how)
    alone = joins.merge_vars(df, add, {"FIRST": "v", "AT": "t"}, ["id"], "first", ["t"], "t > 0")
    alone = joins.merge_vars(alone, add, {"LAST": "v"}, ["id"], "last", ["t"])
    alone = joins.merge_vars(alone, add, {"ONE": "v"}, ["id"], filter="t = 4")
    alone = joins.exists_flag(alone, add, "ANY", ["id"], "v > 4")
    alone = joins.exists_flag(alone, add, "EARLY", ["id"], "t > 0", at_or_before=("t", "d"))
    alone = records.merge_summary(alone, add, "SUM", ["id"], F.sum(F.col("v") * 2), "t IS NOT NULL")
    names = ["id", "FIRST", "AT", "LAST", "ONE", "ANY", "EARLY", "SUM"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, alone.select(*names).collect()))
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Join") == 1 and plan.count("Scan ExistingRDD") == 2
    with pytest.raises(PySparkException, match="duplicate_records"):
        joins.merge_all(df, add, ["id"], [joins.Pick({"ONE": "v"})]).collect()


def test_pool_groups(spark):
    def pooled(cells, least):
        rows = [(g, a) for (g, a), n in cells.items() for _ in range(n)]
        got = joins.pool_groups(spark.createDataFrame(rows, "site string, arm string"), "P", "site", "arm", least).distinct().collect()
        return {r.site: r.P for r in got}

    full = lambda g, n, m: {(g, "x"): n, (g, "y"): m}
    assert pooled(full("1", 3, 3) | full("2", 5, 4), 3) == {"1": "1", "2": "2"}
    assert pooled(full("1", 2, 2) | full("2", 1, 1) | full("3", 5, 5), 3) == {"1": "900", "2": "900", "3": "3"}
    assert pooled(full("1", 2, 2) | full("3", 5, 5) | full("4", 4, 6) | full("5", 9, 9), 3) == {"1": "900", "3": "900", "4": "4", "5": "5"}  # the pool is short; 3 and 4 tie
    assert pooled({("1", "x"): 9} | full("2", 9, 9), 3) == {"1": "900", "2": "900"}  # a group without an arm
    assert pooled(full("1", 1, 1) | full("2", 1, 2), 3) == {"1": "900", "2": "900"}
    assert pooled({(None, "x"): 2} | full("1", 3, 3), 3) == {None: None, "1": "1"}


def test_one_scan_and_join_of_each_source_of_subjects(spark):
    from derivespark.jobs import registry

    out = registry.QUERIES["l1_build_adsl"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scans = [x for x in plan if "Relation" in x]
    reads = lambda column: sum(f" {column}#" in x or f"[{column}#" in x or f",{column}#" in x for x in scans)
    # customers are subjects, codelist, vitals, history and characteristics; orders doses, disposition and visits; events answers
    assert (reads("c_custkey"), reads("o_orderkey"), reads("event_id")) == (5, 3, 1)
    assert sum("Join LeftOuter" in x for x in plan) == 7 + 2 and len(scans) == 10  # a join a source, the coded race, the pooled site

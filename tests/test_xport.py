"""Transport files: numbers bit by bit, rows by ranges, missing codes, labels."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from derivespark.operators import finalize
from derivespark.sources import xport


def test_numbers():
    known = {1.0: "4110000000000000", -118.625: "C276A00000000000", 0.0: "0000000000000000", 0.5: "4080000000000000", 3.141592653589793: "413243F6A8885A30"}
    for value, code in known.items():
        assert xport.double_to_ibm(np.array([value]))[0].tobytes().hex().upper() == code
    rng = random.Random(2)
    values = [struct.unpack(">d", struct.pack(">Q", rng.getrandbits(64)))[0] for _ in range(4000)]
    values = [v for v in values if 1e-70 < abs(v) < 1e70] + [1e-78, -7.2e75, 2.0**-256, 5e-324]
    back, code = xport.ibm_to_double(xport.double_to_ibm(np.array(values)))
    assert (code == 0).all() and back[:-1].tolist() == values[:-1] and back[-1] == 0.0
    raw = np.array([[46, 0, 0, 0], [65, 0, 0, 0], [90, 0, 0, 0], [95, 0, 0, 0], [65, 16, 0, 0]], dtype=np.uint8)
    value, code = xport.ibm_to_double(raw)
    assert [chr(c) if c else None for c in code] == [".", "A", "Z", "_", None] and value[4] == 1.0
    with pytest.raises(ValueError, match="too large"):
        xport.double_to_ibm(np.array([1e80]))


ROWS = [(1, "a", 0.1, dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3)), (2, "é  x", None, None, None), (-3, "", -1e10, dt.date(1959, 12, 31), dt.datetime(1960, 1, 1)), (4, None, math.pi, dt.date(1900, 1, 1), dt.datetime(2100, 1, 1))]


def test_round_trip_in_ranges(spark, tmp_path):
    df = spark.createDataFrame(ROWS * 50, "ID long, TXT string, X double, D date, T timestamp").repartition(3)
    df = finalize.set_labels(df, {"TXT": "A text"})
    xport.write_xport(df, f"file://{tmp_path}/d", "DS", "A dataset")
    want = sorted(repr((float(i), t or "", x, d, s)) for i, t, x, d, s in ROWS * 50)
    for split in (1, 1000, 10**9):
        got = xport.read_xport(spark, f"file://{tmp_path}/d", split=split)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert got.schema["TXT"].metadata == {"label": "A text"}
    assert xport.read_xport(spark, f"file://{tmp_path}/d", split=200).rdd.getNumPartitions() > 20
    some = xport.read_xport(spark, f"file://{tmp_path}/d", ["X", "ID"], codes=True)
    assert some.columns == ["X", "X__missing", "ID", "ID__missing"]
    assert {(r.X is None, r.X__missing) for r in some.collect()} == {(True, "."), (False, None)}
    head, variables, files, width = xport.xport_meta(spark, f"file://{tmp_path}/d")
    assert head == {"name": "DS", "label": "A dataset"} and [v.name for v in variables] == ["ID", "TXT", "X", "D", "T"] and width == 8 * 4 + 5 and len(files) == 3
    assert all(size % 80 == 0 for _, _, size in files)


def test_blank_rows_and_padding(spark, tmp_path):
    """Rows shorter than a record: blanks at the end are padding, blank rows before are rows."""
    for n in (1, 79, 80, 81, 160):
        path = f"{tmp_path}/n{n}"
        xport.write_xport(spark.createDataFrame([(x,) for x in ["b"] * (n - 1) + ["e"]], "C string").coalesce(1), path, "DS")
        assert [r.C for r in xport.read_xport(spark, path).collect()] == ["b"] * (n - 1) + ["e"]
    path = f"{tmp_path}/blank"
    xport.write_xport(spark.createDataFrame([(" ",)] * 200 + [("e",)], "C string").coalesce(1), path, "DS")
    assert [r.C for r in xport.read_xport(spark, path).collect()] == [""] * 200 + ["e"]
    xport.write_xport(spark.createDataFrame([], "C string, N double"), f"{tmp_path}/none", "DS")
    assert xport.read_xport(spark, f"{tmp_path}/none").collect() == []


def test_what_has_no_place(spark, tmp_path):
    for schema, row in (("LONG_NAME9 string", ("x",)), ("A array<int>", ([1],)), ("A string", ("x" * 201,))):
        with pytest.raises(ValueError):
            xport.write_xport(spark.createDataFrame([row], schema), f"{tmp_path}/x", "DS")
    (tmp_path / "bad.xpt").write_bytes(b"x" * 800)
    with pytest.raises(ValueError, match="no version 5"):
        xport.read_xport(spark, f"{tmp_path}/bad.xpt")
    xport.write_xport(spark.createDataFrame([("x",)], "A string").coalesce(1), f"{tmp_path}/one", "DS")
    with pytest.raises(ValueError, match="missing columns"):
        xport.read_xport(spark, f"{tmp_path}/one", ["B"])
    (file,) = (tmp_path / "one").glob("*.xpt")
    (tmp_path / "two.xpt").write_bytes(file.read_bytes() + file.read_bytes()[240:])
    with pytest.raises(PySparkException, match="several datasets"):
        xport.read_xport(spark, f"{tmp_path}/two.xpt").collect()

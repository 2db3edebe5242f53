"""A JSON document in byte ranges of any size has the rows of the whole."""

import json
import random
import warnings

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from derivespark.sources import json_ranges
from derivespark.sources.dataset_json import dataset_json_meta, read_dataset_json, write_dataset_json

COLUMNS = [{"itemOID": "a", "name": "A", "label": "Text", "dataType": "string"}, {"itemOID": "b", "name": "B", "label": "Number", "dataType": "double"}]


def cells(seed=1, n=300):
    rng = random.Random(seed)
    parts = ['"', "\\", "\\\\", '\\"', "[", "]", "{", "}", ",", "é", "𝄞", "\n", 'x"rows": [', "rows", " ", "plain"]
    return [["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), rng.choice([None, 1, -2.5])] for _ in range(n)]


def document(rows, late=False, old=False, **how):
    head = {"datasetJSONVersion": "1.1.0", "name": "X", "records": len(rows), 'my"rows': [[1]], "columns": COLUMNS}
    if old:
        group = {"name": "X", "items": COLUMNS, "itemData": rows}
        return json.dumps({"datasetJSONVersion": "1.0.0", "clinicalData": {"studyOID": "S", "itemGroupData": {"IG.X": group}}}, **how)
    return json.dumps(({"rows": rows} | head) if late else head | {"rows": rows}, **how)


@pytest.mark.parametrize("how", [{}, {"late": True, "ensure_ascii": False, "indent": 1}, {"old": True, "separators": (",", ":")}])
@pytest.mark.parametrize("split", [97, 1000])
def test_rows_of_ranges(spark, tmp_path, split, how):
    rows = cells(split)
    path = tmp_path / "d.json"
    path.write_text(document(rows, **how), encoding="utf-8")
    rest, texts = json_ranges.document_rows(spark, str(path), split)
    assert [json.loads(r.value) for r in texts.collect()] == rows  # in order of the ranges
    assert '"A"' in rest.decode() and len(rest) < path.stat().st_size
    assert texts.rdd.getNumPartitions() >= (path.stat().st_size - len(rest)) // split
    got = read_dataset_json(spark, str(path), split=split)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((a, None if b is None else float(b))) for a, b in rows)
    headers, columns = dataset_json_meta(spark, str(path), split=split)
    assert headers.first().records == 300 and [r.name for r in columns.collect()] == ["A", "B"]


def test_odd_documents_in_ranges(spark, tmp_path):
    path = tmp_path / "d.json"
    head = json.dumps({"datasetJSONVersion": "1.1.0", "columns": COLUMNS, "pad": "x" * 300})[:-1]
    path.write_text(head + ', "rows": []}')
    assert read_dataset_json(spark, str(path), split=50).count() == 0
    path.write_text(head + "}")
    assert read_dataset_json(spark, str(path), split=50).count() == 0
    path.write_text(head + ', "records": 5}')
    with pytest.raises(ValueError, match="rows are missing"):
        read_dataset_json(spark, str(path), split=50)
    for rows in ('[["a", 1], 7]', '[["a", 1], "t"]', '[["a", 1, 2]]', '[{"A": 1}]'):
        path.write_text(head + f', "rows": {rows}}}')
        with pytest.raises(PySparkException):
            read_dataset_json(spark, str(path), split=50).collect()
    path.write_text(head + ', "rows": [["a", 1], ["b"')
    with pytest.raises(ValueError, match="ends within"):
        read_dataset_json(spark, str(path), split=50)
    path.write_text(head + ', "records": 3, "rows": [["' + "\\\\" * 400 + '", 1]]}')
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        got = read_dataset_json(spark, str(path), split=50).collect()
    assert got[0].A == "\\" * 400 and any("records is 3, rows are 1" in str(w.message) for w in told)


def test_document_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i / 4) for i in range(500)], "A string, B double").repartition(5)
    write_dataset_json(df, f"file://{tmp_path}/d", "X", COLUMNS)
    (file,) = (tmp_path / "d").glob("part-*")
    assert json.loads(file.read_text())["name"] == "X"
    for split in (64, 10**9):
        assert sorted(read_dataset_json(spark, f"file://{file}", split=split).collect()) == sorted(df.collect())


def stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = spark._jvm
    listed = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleReadRecords() for s in (listed.apply(i) for i in range(listed.size()))}


def test_no_task_holds_the_document_that_is_written(spark, tmp_path):
    df = spark.createDataFrame([(f'"é{i}' * (i % 7), i / 4) for i in range(500)], "A string, B double").repartition(5).localCheckpoint()
    before = stages(spark)
    write_dataset_json(df, f"file://{tmp_path}/d e%20#f", "X", COLUMNS)
    new = [n for stage, n in stages(spark).items() if stage not in before]
    assert new and max(new) <= 5  # pieces of files; the rows are not shuffled
    assert [p.name for p in tmp_path.iterdir()] == ["d e%20#f"]  # the lines beside it are gone
    (file,) = (tmp_path / "d e%20#f").glob("part-*")
    assert sorted(map(tuple, json.loads(file.read_text())["rows"])) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="exists already"):
        write_dataset_json(df, f"file://{tmp_path}/d e%20#f", "X", COLUMNS)
    write_dataset_json(df.limit(0), f"file://{tmp_path}/none", "X", COLUMNS)
    (file,) = (tmp_path / "none").glob("part-*")
    assert json.loads(file.read_text())["rows"] == []


@pytest.mark.parametrize("piece", [3, 10, 10**6])
def test_files_are_joined_by_pieces(spark, tmp_path, piece):
    parts = [b",first", b"", b",second part", b",x"]
    (tmp_path / "in").mkdir()
    for i, data in enumerate(parts):
        (tmp_path / f"in/part-{i}").write_bytes(data)
    places = pa.RecordBatch.from_pylist([{"path": f"file://{tmp_path}/in/part-{i}", "start": int(i == 0), "stop": len(data), "place": 0} for i, data in enumerate(parts) if data])
    (told,) = json_ranges._stream(f"file://{tmp_path}/streamed", b"<", b">")(iter([places]))
    json_ranges.joined_file(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out/whole", b"<", b">", skip=1, piece=piece)
    assert (tmp_path / "out/whole").read_bytes() == (tmp_path / "streamed").read_bytes() == b"<" + b"".join(parts)[1:] + b">"
    assert told["done"].to_pylist() == [len(b"".join(parts)) - 1] and not (tmp_path / "in").exists()

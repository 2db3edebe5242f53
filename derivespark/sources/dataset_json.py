"""CDISC Dataset-JSON 1.1 and 1.0, typed strictly by the declared column types."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_ranges import SPLIT_BYTES, document_rows, joined_file, qualified

#: Declared types and how their cells are read.
NUMBERS = ("integer", "float", "double", "decimal")
TEXTS = ("string", "URI", "date", "datetime", "time")
DATE = r"^\d{4}-\d{2}-\d{2}$"
STAMP = r"^\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)?$"
HEADER = ("datasetJSONVersion", "records", "name", "label", "itemGroupOID", "studyOID", "metaDataVersionOID", "originator", "sourceSystem")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per file with its dataset object: the document itself, or its first item group in the older layout."""
    doc = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.parse_json("value").alias("doc"))
    groups = F.coalesce(F.try_variant_get("doc", "$.clinicalData.itemGroupData", "map<string,variant>"), F.try_variant_get("doc", "$.referenceData.itemGroupData", "map<string,variant>"))
    group = F.map_values(groups)[0]
    return doc.withColumn("data", F.coalesce(F.when(F.try_variant_get("doc", "$.columns", "variant").isNotNull(), F.col("doc")), group, F.col("doc")))


def _head(spark: SparkSession, path: str) -> list[dict]:
    """Header of each file, without its rows: small driver-side metadata."""
    docs = _documents(spark, path)
    text = lambda p: F.to_json(F.try_variant_get("data", p, "variant"))
    version = F.try_variant_get("doc", "$.datasetJSONVersion", "string")
    rows = docs.select(
        "path",
        version.alias("version"),
        text("$.columns").alias("columns"),
        text("$.items").alias("items"),
        *[F.coalesce(F.try_variant_get("data", f"$.{h}", "string"), F.try_variant_get("doc", f"$.{h}", "string")).alias(h) for h in HEADER],
        F.size(F.coalesce(F.try_variant_get("data", "$.rows", "array<variant>"), F.try_variant_get("data", "$.itemData", "array<variant>"))).alias("n_rows"),
    ).collect()
    return [r.asDict() for r in rows]


def _columns(head: dict) -> list[dict]:
    if head["version"] is None:
        raise ValueError("no datasetJSONVersion")
    columns = json.loads(head["columns"] or head["items"] or "null")
    if not columns:
        raise ValueError("no columns")
    names = [c.get("name") for c in columns]
    if None in names or len(set(names)) != len(names):
        raise ValueError("column names are missing or repeated")
    for c in columns:
        if c.get("dataType", c.get("type")) not in (*NUMBERS, *TEXTS, "boolean"):
            raise ValueError(f"unknown dataType of {c['name']}")
    return columns


def _split(spark: SparkSession, path: str, split: int) -> tuple[dict, DataFrame | None]:
    """Header and row texts of one document that is read in ranges."""
    rest, rows = document_rows(spark, path, split)
    doc = json.loads(rest)
    groups = (doc.get("clinicalData") or {}).get("itemGroupData") or (doc.get("referenceData") or {}).get("itemGroupData") or {}
    data = doc if doc.get("columns") is not None or not groups else next(iter(groups.values()))
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    head = {"path": path, "version": doc.get("datasetJSONVersion"), "columns": text(data.get("columns")), "items": text(data.get("items"))}
    return head | {h: text(data.get(h, doc.get(h))) for h in HEADER} | {"n_rows": None}, rows


def _large(spark: SparkSession, path: str, split: int) -> bool:
    """Is it one uncompressed file of more than ``split`` bytes?"""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    if any(c in path for c in "*?[{") or name.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(name).isDirectory():
        return False
    return not path.endswith((".gz", ".bz2", ".zst")) and qualified(spark, path)[1] > split


def dataset_json_meta(spark: SparkSession, path: str, *, split: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(headers, columns)``: a row per file, and a row per file and column. An action."""
    if _large(spark, path, split):
        head, texts = _split(spark, path, split)
        heads = [head | {"n_rows": texts.count() if texts is not None and head["records"] is None else 0}]
    else:
        heads = _head(spark, path)
    fields = ", ".join(f"{h} string" for h in HEADER if h != "records")
    headers = spark.createDataFrame(
        [(h["path"], int(float(h["records"])) if h["records"] is not None else max(h["n_rows"] or 0, 0), *[h[k] for k in HEADER if k != "records"]) for h in heads], f"path string, records long, {fields}"
    )
    names = ("itemOID", "name", "label", "dataType", "targetDataType")
    rows = [(h["path"], i, *[c.get(n) for n in names], c.get("length")) for h in heads for i, c in enumerate(_columns(h))]
    return headers, spark.createDataFrame(rows, "path string, position int, itemOID string, name string, label string, dataType string, targetDataType string, length long")


def read_dataset_json(spark: SparkSession, path: str, *, split: int = SPLIT_BYTES) -> DataFrame:
    """The rows of one Dataset-JSON file. An action: it reads the header and tests temporal columns.

    Numbers are doubles (``null`` and "NA" are NULL), booleans only true, false or null; another kind of cell, an integer with
    a fraction, a nested cell or a row of the wrong length is an error when it is computed. A temporal column whose target
    is Date or Datetime is converted, to UTC, if every value can be (an empty one is missing), and keeps its strings in
    ``<col>__raw``; else it stays a string. Offsets have a colon and are at most 14:00. Rows may be left out if records is 0 or absent; a differing count gives a warning.

    A file of more than ``split`` bytes that is not compressed is read in ranges of that size, by ``json_ranges``: no task
    holds more of it, and every row is parsed where it begins. A smaller one is a cell of one task.
    """
    if _large(spark, path, split):
        head, texts = _split(spark, path, split)
        declared = None if head["records"] is None else int(float(head["records"]))
        if texts is None:
            if declared:
                raise ValueError(f"rows are missing but records is {declared}")
            texts = spark.createDataFrame([], "value string")
        return _typed(texts.select(F.try_variant_get(F.parse_json("value"), "$", "array<variant>").alias("_cells")), _columns(head), declared, True)
    (head,) = _head(spark, path)
    columns = _columns(head)
    declared = None if head["records"] is None else int(float(head["records"]))
    found = head["n_rows"]
    if found is None or found < 0:
        if declared:
            raise ValueError(f"rows are missing but records is {declared}")
        found = 0
    elif declared is not None and declared != found:
        warnings.warn(f"records is {declared}, rows are {found}", stacklevel=2)
    docs = _documents(spark, path)
    cells = F.coalesce(F.try_variant_get("data", "$.rows", "array<variant>"), F.try_variant_get("data", "$.itemData", "array<variant>"), F.array().cast("array<variant>"))
    rows = docs.select(F.explode(cells).alias("_row")).select(F.try_variant_get("_row", "$", "array<variant>").alias("_cells"))
    return _typed(rows, columns)


def _typed(rows: DataFrame, columns: list[dict], declared: int | None = None, count: bool = False) -> DataFrame:
    """Typed columns of the rows in ``_cells`` (arrays of variants); with ``count`` a number of rows other than the
    ``declared`` one gives a warning."""
    wrong = F.raise_error(F.lit("a row's length differs from the number of columns"))
    rows = rows.select(F.when(F.col("_cells").isNull() | (F.size("_cells") != len(columns)), wrong).otherwise(F.col("_cells")).alias("_cells"))

    def cell(i: int, c: dict):
        v, kind = F.col("_cells")[i], F.schema_of_variant(F.col("_cells")[i])
        bad = F.raise_error(F.concat(F.lit(f"{c['name']}: unexpected cell "), F.coalesce(F.to_json(v), F.lit("null"))))
        null = F.is_variant_null(v)
        declared_type = c.get("dataType", c.get("type"))
        text = F.trim(F.try_variant_get(v, "$", "string"))
        if declared_type in NUMBERS:
            number = F.try_variant_get(v, "$", "double")
            whole = F.when(number != F.floor(number), bad).otherwise(number) if declared_type == "integer" else number
            numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "TINYINT", "SMALLINT") | kind.startswith("DECIMAL")
            return F.when(null, None).when((kind == "STRING") & (text == "NA"), None).when(numeric, whole).otherwise(bad.cast("double"))
        if declared_type == "boolean":
            return F.when(null, None).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).otherwise(bad.cast("boolean"))
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        return F.when(null, None).when(nested, bad).otherwise(F.try_variant_get(v, "$", "string"))

    out = rows.select(*[cell(i, c).alias(c["name"]) for i, c in enumerate(columns)])
    targets = {c["name"]: c["targetDataType"].lower() for c in columns if (c.get("targetDataType") or "").lower() in ("date", "datetime")}

    def parsed(name: str):
        x = F.col(name)
        if targets[name] == "date":
            return F.when(x.rlike(DATE), F.try_to_date(x))
        zoned = F.when(x.rlike(r"(Z|[+-]\d{2}:\d{2})$"), x).otherwise(F.concat(x, F.lit("Z")))
        padded = F.regexp_replace(zoned, r"([T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")
        return F.when(x.rlike(STAMP), padded.try_cast("timestamp"))

    if targets or (count and declared is not None):
        ok = out.agg(F.count(F.lit(1)).alias("_rows"), *[F.coalesce(F.bool_and(F.col(n).isNull() | (F.col(n) == "") | parsed(n).isNotNull()), F.lit(True)).alias(n) for n in targets]).first()
        if count and declared is not None and ok["_rows"] != declared:
            warnings.warn(f"records is {declared}, rows are {ok['_rows']}", stacklevel=3)
        for n in targets:
            if ok[n]:
                out = out.withColumn(f"{n}__raw", F.col(n)).withColumn(n, parsed(n))
    for c in columns:
        if c.get("label"):
            out = out.withMetadata(c["name"], {"label": c["label"]})
    return out


def _written(df: DataFrame, name: str, columns: list[dict], records: int | None = None):
    """The metadata of a dataset of ``df``, and a row's text as a column."""
    head = {"datasetJSONVersion": "1.1.0", "itemGroupOID": f"IG.{name}", "name": name, "label": name, "columns": [{"itemOID": f"IT.{name}.{c['name']}", "label": c["name"]} | c for c in columns]}
    if records is not None:
        head["records"] = records
    texts = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

    def cell(c: str, kind: str):
        value = F.date_format(c, texts[kind]) if kind in texts else F.col(c)
        return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1), F.lit("null"))

    kinds = dict(df.dtypes)
    return head, F.concat(F.lit("["), F.concat_ws(",", *[cell(c["name"], kinds[c["name"]]) for c in columns]), F.lit("]"))


def write_dataset_ndjson(df: DataFrame, path: str, name: str, columns: list[dict], records: int | None = None) -> None:
    """Dataset-NDJSON: a line of metadata and a line per row, in files that Spark writes in parallel. ``columns`` has the
    ``name`` and ``dataType`` (and ``label``, ``targetDataType``) of columns of ``df``; temporal ones are written as they
    print in ISO 8601."""
    head, line = _written(df, name, columns, records)
    df.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(path)
    df.select(line.alias("value")).write.mode("append").text(path)


def write_dataset_json(df: DataFrame, path: str, name: str, columns: list[dict]) -> None:
    """One JSON object in one file, in a folder ``path``: the form for exchange. Spark writes the rows' lines in parallel,
    beside it, and ``joined_file`` puts these files at their places in the document; no task sorts or holds the rows."""
    spark = df.sparkSession
    head, line = _written(df, name, columns)
    _columns({"version": head["datasetJSONVersion"], "columns": json.dumps(head["columns"]), "items": None})
    lines = f"{path}-lines"
    df.select(F.concat(F.lit(","), line).alias("value")).write.option("compression", "none").text(lines)
    joined_file(spark, lines, f"{path}/part-00000.json", (json.dumps(head)[:-1] + ', "rows": [\n').encode(), b"]}\n", skip=1)  # the first comma


def _ndjson(spark: SparkSession, path: str) -> tuple[dict, list[dict], DataFrame]:
    """Header, columns and row lines of one dataset. An action on the header line."""
    lines = spark.read.text(path)
    heads = lines.where(F.ltrim("value").startswith("{")).limit(2).collect()
    if len(heads) != 1:
        raise ValueError("a dataset has one line of metadata")
    head = json.loads(heads[0]["value"])
    columns = _columns({"version": head.get("datasetJSONVersion"), "columns": json.dumps(head.get("columns")), "items": None})
    return head, columns, lines.where(F.ltrim("value").startswith("["))


def read_dataset_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Dataset-NDJSON file or folder, typed as ``read_dataset_json`` does. Lines are read in splits, so a
    dataset of any size is read in parallel; a document that is one JSON object is one cell, of 128 MB at most."""
    _, columns, lines = _ndjson(spark, path)
    return _typed(lines.select(F.try_variant_get(F.parse_json("value"), "$", "array<variant>").alias("_cells")), columns)


def dataset_ndjson_meta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(header, columns)`` of a Dataset-NDJSON dataset; without ``records`` its lines are counted."""
    head, columns, lines = _ndjson(spark, path)
    names = [h for h in HEADER if h != "records"]
    records = lines.agg(F.count(F.lit(1)).alias("records")) if head.get("records") is None else spark.createDataFrame([(int(head["records"]),)], "records long")
    header = records.select(F.lit(path).alias("path"), "records", *[F.lit(head.get(h)).cast("string").alias(h) for h in names])
    fields = ("itemOID", "name", "label", "dataType", "targetDataType")
    rows = [(path, i, *[c.get(n) for n in fields], c.get("length")) for i, c in enumerate(columns)]
    return header, spark.createDataFrame(rows, "path string, position int, itemOID string, name string, label string, dataType string, targetDataType string, length long")

"""SAS transport files, version 5: a source of fixed records read by ranges of rows, and a writer of one file a task."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The record size, the header records of the format, the bytes of one variable's description.
RECORD, NAMESTR = 80, 140
LIBRARY = "HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!000000000000000000000000000000  "
MEMBER = "HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000140  "
DESCRIPTOR = "HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!000000000000000000000000000000  "
NAMES = "HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000{:04d}00000000000000000000  "
OBSERVATIONS = "HEADER RECORD*******OBS     HEADER RECORD!!!!!!!000000000000000000000000000000  "
#: Formats whose numbers are days or seconds since 1960-01-01.
DATES = ("DATE", "YYMMDD", "MMDDYY", "DDMMYY", "E8601DA", "IS8601DA", "WORDDATE")
TIMES = ("DATETIME", "E8601DT", "IS8601DT")
EPOCH_DAYS = -3653
NAME_BYTES, LABEL_BYTES, TEXT_BYTES = 8, 40, 200
BATCH_BYTES = 2_000_000
#: Rows are read in ranges of about so many bytes.
SPLIT_BYTES = 32_000_000


@dataclass
class Variable:
    name: str
    numeric: bool
    length: int
    at: int
    label: str
    format: str

    @property
    def kind(self) -> str:
        """Its Spark type."""
        if not self.numeric:
            return "string"
        return "date" if self.format.startswith(DATES) and not self.format.startswith(TIMES) else "timestamp" if self.format.startswith(TIMES) else "double"


def ibm_to_double(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and missing codes of ``(rows, length)`` bytes: base-16 floating point with a 56-bit fraction, cut to the
    length. A missing number has a point, an underscore or a letter, and zeros behind it; the code of another is 0."""
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, : raw.shape[1]] = raw
    bits = full.view(">u8")[:, 0].astype(np.uint64)
    first = full[:, 0]
    fraction = bits & np.uint64(2**56 - 1)
    missing = (fraction == 0) & ((first == 46) | (first == 95) | ((first >= 65) & (first <= 90)))
    exponent = (first & 127).astype(np.int32)
    value = np.ldexp(fraction.astype(np.float64), 4 * (exponent - 64) - 56)
    return np.where(first & 128, -value, value), np.where(missing, first, 0)


def double_to_ibm(values: np.ndarray) -> np.ndarray:
    """``(rows, 8)`` bytes; NaN is a missing number. Doubles have 53 bits, so what is in range comes back as it was."""
    x = np.asarray(values, dtype=np.float64)
    missing = np.isnan(x)
    mantissa, power = np.frexp(np.where(missing, 0, np.abs(x)))
    exponent = -(-power // 4)
    if (np.isinf(x) | (exponent > 63)).any():
        raise ValueError("a number is too large for the format")
    tiny = (exponent < -64) | (mantissa == 0)
    fraction = np.where(tiny, 0, np.ldexp(mantissa, power - 4 * exponent + 56)).astype(np.uint64)
    top = np.where(tiny, 0, exponent + 64).astype(np.uint64) | ((x < 0) & ~tiny).astype(np.uint64) << np.uint64(7)
    bits = np.where(missing, np.uint64(46 << 56), top << np.uint64(56) | fraction)
    return bits.astype(">u8").view(np.uint8).reshape(-1, 8)


def _text(raw: bytes) -> str:
    return raw.decode("latin-1").rstrip(" \0")


def read_header(file) -> tuple[dict, list[Variable], int, int]:
    """Name and label of the dataset, its variables, the place of the first row, a row's length."""
    head = file.read(8 * RECORD)
    if not head.startswith(LIBRARY[:48].encode()) or head[3 * RECORD : 3 * RECORD + 48] != MEMBER[:48].encode():
        raise ValueError("no version 5 transport file")
    size = int(head[3 * RECORD + 74 : 3 * RECORD + 78])
    name, label = _text(head[5 * RECORD + 8 : 5 * RECORD + 16]), _text(head[6 * RECORD + 32 : 6 * RECORD + 72])
    n = int(head[7 * RECORD + 54 : 7 * RECORD + 58])
    block = file.read(-(-n * size // RECORD) * RECORD + RECORD)
    variables = []
    for i in range(n):
        r = block[i * size : (i + 1) * size]
        number = lambda a, b: int.from_bytes(r[a:b], "big")  # noqa: B023, E731
        variables.append(Variable(_text(r[8:16]), number(0, 2) == 1, number(4, 6), number(84, 88), _text(r[16:56]), _text(r[56:64]).upper()))
    start = 8 * RECORD + len(block)
    if block[-RECORD:][:48] != OBSERVATIONS[:48].encode():
        raise ValueError("no observation header")
    return {"name": name, "label": label}, variables, start, sum(v.length for v in variables)


class Rows(InputPartition):
    def __init__(self, path: str, start: int, first: int, stop: int, end: int) -> None:
        self.path, self.start, self.first, self.stop, self.end = path, start, first, stop, end


class XportReader(DataSourceReader):
    """Reads rows ``first`` to ``stop`` of a file in one piece each; only the variables asked for are decoded."""

    def __init__(self, options: dict) -> None:
        self.files, self.encoding = json.loads(options["files"]), options.get("encoding", "utf-8")
        self.variables = [Variable(*v) for v in json.loads(options["variables"])]
        self.codes, self.width, self.split = options.get("codes") == "true", int(options["width"]), int(options["split"])

    def partitions(self) -> list[Rows]:
        step, parts = max(1, self.split // max(self.width, 1)), []
        for path, start, size in self.files:
            rows = (size - start) // self.width
            parts += [Rows(path, start, a, min(a + step, rows), size) for a in range(0, rows, step)]
        return parts or [Rows("", 0, 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.stop <= part.first:
            return
        fs, name = pyarrow.fs.FileSystem.from_uri(part.path)
        with fs.open_input_file(name) as file:
            step = max(1, BATCH_BYTES // self.width)
            for first in range(part.first, part.stop, step):
                n = min(step, part.stop - first)
                at = part.start + first * self.width
                file.seek(at)
                data = file.read(n * self.width)
                another = data.find(MEMBER[:48].encode())
                while another >= 0 and (at + another - part.start) % RECORD:
                    another = data.find(MEMBER[:48].encode(), another + 1)
                if another >= 0:
                    raise ValueError("the file holds several datasets")
                block = np.frombuffer(data, dtype=np.uint8).reshape(n, self.width)
                last = n
                while last and part.end - (at + (last - 1) * self.width) < RECORD and (block[last - 1] == 32).all():
                    last -= 1  # blanks that fill the last record
                yield self._batch(block[:last])

    def _batch(self, block: np.ndarray) -> pa.RecordBatch:
        columns, names = [], []
        for v in self.variables:
            raw = block[:, v.at : v.at + v.length]
            if v.numeric:
                value, code = ibm_to_double(raw)
                lost = code != 0
                if v.kind == "date":
                    whole = np.where(lost, 0, np.floor(value)).astype(np.int32) + EPOCH_DAYS
                    columns.append(pa.array(whole, pa.int32(), mask=lost).cast(pa.date32()))
                elif v.kind == "timestamp":
                    micros = np.where(lost, 0, np.rint((value + EPOCH_DAYS * 86400) * 1e6)).astype(np.int64)
                    columns.append(pa.array(micros, pa.int64(), mask=lost).cast(pa.timestamp("us", tz="UTC")))
                else:
                    columns.append(pa.array(value, pa.float64(), mask=lost))
            else:
                text = np.ascontiguousarray(raw).view(f"S{v.length}")[:, 0]
                columns.append(pa.array([t.rstrip(b" ").decode(self.encoding) for t in text.tolist()], pa.string()))
            names.append(v.name)
            if self.codes and v.numeric:
                columns.append(pa.array([chr(c) if c else None for c in code.tolist()], pa.string()))
                names.append(f"{v.name}__missing")
        return pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Written(WriterCommitMessage):
    path: str


def layout(schema, lengths: dict[str, int]) -> list[Variable]:
    """The variables that a table is written as."""
    out, at = [], 0
    for f in schema:
        kind = f.dataType.simpleString()
        label = (f.metadata or {}).get("label", "")
        numeric = kind != "string"
        if numeric and kind not in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "boolean") and not kind.startswith("decimal"):
            raise ValueError(f"{f.name}: {kind} has no place in the format")
        if len(f.name.encode()) > NAME_BYTES or not f.name.isascii():
            raise ValueError(f"{f.name}: names have at most {NAME_BYTES} ASCII characters")
        if len(label.encode()) > LABEL_BYTES:
            raise ValueError(f"{f.name}: labels have at most {LABEL_BYTES} bytes")
        length = 8 if numeric else lengths.get(f.name, TEXT_BYTES)
        out.append(Variable(f.name, numeric, length, at, label, {"date": "DATE", "timestamp": "DATETIME"}.get(kind, "")))
        at += length
    return out


def header(name: str, label: str, variables: Sequence[Variable]) -> bytes:
    """All records before the rows."""
    stamp = "01JAN60:00:00:00"
    pad = lambda x, n: x.encode("latin-1")[:n].ljust(n)
    out = [LIBRARY.encode(), pad(f"SAS     SAS     SASLIB  9.4     {'':8}{'':24}{stamp}", RECORD), pad(stamp, RECORD), MEMBER.encode(), DESCRIPTOR.encode()]
    out += [pad(f"SAS     {name:8}SASDATA 9.4     {'':8}{'':24}{stamp}", RECORD), pad(f"{stamp}{'':16}{label:40}", RECORD), NAMES.format(len(variables)).encode()]
    described = b""
    for i, v in enumerate(variables):
        short = lambda *x: b"".join(n.to_bytes(2, "big") for n in x)
        form = pad(v.format, 8) + short({"DATE": 9, "DATETIME": 20}.get(v.format, 0), 0, 0, 0) + pad("", 8) + short(0, 0)
        described += short(1 if v.numeric else 2, 0, v.length, i + 1) + pad(v.name, 8) + v.label.encode().ljust(LABEL_BYTES) + form + v.at.to_bytes(4, "big") + bytes(52)
    out += [described.ljust(-(-len(described) // RECORD) * RECORD), OBSERVATIONS.encode()]
    return b"".join(out)


class XportWriter(DataSourceArrowWriter):
    """A whole transport file for each task, under a name of its own until the job commits."""

    def __init__(self, options: dict, variables: list[Variable]) -> None:
        self.path, self.name, self.label, self.variables = options["path"], options["dataset"], options.get("label", ""), variables

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/_attempts", recursive=True)
        at, size = f"{root}/_attempts/{uuid.uuid4().hex}.xpt", 0
        with fs.open_output_stream(at) as out:
            out.write(header(self.name, self.label, self.variables))
            for batch in iterator:
                if batch.num_rows:
                    rows = self._rows(batch)
                    out.write(rows.tobytes())
                    size += rows.size
            out.write(b" " * (-size % RECORD))
        return Written(at)

    def _rows(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.full((batch.num_rows, sum(v.length for v in self.variables)), 32, dtype=np.uint8)
        for v, column in zip(self.variables, batch.columns, strict=True):
            place = out[:, v.at : v.at + v.length]
            if v.numeric:
                if pa.types.is_date(column.type):
                    column = pa.compute.subtract(column.cast(pa.int32()).cast(pa.float64()), float(EPOCH_DAYS))
                elif pa.types.is_timestamp(column.type):
                    column = pa.compute.subtract(pa.compute.divide(column.cast(pa.int64()).cast(pa.float64()), 1e6), float(EPOCH_DAYS * 86400))
                elif pa.types.is_boolean(column.type):
                    column = column.cast(pa.int8())
                place[:] = double_to_ibm(column.cast(pa.float64()).to_numpy(zero_copy_only=False))
            else:
                raw = [(t or "").encode() for t in column.to_pylist()]
                if max(map(len, raw)) > v.length:
                    raise ValueError(f"{v.name}: a text has more than {v.length} bytes")
                place[:] = np.frombuffer(b"".join(t.ljust(v.length) for t in raw), dtype=np.uint8).reshape(-1, v.length)
        return out

    def commit(self, messages) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for i, m in enumerate(m for m in messages if m is not None):
            fs.move(m.path, f"{root}/part-{i:05d}.xpt")
        fs.delete_dir(f"{root}/_attempts")

    def abort(self, messages) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class XportSource(DataSource):
    """The format ``xport``; ``read_xport`` and ``write_xport`` set its options."""

    @classmethod
    def name(cls) -> str:
        return "xport"

    def schema(self) -> str:
        found = [Variable(*v) for v in json.loads(self.options["variables"])]
        more = self.options.get("codes") == "true"
        return ", ".join(f for v in found for f in [f"`{v.name}` {v.kind}", *([f"`{v.name}__missing` string"] if more and v.numeric else [])])

    def reader(self, schema) -> XportReader:
        return XportReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> XportWriter:
        return XportWriter(dict(self.options), layout(schema, json.loads(self.options["lengths"])))


def xport_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Address and size of the file, or of the files in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = fs.listStatus(at) if fs.getFileStatus(at).isDirectory() else [fs.getFileStatus(at)]
    return sorted((s.getPath().toString(), s.getLen()) for s in listed if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def xport_meta(spark: SparkSession, path: str) -> tuple[dict, list[Variable], list[tuple[str, int, int]], int]:
    """Dataset, variables, files with the place of their first row and their size, and the row's length. Reads headers."""
    found, files = None, []
    for name, size in xport_files(spark, path):
        fs, local = pyarrow.fs.FileSystem.from_uri(name)
        with fs.open_input_file(local) as file:
            head, variables, start, width = read_header(file)
        if found and found[1] != variables:
            raise ValueError("the files differ in their variables")
        found = found or (head, variables, width)
        files.append((name, start, size))
    if found is None:
        raise ValueError(f"no file in {path}")
    return found[0], found[1], files, found[2]


def read_xport(spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, codes: bool = False, encoding: str = "utf-8", split: int = SPLIT_BYTES) -> DataFrame:
    """The rows of a transport file, or of a folder of files of one dataset, by ranges of ``split`` bytes of rows.

    Numbers are doubles, or dates and timestamps (UTC) by their format; missing ones are NULL, with ``codes`` their code (a
    point, an underscore or a letter) is in ``<name>__missing``. Texts lose trailing blanks, an empty one stays empty.
    Labels are column metadata. Only ``columns`` are decoded. A file with several datasets is an error."""
    _, variables, files, width = xport_meta(spark, path)
    if columns is not None:
        by = {v.name: v for v in variables}
        missing = [c for c in columns if c not in by]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        variables = [by[c] for c in columns]
    spark.dataSource.register(XportSource)
    told = json.dumps([[v.name, v.numeric, v.length, v.at, v.label, v.format] for v in variables])
    reader = spark.read.format("xport").options(files=json.dumps(files), variables=told, width=str(width), codes=str(codes).lower(), encoding=encoding, split=str(split))
    out = reader.load()
    for v in variables:
        if v.label:
            out = out.withMetadata(v.name, {"label": v.label})
    return out


def write_xport(df: DataFrame, path: str, name: str, label: str = "") -> None:
    """``df`` as a folder of transport files, one a task, each whole with its header. Texts are as long as the longest of
    their column (one aggregate), 200 bytes at most; NULL is missing, and an empty text."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    lengths = df.agg(*[F.max(F.octet_length(c)).alias(c) for c in texts]).first().asDict() if texts else {}
    long = [c for c in texts if (lengths[c] or 0) > TEXT_BYTES]
    if long:
        raise ValueError(f"texts of over {TEXT_BYTES} bytes: {', '.join(long)}")
    lengths = {c: max(1, n or 0) for c, n in lengths.items()}
    layout(df.schema, lengths)  # refuses what has no place before anything is written
    spark = df.sparkSession
    spark.dataSource.register(XportSource)
    address = spark._jvm.org.apache.hadoop.fs.Path(path)
    address = address.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(address).toString()
    df.write.format("xport").mode("append").options(path=address, dataset=name, label=label, lengths=json.dumps(lengths), variables="[]").save()

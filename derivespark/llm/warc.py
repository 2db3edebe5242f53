"""A WARC archive as a Spark source, and a writer that stores repeated payloads once."""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from .common import new_path, saved, small

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "content_type string, content_length long, http_length long, truncated boolean, payload binary"
)
#: WARC header of each column that a predicate can reach.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
#: Files are packed into partitions of about so many bytes; a batch holds so many payload bytes or rows.
PARTITION_BYTES, BATCH_BYTES, BATCH_ROWS = 64_000_000, 2_000_000, 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Inflated(io.RawIOBase):
    """The bytes of a gzip file of any number of members, as WARC archives have one for each record."""

    def __init__(self, raw) -> None:
        self.raw, self.inner, self.rest = raw, zlib.decompressobj(31), b""
        self.started = self.cut = False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            data = self.rest or self.raw.read(1 << 16)
            if not data:
                self.cut = self.started and not self.inner.eof
                return 0
            if self.inner.eof:
                self.inner = zlib.decompressobj(31)
            self.started = True
            out = self.inner.decompress(data, len(into))
            self.rest = self.inner.unused_data if self.inner.eof else self.inner.unconsumed_tail
            if out:
                into[: len(out)] = out
                return len(out)


def records(stream, wanted, with_payload: bool, mark: bool = False) -> Iterator[tuple]:
    """Records whose header passes ``wanted``. Headers are read first; the block of any other record is skipped, and so
    is a wanted record's payload if no one asks for it.

    A file that ends within a record is an error; with ``mark`` that record is given as far as it goes and marked as
    truncated, if its header is whole."""
    inflated = stream.raw if isinstance(stream.raw, _Inflated) else None
    size = stream.seek(0, io.SEEK_END) if inflated is None else 0
    if inflated is None:
        stream.seek(0)

    def skip(n: int) -> int:
        """Bytes that are missing after going on by ``n``."""
        if inflated is None:
            return max(0, stream.seek(n, io.SEEK_CUR) - size)
        while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
            n -= got
        return n

    def cut(what: str) -> None:
        if not mark:
            raise ValueError(f"the archive ends within {what}")

    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            if inflated is None or not inflated.cut:
                raise ValueError(f"no WARC record at {line[:40]!r}")
            return cut("a header")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        if not line:
            return cut("a header")
        length = int(head["content-length"])
        values = {c: head.get(h) for c, h in HEADERS.items()}
        if not wanted(values):
            if skip(length):
                return cut("a record")
            continue
        http_length, http_bytes = None, 0
        if (values["content_type"] or "").startswith("application/http"):
            while http_bytes < length and (line := stream.readline(length - http_bytes)):
                http_bytes += len(line)
                if line.lower().startswith(b"content-length:"):
                    http_length = int(line.split(b":", 1)[1])
                if not line.strip():
                    break
        payload = None
        if with_payload and values["record_type"] != "revisit":
            payload = stream.read(length - http_bytes)
            missing = length - http_bytes - len(payload)
        else:
            missing = skip(length - http_bytes)
        if missing:
            cut("a record")
        yield (*values.values(), length, http_length, missing > 0, payload)
        if missing:
            return
    if inflated is not None and inflated.cut:
        cut("a compressed record")


class PlainReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.with_payload, self.tests = options["path"], options.get("payload", "true") == "true", []
        for column in HEADERS:  # options of the reader's own, whatever the session pushes
            if f"only.{column}" in options:
                self.tests.append((column, "in", tuple(json.loads(options[f"only.{column}"]))))
        self.mark = {"error": False, "mark": True}[options.get("truncated", "error")]

    def partitions(self) -> list[Files]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pyarrow.fs.FileType.Directory else [fs.get_file_info(root)]
        files = [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        parts, size = [[]], 0
        for f in sorted(files, key=lambda f: f.path):
            if parts[-1] and size + f.size > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)

        def wanted(values: dict) -> bool:
            return all(values[c] is not None and (values[c] in v if how == "in" else values[c].startswith(v)) for c, how, v in self.tests)

        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split(" ")[1]] for c in SCHEMA.split(", ")]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                gz = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = io.BufferedReader(_Inflated(raw) if gz else raw, 1 << 20)
                for r in records(stream, wanted, self.with_payload, self.mark):
                    rows.append(r)
                    size += len(r[-1] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcReader(PlainReader):
    def pushFilters(self, filters):
        """Equality, membership and prefix tests of header columns run on the headers; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 and isinstance(f, EqualTo | In | StringStartsWith) else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS:
                self.tests.append((column, "prefix", f.value))
            else:
                yield f


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(path)``: plain or gzipped WARC files, by file. An archive
    that ends within a record is an error, or with ``option("truncated", "mark")`` its last record has ``truncated``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlainReader:
        """Spark refuses a reader that takes predicates where the session does not push them."""
        return (WarcReader if self.options.get("pushdown", "true") == "true" else PlainReader)(dict(self.options))


def read_warc(spark: SparkSession, path: str, *, payload: bool = True, truncated: str = "error", only: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The records under ``path``; with ``only`` those whose headers have one of the values given for each column. These
    tests run on the headers always; predicates of a query do so if the session has
    ``spark.sql.python.filterPushdown.enabled``, else Spark applies them to the records. No setting is changed."""
    spark.dataSource.register(WarcSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("warc").options(payload=str(payload).lower(), truncated=truncated, pushdown=pushed)
    for column, values in (only or {}).items():
        if column not in HEADERS:
            raise ValueError(f"{column} is no header column")
        reader = reader.option(f"only.{column}", json.dumps(list(values)))
    return reader.load(path)


def _urn(c):
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record for each row of ``pages`` (``page_id, url, html``), written by Spark's text sink to any file system.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the smallest page_id is a response and the others
    revisit it without a payload. Null html is empty; a row without page_id is a response unless its payload
    repeats; rows that repeat the smallest page_id are responses too. A payload of any length is one record. Blanks and control characters of a url are
    percent-encoded as one blank, a null url is left out.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html")})
    groups = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = saved(groups.where("n > 1").select(F.col("digest").alias("of"), "first"), "warc-repeats")
    joined = rows.join(small(groups), F.col("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("first"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, "").otherwise(F.col("html")),
    )
    joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives and reads them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    A response's size and digest come from the payload read; a revisit's from its own headers."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "http_length").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )

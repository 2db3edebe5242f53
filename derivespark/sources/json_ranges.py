"""The rows of one JSON document of any size, read in byte ranges.

A range does not know whether it starts within a string, or how deep. A first pass looks at each range both ways, as if it
began inside and outside a string, and gives for either the state at its end; put in order, these few numbers tell the true
state at the start of every range. Then each task reads the rows that begin in its own range.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of the array of rows, in the present and in the older layout.
KEY = re.compile(rb'"(rows|itemData)"\s*:\s*\[')
#: Bytes that a key with its colon and bracket may take beyond its range; how much more is read at a time to end a row.
KEY_BYTES, MORE_BYTES = 4096, 1 << 20
#: The text around the rows, which the driver reads.
HEADER_BYTES = 64_000_000
STATES = "at long, inside boolean, ends_inside boolean, delta long, least long, keys array<struct<offset:long,depth:long>>"
BATCH_BYTES = 4_000_000
#: A task holds some twenty bytes for each byte of its range.
SPLIT_BYTES = 16_000_000
#: Bytes that a task puts into a joined file, and those that it holds at a time.
PIECE_BYTES, COPY_BYTES = 64_000_000, 4_000_000


def _open(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _escaped(file, at: int) -> bool:
    """Does an odd run of backslashes end just before ``at``?"""
    n, step = 0, 64
    while at - n > 0:
        low = max(0, at - n - step)
        file.seek(low)
        block = file.read(at - n - low)
        kept = len(block) - len(block.rstrip(b"\\"))
        n += kept
        if kept < len(block):
            break
        step *= 2
    return n % 2 == 1


def depths(buf: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each byte: is it outside of strings, and the number of brackets open after it, from zero; and whether the bytes
    end inside a string. ``inside`` and ``escaped`` tell of the first byte."""
    slash = np.flatnonzero(buf == 92)
    plain = buf == 34
    if len(slash) or escaped:
        first = np.flatnonzero(np.r_[True, np.diff(slash) != 1][: len(slash)])
        run = np.diff(np.r_[first, len(slash)])
        run = run + (escaped & (slash[first] == 0)) if len(first) else run
        behind = slash[first] + np.diff(np.r_[first, len(slash)])
        odd = behind[(run % 2 == 1) & (behind < len(buf))]
        plain[odd] = False
        if escaped and len(buf) and buf[0] == 34:
            plain[0] = False
    within = np.logical_xor.accumulate(plain) ^ inside  # after each byte
    outside = ~within & ~plain
    step = np.zeros(len(buf), dtype=np.int8)
    step[outside & ((buf == 91) | (buf == 123))] = 1
    step[outside & ((buf == 93) | (buf == 125))] = -1
    return outside, np.cumsum(step, dtype=np.int32), bool(within[-1]) if len(buf) else inside


def _states(path: str, split: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("at").to_pylist():
                with _open(path) as file:
                    escaped = _escaped(file, at)
                    file.seek(at)
                    data = file.read(min(split + KEY_BYTES, size - at))
                own = np.frombuffer(data[:split], dtype=np.uint8)
                rows = []
                for inside in (False, True):
                    _, depth, ends = depths(own, inside, escaped)
                    keys = []
                    for m in KEY.finditer(data):
                        if m.start() < len(own) and not depths(own[: m.start()], inside, escaped)[2] and depths(own[: m.start() + 1], inside, escaped)[2]:
                            opened = depths(np.frombuffer(data[: m.end()], np.uint8), inside, escaped)
                            keys.append({"offset": at + m.end(), "depth": int(opened[1][-1])})
                    rows.append((at, inside, ends, int(depth[-1]) if len(depth) else 0, int(depth.min()) if len(depth) else 0, keys))
                kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("depth", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["at", "inside", "ends_inside", "delta", "least", "keys"])

    return run


def _end(path: str, start: int, inside: bool, depth: int, stop: int, least: int):
    """Place of the bracket that first takes the depth below ``least`` in a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with _open(path) as file:
                escaped = _escaped(file, start)
                file.seek(start)
                data = file.read(stop - start)
            found = np.flatnonzero(depths(np.frombuffer(data, np.uint8), inside, escaped)[1] + depth < least)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([start + int(found[0])])], ["at"])

    return run


class Range(InputPartition):
    def __init__(self, start: int, stop: int, inside: bool, depth: int) -> None:
        self.start, self.stop, self.inside, self.depth = start, stop, inside, depth


class RowsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.level, self.end = options["path"], int(options["level"]), int(options["end"])
        self.ranges = options["ranges"]  # as text: every task gets the reader, and would make a range of each

    def partitions(self) -> list[Range]:
        return [Range(*map(int, r.split(":"))) for r in self.ranges.split(",") if r] or [Range(0, 0, False, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The rows that begin in the range, as text: whole elements of the array, whatever they are."""
        if part.stop <= part.start:
            return
        with _open(self.path) as file:
            escaped = _escaped(file, part.start)
            file.seek(part.start)
            data = file.read(part.stop - part.start)
            while True:
                buf = np.frombuffer(data, dtype=np.uint8)
                outside, depth, _ = depths(buf, bool(part.inside), escaped)
                depth = depth + part.depth
                before = np.r_[part.depth, depth[:-1]]
                opens = np.flatnonzero((before == self.level) & (depth == self.level + 1))
                closes = np.flatnonzero((before == self.level + 1) & (depth == self.level))
                opens = opens[opens < part.stop - part.start]
                closes = closes[closes > opens[0]] if len(opens) else closes[:0]
                at = part.start + len(data)
                if len(closes) >= len(opens) or at >= self.end:
                    break
                data += file.read(min(max(MORE_BYTES, len(data) // 4), self.end - at))  # the last row goes on
        own = slice(0, part.stop - part.start)
        stray = (before[own] == self.level) & (depth[own] == self.level) & ~np.isin(buf[own], np.frombuffer(b" \t\r\n,", np.uint8))
        if stray.any() or len(closes) < len(opens):
            raise ValueError("an element of the rows is no array")
        low = 0
        sizes = np.cumsum(closes[: len(opens)] + 1 - opens)
        while low < len(opens):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BATCH_BYTES)))
            yield pa.RecordBatch.from_arrays([pa.array([data[o : c + 1].decode("utf-8") for o, c in zip(opens[low:high].tolist(), closes[low:high].tolist(), strict=True)], pa.string())], ["value"])
            low = high


class RowsSource(DataSource):
    """The elements of one array of a JSON document, as text; options tell its ranges and their states."""

    @classmethod
    def name(cls) -> str:
        return "json_document_rows"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> RowsReader:
        return RowsReader(dict(self.options))


def qualified(spark: SparkSession, path: str) -> tuple[str, int]:
    """The file's address with its scheme, and its size."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(at)
    if status.isDirectory():
        files = [s for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))]
        if len(files) != 1:
            raise ValueError(f"{path} holds {len(files)} files, not one document")
        status = files[0]
    return status.getPath().toString(), status.getLen()


def document_rows(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> tuple[bytes, DataFrame | None]:
    """``(rest, rows)``: the document with an empty array of rows, which the driver reads, and the rows' texts (``value``)
    by ranges of ``split`` bytes; ``None`` if there is no such array. An action of one pass over the document."""
    path, size = qualified(spark, path)
    starts = list(range(0, size, split))
    frame = spark.createDataFrame([(a,) for a in starts], "at long").repartition(max(1, len(starts)), "at")
    seen = frame.mapInArrow(_states(path, split, size), STATES).collect()  # two small rows a range
    by = {(r["at"], r["inside"]): r for r in seen}
    states, inside, depth = [], False, 0
    for at in starts:
        states.append((at, inside, depth))
        r = by[at, inside]
        inside, depth = r["ends_inside"], depth + r["delta"]
    if inside or depth:
        raise ValueError("the document ends within a value")
    keys = [(k["offset"], d + k["depth"]) for a, i, d in states for k in by[a, i]["keys"]]
    if not keys:
        if size > HEADER_BYTES:
            raise ValueError("the document has no rows and is too large for a header")
        with _open(path) as file:
            return file.read(), None
    begin, level = min(keys, key=lambda k: (k[1], k[0]))  # the outermost
    end = None
    for at, inside, depth in states:
        if at + split > begin and depth + by[at, inside]["least"] < level:  # twice at most: the range with the key, that with the end
            low = max(at, begin)
            look = _end(path, low, inside and low == at, depth if low == at else level, min(at + split, size), level)
            found = spark.createDataFrame([(0,)], "one int").mapInArrow(look, "at long").collect()
            if found:
                end = found[0]["at"]
                break
    if end is None:
        raise ValueError("the rows do not end")
    if begin + size - end > HEADER_BYTES:
        raise ValueError("the text around the rows is too large for a header")
    with _open(path) as file:
        rest = file.read(begin)
        file.seek(end)
        rest += file.read()
    ranges = []
    for at, inside, depth in states:
        low, high = max(at, begin), min(at + split, end)
        if low < high:
            ranges.append(f"{low}:{high}:{int(inside and low == at)}:{depth if low == at else level}")
    spark.dataSource.register(RowsSource)
    rows = spark.read.format("json_document_rows").options(path=path, level=str(level), end=str(end), ranges=",".join(ranges)).load()
    return rest, rows.select(F.col("value"))


def _blocks(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """The bytes of a range, some at a time, each with its place."""
    with _open(path) as file:
        file.seek(start)
        while start < stop:
            data = file.read(min(COPY_BYTES, stop - start))
            if not data:
                raise ValueError(f"{path} ends at {start}, before {stop}")
            yield start, data
            start += len(data)


def _put(name: str):
    """Writes pieces of other files at their places in the local or mounted file ``name``, and tells the bytes written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                file = os.open(name, os.O_WRONLY)
                try:
                    for at, data in _blocks(piece["path"], piece["start"], piece["stop"]):
                        view, place = memoryview(data), piece["place"] + at - piece["start"]
                        while view:
                            n = os.pwrite(file, view, place)
                            view, place = view[n:], place + n
                    os.fsync(file)
                finally:
                    os.close(file)
                yield pa.RecordBatch.from_arrays([pa.array([piece["stop"] - piece["start"]], pa.int64())], ["done"])

    return run


def _stream(target: str, first: bytes, last: bytes):
    """Writes one file from all pieces, in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = pyarrow.fs.FileSystem.from_uri(target)
        done = 0
        with fs.open_output_stream(name) as out:
            out.write(first)
            for batch in batches:
                for piece in batch.to_pylist():
                    for _, data in _blocks(piece["path"], piece["start"], piece["stop"]):
                        out.write(data)
                        done += len(data)
            out.write(last)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["done"])

    return run


def joined_file(spark: SparkSession, folder: str, target: str, first: bytes, last: bytes, skip: int = 0, piece: int = PIECE_BYTES) -> None:
    """The new file ``target``: ``first``, the bytes of the files of ``folder`` but the first ``skip``, ``last``. The folder
    is removed. An action.

    In a local or mounted file system (``file:``) tasks write pieces of ``piece`` bytes at their places, side by side. Other
    stores have no such writes: there one task streams all, ``COPY_BYTES`` at a time."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, made = hadoop(folder), hadoop(target)
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(made.getParent()):
        raise ValueError(f"{made.getParent()} exists already")
    statuses = source.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(source)
    found = sorted((s.getPath().toUri().toString(), s.getLen()) for s in statuses if not s.getPath().getName().startswith(("_", ".")))
    pieces, place = [], len(first)
    for name, size in found:
        for start in range(0, size, piece):
            low, high = start + min(skip, min(start + piece, size) - start), min(start + piece, size)
            skip -= low - start
            if low < high:
                pieces.append((name, low, high, place))
                place += high - low
    fs.mkdirs(made.getParent())
    open_ = fs.makeQualified(hadoop(made.getParent(), f"_{made.getName()}"))  # the name of what is not whole yet
    local = open_.toUri().getScheme() == "file"
    if local:
        with open(open_.toUri().getPath(), "wb") as file:
            file.write(first)
            file.seek(place)
            file.write(last)
    frame = spark.createDataFrame(pieces, "path string, start long, stop long, place long")
    if local:
        told = frame.repartition(max(1, len(pieces)), "place").mapInArrow(_put(open_.toUri().getPath()), "done long")
    else:
        told = frame.coalesce(1).sortWithinPartitions("place").mapInArrow(_stream(open_.toUri().toString(), first, last), "done long")
    done = sum(r["done"] for r in told.collect())  # a number a piece
    if done != place - len(first):
        raise ValueError(f"{target}: {done} of {place - len(first)} bytes were written")
    if not fs.rename(open_, made):
        raise ValueError(f"{open_.toString()} cannot be renamed")
    source.getFileSystem(spark._jsc.hadoopConfiguration()).delete(source, True)

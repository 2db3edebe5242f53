"""Removal of byte passages that repeat across documents, by suffix arrays."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import U, chunks, rolling, window_min
from .common import new_path, release, saved, small_batches, whole_id

#: A passage has so many bytes; any passage holds exactly one least hash among its GRAM-byte windows, its anchor.
LENGTH, GRAM = 50, 26
CHUNK_BYTES = 1_500_000
#: Text whose anchors, and whose open passages, one task takes.
ANCHOR_SHARE, MERGE_SHARE, TABLE_SHARE = 16_000_000, 5_000_000, 32_000_000
NOBODY = np.iinfo(np.int64).max
#: Buckets from this number on are parts of another one, by passage.
PARTS = 2**24

CHUNK = "chunk_id long, doc_ids array<long>, sizes array<int>, text binary"
ANCHORS = "bucket int, chunk_id long, anchors binary, low binary, many binary"
OPEN = "bucket long, chunk_id long, place binary, doc binary, start binary, count binary, text binary, size int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def words_at(buf: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every position on as one number; bytes beyond the end are zero."""
    padded = np.concatenate([buf, np.zeros(72, np.uint8)])
    return np.ndarray((len(buf) + 64,), f"{order}u8", padded, strides=(1,))


def suffix_array(buf: np.ndarray, depth: int = 64) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes. As Larsson and Sadakane refine: groups that agree on h bytes
    are sorted by the group of the suffix h bytes on, and groups of one are left alone from then on."""
    n = len(buf)
    key = words_at(buf, ">")[:n].astype(np.uint64)
    sa = np.argsort(key)
    rank = np.full(n + depth + 1, -1, dtype=np.int64)

    def regroup(at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Numbers groups by the place of their first member; gives the places in groups of more than one."""
        head = np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
        rank[sa[at]] = head
        alone = new & np.r_[new[1:], True]
        return at[~alone]

    sorted_key = key[sa]
    rest = regroup(np.arange(n), np.r_[True, sorted_key[1:] != sorted_key[:-1]][:n])
    h = 8
    while h < depth and len(rest):
        joint = rank[sa[rest]] * (n + 2) + rank[sa[rest] + h] + 1
        order = np.argsort(joint)
        sa[rest] = sa[rest][order]
        joint = joint[order]
        rest = regroup(rest, np.r_[True, joint[1:] != joint[:-1]])
        h *= 2
    return sa


def kasai(buf: np.ndarray, sa: np.ndarray, cap: int = LENGTH, stride: int = 32) -> np.ndarray:
    """Common prefix, up to ``cap``, of each suffix in ``sa`` with the one before it. In text order a common prefix is
    at most one shorter than that of the position before (Kasai); positions ``stride`` apart advance together."""
    n = len(buf)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.arange(n)
    before = np.where(rank > 0, sa[rank - 1], -1)
    words, prefix = words_at(buf, "<"), np.zeros(n, dtype=np.int64)
    for r in range(min(stride, n)):
        i = np.arange(r, n, stride)
        long = np.maximum(prefix[i - 1] - 1, 0) if r else np.zeros(len(i), dtype=np.int64)
        if r:  # suffixes that agree beyond the depth may stand in any order; the bound needs the neighbour's before this
            long[rank[np.minimum(before[i - 1] + 1, n - 1)] >= rank[i]] = 0
        active = np.flatnonzero(before[i] >= 0)
        long[before[i] < 0] = 0
        while len(active):
            x = words[np.minimum(i[active] + long[active], n)] ^ words[np.minimum(before[i[active]] + long[active], n)]
            same = x == 0
            long[active[same]] += 8
            part = x[~same]
            long[active[~same]] += (np.log2((part & (~part + U(1))).astype(np.float64)).astype(np.int64)) >> 3
            active = active[same]
            active = active[long[active] < cap]
        prefix[i] = np.minimum(long, cap)
    return prefix[sa]


def runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of consecutive ``starts`` that agree in all of ``same``."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, np.diff(starts) != 1]
    for x in same:
        new |= np.r_[True, x[1:] != x[:-1]]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(starts)])


def _write_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32
    for k, (batch, texts) in enumerate(chunks(batches, "text", CHUNK_BYTES)):
        columns = [[task + k], [batch.column("doc_id").to_pylist()], [[len(t) for t in texts]], [b"".join(texts)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk_id", "doc_ids", "sizes", "text"])


class Chunk:
    """A chunk's bytes, and of every start of a passage in it (no passage crosses documents) the anchor."""

    def __init__(self, row: dict) -> None:
        self.id, self.ids = row["chunk_id"], row["doc_ids"]
        self.buf = np.frombuffer(row["text"] or b"", dtype=np.uint8)
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.bounds = np.r_[0, np.cumsum(self.sizes)]
        self.docs = np.array([NOBODY if d is None else d for d in self.ids], dtype=np.int64)

    def starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions where a passage starts, the place of their document in the chunk, their anchors."""
        rolled = window_min(rolling(self.buf, GRAM), LENGTH - GRAM + 1) if len(self.buf) >= LENGTH else np.zeros(0, np.uint64)
        room = np.where(self.docs == NOBODY, 0, np.maximum(self.sizes - LENGTH + 1, 0))
        place = np.repeat(np.arange(len(room)), room)
        at = np.repeat(self.bounds[:-1] - np.r_[0, np.cumsum(room)[:-1]], room) + np.arange(room.sum())
        return at, place, rolled[at]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _binary(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    for low, high in zip(first, [*first[1:], len(order)], strict=True):
        yield int(bucket[order[low]]), order[low:high]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            _, place, anchor = chunk.starts()
            change = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1])][: len(anchor)])
            anchor, doc = anchor[change], chunk.docs[place[change]]
            order = np.argsort(anchor, kind="stable")
            anchor, doc = anchor[order], doc[order]
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
            if len(first):
                keys, low = anchor[first], np.minimum.reduceat(doc, first)
                many = low < np.maximum.reduceat(doc, first)
                out = [(b, chunk.id, keys[i].tobytes(), low[i].tobytes(), many[i].tobytes()) for b, i in _dealt((keys % U(buckets)).astype(np.int64))]
                yield _table(out, ANCHORS)

    return run


def _repeated(part: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket's anchors, those that occur in more than one document, given back to each chunk that has them."""
    keys, low, many = (np.concatenate([np.frombuffer(b, kind) for b in part[c]]) for c, kind in (("anchors", np.uint64), ("low", np.int64), ("many", bool)))
    chunk = np.repeat(part["chunk_id"].to_numpy(), [len(b) // 8 for b in part["anchors"]])
    order = np.argsort(keys, kind="stable")
    keys, low, many, chunk = keys[order], low[order], many[order], chunk[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    many = np.logical_or.reduceat(many, first) | (np.minimum.reduceat(low, first) < np.maximum.reduceat(low, first))
    keep = np.repeat(many, np.diff(np.r_[first, len(keys)]))
    keys, chunk = keys[keep], chunk[keep]
    out = [(int(chunk[i[0]]), keys[i].tobytes()) for _, i in _dealt(chunk)]
    return pd.DataFrame(out, columns=["chunk_id", "anchors"])


def _open_passages(buckets: int):
    """Settles what a chunk's own suffix array shows, and sends out what other chunks may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            known = np.unique(np.frombuffer(b"".join(row["repeated"]), dtype=np.uint64))
            at, place, anchor = chunk.starts()
            found = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            keep = known[found] == anchor
            at, place, anchor = at[keep], place[keep], anchor[keep]
            first, count = runs(at, place)
            length = count + LENGTH - 1
            index = np.repeat(at[first] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            region = chunk.buf[index]
            inside = np.repeat(np.r_[0, np.cumsum(length)[:-1]] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            owner = np.full(len(region), NOBODY, dtype=np.int64)
            owner[inside] = chunk.docs[place]
            sa = suffix_array(region)
            head = np.flatnonzero(np.r_[True, kasai(region, sa)[1:] < LENGTH][: len(sa)])
            least = np.empty(len(region), dtype=np.int64)
            least[sa] = np.repeat(np.minimum.reduceat(owner[sa], head), np.diff(np.r_[head, len(sa)]))
            done = owner[inside] > least[inside]
            local = np.flatnonzero(done)
            f, n = runs(at[local], place[local])
            where = place[local][f]
            out = [(-1, chunk.id, _binary(where, "<i4"), b"", _binary(at[local][f] - chunk.bounds[where], "<i4"), _binary(n, "<i4"), b"", 0)] if len(f) else []
            rest = np.flatnonzero(~done)
            at, place, anchor = at[rest], place[rest], anchor[rest]
            f, n = runs(at, place, anchor)
            for b, i in _dealt((anchor[f] % U(buckets)).astype(np.int64)):
                length = n[i] + LENGTH - 1
                index = np.repeat(at[f[i]] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                where = place[f[i]]
                starts = at[f[i]] - chunk.bounds[where]
                out.append((b, chunk.id, _binary(where, "<i4"), _binary(chunk.docs[where], "<i8"), _binary(starts, "<i4"), _binary(n[i], "<i4"), chunk.buf[index].tobytes(), len(index)))
            if out:
                yield _table(out, OPEN)

    return run


#: A passage as seven words of eight bytes, of which the last overlaps.
WORDS = (0, 8, 16, 24, 32, 40, LENGTH - 8)


def sorted_passages(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` in the order of the passages that start there: by the first word, then ties by the next, and so on."""
    at = at[np.argsort(words[at])]
    group = np.cumsum(np.r_[False, words[at[1:]] != words[at[:-1]]]) if len(at) else at
    for k in WORDS[1:]:
        tied = np.r_[False, group[1:] == group[:-1]]
        tied[:-1] |= tied[1:]
        rest = np.flatnonzero(tied)
        if not len(rest):
            break
        word = words[at[rest] + k]
        order = np.lexsort((word, group[rest]))
        at[rest] = at[rest][order]
        new = np.zeros(len(at), dtype=bool)
        new[rest[1:]] = (np.diff(word[order]) != 0) & (group[rest[1:]] == group[rest[:-1]])
        group = group + np.cumsum(new)
    return at


def located(words: np.ndarray, among: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each passage at ``at`` the place of an equal one in the sorted ``among``, or -1: binary search, word by word."""
    first = words[among]
    low, high = np.searchsorted(first, words[at], "left"), np.searchsorted(first, words[at], "right")
    for k in WORDS[1:]:
        rest = np.flatnonzero(high - low > 1)
        want = words[at[rest] + k]
        for side in (0, 1):  # the first place not below the word, then the first above it
            a, b = low[rest].copy(), high[rest].copy()
            open_ = np.arange(len(rest))
            while len(open_):
                middle = (a[open_] + b[open_]) >> 1
                have = words[among[middle] + k]
                below = have < want[open_] if side == 0 else have <= want[open_]
                a[open_[below]] = middle[below] + 1
                b[open_[~below]] = middle[~below]
                open_ = open_[a[open_] < b[open_]]
            if side == 0:
                start = a
            else:
                low[rest], high[rest] = start, a
    place = np.where(high > low, low, -1)
    some = np.flatnonzero(place >= 0)
    same = np.ones(len(some), dtype=bool)
    for k in WORDS:
        same &= words[among[place[some]] + k] == words[at[some] + k]
    place[some[~same]] = -1
    return place


def _merge(last: bool):
    """Merges the open passages of some chunks: those with a hash that another document has too go on; of each hash the
    least document's passage enters one sorted array, in which all are searched. Passages that an earlier document has
    are done; the others stay open for chunks of other groups, unless this is the ``last`` round."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        take = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in part[c]]).astype(np.int64)
        place, doc, start, count = take("place", "<i4"), take("doc", "<i8"), take("start", "<i4"), take("count", "<i4")
        chunk = np.repeat(part["chunk_id"].to_numpy(), [len(b) // 4 for b in part["place"]])
        buf = np.frombuffer(b"".join(part["text"]), dtype=np.uint8)
        length = count + LENGTH - 1
        segment = np.repeat(np.arange(len(count)), count)
        step = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        at = np.r_[0, np.cumsum(length)[:-1]][segment] + step
        key, owner, words = rolling(buf, LENGTH)[at], doc[segment], words_at(buf, ">")
        order = np.argsort(key)
        ranked = key[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(owner[order], first)
        group = np.cumsum(new) - 1
        shared = np.maximum.reduceat(owner[order], first) > least
        owned, shared = owner[order] == least[group], shared[group]
        heads, seen = order[owned & shared], order[~owned & shared]  # the least document's own passages stay
        seen = seen[np.argsort(words[at[seen]])]  # in the order of the array, which a search then reads in passing
        heads = heads[np.r_[True, key[heads[1:]] != key[heads[:-1]]]] if len(heads) else heads
        among = sorted_passages(words, at[heads])
        owner_of = np.empty(len(buf), dtype=np.int64)
        owner_of[at[heads]] = owner[heads]
        found = located(words, among, at[seen])
        done = np.zeros(len(at), dtype=bool)
        known = found >= 0
        done[seen[known]] = owner[seen[known]] > owner_of[among[found[known]]]
        if not known.all():  # different passages with one hash: settle by their bytes
            clash = np.flatnonzero(np.isin(key, key[seen[~known]]))
            passages = [buf[at[i] : at[i] + LENGTH].tobytes() for i in clash]
            best: dict[bytes, int] = {}
            for i, p in zip(clash, passages, strict=True):
                best[p] = min(best.get(p, NOBODY), int(owner[i]))
            for i, p in zip(clash, passages, strict=True):
                done[i] = owner[i] > best[p]
        out = []
        for bucket, which in ((-1, done), (int(part["bucket"].iloc[0]), ~done)):
            hit = np.flatnonzero(which) if bucket < 0 or not last else np.zeros(0, np.int64)
            f, n = runs(start[segment[hit]] + step[hit], segment[hit])
            s, begin, here = segment[hit][f], (start[segment[hit]] + step[hit])[f], at[hit[f]] if len(f) else f
            for _, i in _dealt(chunk[s]):
                index = np.concatenate([np.arange(x, x + m + LENGTH - 1) for x, m in zip(here[i], n[i], strict=True)]) if bucket >= 0 else here[:0]
                out.append((bucket, int(chunk[s[i[0]]]), _binary(place[s[i]], "<i4"), _binary(doc[s[i]], "<i8"), _binary(begin[i], "<i4"), _binary(n[i], "<i4"), buf[index].tobytes(), len(index)))
        return pd.DataFrame(out, columns=[f.split(" ")[0] for f in OPEN.split(", ")])

    return run


def _by_passage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open passages one by one, each in the part of its bucket that its own hash gives."""
    for row in _rows(batches):
        take = lambda c, kind: np.frombuffer(row[c], kind).astype(np.int64)  # noqa: B023, E731
        place, doc, start, count = take("place", "<i4"), take("doc", "<i8"), take("start", "<i4"), take("count", "<i4")
        buf = np.frombuffer(row["text"], dtype=np.uint8)
        segment = np.repeat(np.arange(len(count)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        length = count + LENGTH - 1
        at = (np.cumsum(length) - length)[segment] + step
        parts = (rolling(buf, LENGTH)[at] % U(row["parts"])).astype(np.int64)
        out = []
        for part, i in _dealt(parts):
            text = buf[at[i][:, None] + np.arange(LENGTH)].tobytes()
            s = segment[i]
            out.append(((row["bucket"] + 1) * PARTS + part, row["chunk_id"], _binary(place[s], "<i4"), _binary(doc[s], "<i8"), _binary(start[s] + step[i], "<i4"), _binary(np.ones(len(i)), "<i4"), text, len(text)))
        yield _table(out, OPEN)


def _shrunk(opened: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Open passages in buckets of about ``MERGE_SHARE`` of text that one task each can take, and what is covered already.

    A bucket with much more, as of a passage that every chunk has, is merged in groups of chunks first: of equal passages
    one a group stays open, so rounds go on as long as they halve it. A bucket that they don't halve holds different
    passages around one anchor; these are dealt to parts by the hash of the whole passage, which equal ones share."""
    covered, before = [opened.where("bucket < 0")], {}
    opened = opened.where("bucket >= 0")
    while True:
        sizes = opened.groupBy("bucket").agg(F.sum("size").alias("volume")).where(F.col("volume") > 4 * MERGE_SHARE)
        heavy = {r["bucket"]: r["volume"] for r in sizes.collect()}  # a few buckets far above the mean
        halved = {b: v for b, v in heavy.items() if v <= before.get(b, v * 2) // 2}
        mixed = {b: v for b, v in heavy.items() if b not in halved and b < PARTS}
        if not halved and not mixed:
            return opened, covered
        before |= halved
        ways = [(b, -(-v // (2 * MERGE_SHARE)), 0) for b, v in halved.items()] + [(b, 0, -(-v * (LENGTH // 2) // MERGE_SHARE)) for b, v in mixed.items()]
        named = opened.sparkSession.createDataFrame(ways, "heavy long, groups long, parts long")
        dealt = opened.join(F.broadcast(named), F.col("bucket") == F.col("heavy"), "left")
        grouped = dealt.where("groups > 0").withColumn("part", F.pmod(F.xxhash64("chunk_id", F.lit(len(covered))), F.col("groups")))
        round_ = grouped.groupBy("bucket", "part").applyInPandas(_merge(False), OPEN)
        apart = dealt.where("parts > 0").mapInArrow(_by_passage, OPEN)
        after = saved(round_.unionByName(apart).unionByName(dealt.where("heavy IS NULL").drop("heavy", "groups", "parts")), "suffix-open")
        covered.append(after.where("bucket < 0"))
        opened = after.where("bucket >= 0")


def _merged(opened: DataFrame) -> DataFrame:
    """What is covered."""
    rest, covered = _shrunk(opened)
    out = rest.groupBy("bucket").applyInPandas(_merge(True), OPEN)
    for one in covered:
        out = out.unionByName(one)
    return out.select("chunk_id", "place", "start", "count")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        chunk, covers = Chunk(row), row["covers"] or []
        take = lambda c: np.frombuffer(b"".join(x[c] for x in covers), "<i4").astype(np.int64)  # noqa: B023, E731
        place, start, count = take("place"), take("start"), take("count")
        edge = np.zeros(len(chunk.buf) + 1, dtype=np.int64)
        np.add.at(edge, chunk.bounds[place] + start, 1)
        np.add.at(edge, chunk.bounds[place] + start + count + LENGTH - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = chunk.bounds[:-1][chunk.sizes > 0]
        opens[inner] = gone[inner]
        sums, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(opens)]
        rows = []
        for i, doc in enumerate(chunk.ids):
            low, high = chunk.bounds[i], chunk.bounds[i + 1]
            kept = chunk.buf[low:high][~gone[low:high]].tobytes()
            rows.append((doc, int(high - low), int(sums[high] - sums[low]), int(spans[high] - spans[low]), hashlib.sha256(kept).hexdigest(), kept))
        yield _table(rows, RESULT)


def suffix_dedup(docs: DataFrame, *, keep_bytes: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes that stay).

    Removes each byte covered by a 50-byte string that also starts in a document with a smaller doc_id; strings are
    judged on the input. Texts are UTF-8 bytes, null is empty, matches never cross documents. Rows with one doc_id do
    not repeat each other; rows without a doc_id neither lose bytes nor make others lose them. Other columns are ignored.

    Texts are written once in chunks, bucketed by chunk, so later joins on the chunk leave the text where it is. Anchors
    (least hash of the 26-byte windows in a passage) that more than one document has pick the regions that can repeat;
    equal passages have equal anchors, so nothing is missed. Each chunk sorts the suffixes of its regions and settles
    what repeats inside it; only passages of its least documents go on, to the bucket of their anchor. There the passages
    that several chunks have, as a hash tells, are sorted, one of each, and all are found among them by binary search on
    their bytes. A passage in any number of documents reaches a bucket once or so from each chunk, and a bucket that grows
    so is merged in rounds; one that different passages fill is cut by the passages' own hashes. A doc_id of another kind
    than a whole number is an error. One text is never cut: a task holds some fifty bytes a byte of the longest.
    """
    spark = docs.sparkSession
    texts = docs.select(whole_id(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = lambda part: int(max(1, -(-volume // part)))
    name = f"suffix_chunks_{uuid.uuid4().hex}"
    buckets = max(share(TABLE_SHARE), int(spark.conf.get("spark.sql.shuffle.partitions")))  # fewer, and a join would shuffle the text
    with small_batches(spark):
        written = texts.mapInArrow(_write_chunks, CHUNK).write.bucketBy(buckets, "chunk_id").option("compression", "zstd")
        written.option("path", new_path(spark, "suffix-chunks")).saveAsTable(name)  # for the buckets; the files are in the shared folder
    try:
        stored = spark.table(name)
        anchors = stored.mapInArrow(_anchors(share(ANCHOR_SHARE)), ANCHORS)
        repeated = anchors.groupBy("bucket").applyInPandas(_repeated, "chunk_id long, anchors binary")
        with small_batches(spark):
            repeated = saved(repeated, "suffix-anchors")
            release(spark)
            repeated = repeated.groupBy("chunk_id").agg(F.collect_list("anchors").alias("repeated"))
            opened = saved(stored.join(repeated, "chunk_id").mapInArrow(_open_passages(share(MERGE_SHARE)), OPEN), "suffix-open")
            release(spark)
            covered = saved(_merged(opened), "suffix-covered")
            release(spark)
            covers = covered.groupBy("chunk_id").agg(F.collect_list(F.struct("place", "start", "count")).alias("covers"))
            cut = stored.join(covers, "chunk_id", "left").mapInArrow(_cut, RESULT)
            return saved(cut if keep_bytes else cut.drop("kept"), "suffix-kept")
    finally:
        spark.sql(f"DROP TABLE {name}")

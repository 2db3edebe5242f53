"""Benchmark decontamination with a positional inverted index in document blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import ALNUM, chunks, lists
from .common import ascii_lower, new_path, saved, small_batches, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Text of one block of the index; more query terms than this and the index holds every term; windows searched at once.
BLOCK_BYTES = 2_000_000
MAX_TERMS = 1_000_000
MAX_WINDOWS = 200_000

#: Numbers of documents: a task, its blocks, a block's documents.
TASK, BLOCK = 2**40, 2**16

INDEX = "block long, doc_ids array<string>, n_words array<int>, terms array<binary>, counts array<int>, positions array<int>"
HITS = "phrases_at array<int>, phrases_size array<int>, phrases_window array<long>, nears_at array<int>, nears_window array<long>"
DOCUMENTS = "block long, doc_ids array<string>, n_words array<int>"
FOUND = "doc long, doc_id string, n_words long, n_hit long, phrase_starts array<int>, phrase_windows array<long>, near_starts array<int>, near_windows array<long>"
KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, KINDS[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))]


def _batch(values: list, schema: str) -> pa.RecordBatch:
    """One row of ``values``."""
    fields = _fields(schema)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(values, fields, strict=True)], [n for n, _ in fields])


def _index_block(wanted: dict[bytes, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() * TASK
        for k, (batch, texts) in enumerate(chunks(batches, "text", BLOCK_BYTES)):
            ids = dict(wanted) if wanted is not None else {}
            codes, lengths = [], []
            for text in texts:
                words = text.translate(ALNUM).split()
                lengths.append(len(words))
                if wanted is None:
                    for w in words:
                        ids.setdefault(w, len(ids))
                codes.append(np.fromiter((ids.get(w, -1) for w in words), np.int32, len(words)))
            stream = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            at = np.flatnonzero(stream >= 0)
            order = np.argsort(stream[at], kind="stable")
            present, counts = np.unique(stream[at], return_counts=True)
            names = list(ids)
            yield _batch([task + k * BLOCK, batch.column("doc_id").to_pylist(), lengths, [names[t] for t in present], counts, at[order].astype(np.int32)], INDEX)

    return run


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The stored index: a row per block of documents with the block's word count for each document and, for every term
    that occurs, its positions in the block's run of words. ``terms`` (a column ``term``, binary) restricts it to the
    words that will be asked for, unless there are more than ``MAX_TERMS`` of them."""
    wanted = None
    if terms is not None:
        rows = terms.select("term").distinct().limit(MAX_TERMS + 1).collect()  # at most MAX_TERMS words of the query set
        wanted = {bytes(r["term"]): i for i, r in enumerate(rows)} if len(rows) <= MAX_TERMS else None
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        return saved(texts.mapInArrow(_index_block(wanted), INDEX), "positional-index")


def windows_of(items: DataFrame, size: int = 10) -> DataFrame:
    """``(window, words, item_id)``: the windows of ``size`` consecutive words of the items, or all words of an item that
    has fewer, a row per item that holds one. A null item_id reads as an empty one."""
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.regexp_extract_all(ascii_lower(text_of()), F.lit(WORD), F.lit(0)).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    each = saved(words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words")).distinct(), "item-windows")
    numbered = saved(each.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return each.join(numbered, "words").select("window", "words", "item_id")


def _search(windows: list[tuple[int, list[bytes]]], frequency: dict[bytes, int], near: int, least: float, every: bool):
    """Hits of ``windows`` in each block, with its documents if ``every`` block is reported; else of blocks with hits, alone."""
    ids = {w: i for i, w in enumerate(frequency)}
    freq = np.array([*frequency.values(), np.iinfo(np.int64).max], dtype=np.int64)  # words that no document has come last
    by_size: dict[int, list[int]] = {}
    for i, (_, words) in enumerate(windows):
        if any(w in ids for w in words):
            by_size.setdefault(len(words), []).append(i)
    groups = []
    for size, members in by_size.items():
        codes = np.array([[ids.get(w, -1) for w in windows[i][1]] for i in members], dtype=np.int32)
        groups.append((size, np.array([windows[i][0] for i in members]), codes, np.argsort(freq[codes], axis=1, kind="stable")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {c: batch.column(c)[row] for c in batch.schema.names}
                hits = _search_block(block, ids, groups, near, least)
                if every:
                    yield _batch([block[c].as_py() for c, _ in _fields(DOCUMENTS)] + hits, f"{DOCUMENTS}, {HITS}")
                elif len(hits[0]) or len(hits[3]):
                    yield _batch([block["block"].as_py(), *hits], f"block long, {HITS}")

    return run


def _search_block(block, ids, groups, near, least) -> list[np.ndarray]:
    """Position, size and window of the exact matches, position and window of the near ones, in one block."""
    n_words = block["n_words"].values.to_numpy().astype(np.int64)
    counts = block["counts"].values.to_numpy().astype(np.int64)
    positions = block["positions"].values.to_numpy().astype(np.int64)
    terms = np.array([ids.get(t, -1) for t in block["terms"].as_py()], dtype=np.int64)
    gap = max((size for size, *_ in groups), default=0) + near  # between documents, so that nothing matches across them
    before = np.repeat(np.arange(1, len(n_words) + 1) * gap, n_words)  # empty places ahead of a word
    positions = positions + before[positions]
    first = np.r_[0, np.cumsum(counts)]
    start_of, length_of = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64)
    known = terms >= 0
    start_of[terms[known]], length_of[terms[known]] = first[:-1][known], counts[known]
    stream = np.full(n_words.sum() + (len(n_words) + 2) * gap + 1, -2, dtype=np.int32)  # place -> term: tests membership in a posting list
    stream[positions] = np.repeat(terms, counts).astype(np.int32)
    stream[stream == -1] = -2
    back = np.full(len(stream), 0, dtype=np.int64)
    back[np.arange(len(before)) + before] = np.arange(len(before))
    out = [[] for _ in range(5)]
    for size, members, codes, rarest in groups:
        pick, anchor = np.arange(len(members)), rarest[:, 0]
        lists = length_of[codes[pick, anchor]]
        anchors = np.repeat(pick, lists)
        index = np.repeat(start_of[codes[pick, anchor]] - np.r_[0, np.cumsum(lists)[:-1]], lists) + np.arange(lists.sum())
        starts = positions[index] - anchor[anchors]  # of the window, if all its words stood in their places
        which, at = anchors, starts
        for k in range(1, size):  # the other lists, rarest first, moved back by their place in the window
            offset = rarest[which, k]
            keep = stream[at + offset] == codes[which, offset]
            which, at = which[keep], at[keep]
        for column, x in zip(out, (back[at], np.full(len(at), size), members[which]), strict=False):
            column.append(x)
        if not near:
            continue
        if size > 1:
            which, at, missing = anchors, starts, np.zeros(len(starts), np.int64)
            spare = size - int(np.ceil(least * size))
            for k in range(1, size):
                offset = rarest[which, k]
                code, place = codes[which, offset], at + offset
                missing += ~np.logical_or.reduce([stream[place + j] == code for j in range(-near, near + 1)])
                keep = missing <= (spare if k > 1 else 0)
                which, at, missing = which[keep], at[keep], missing[keep]
        out[3].append(back[at + rarest[which, 0]])
        out[4].append(members[which])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            block = {c: batch.column(c)[row] for c in batch.schema.names}
            take = lambda c: block[c].values.to_numpy().astype(np.int64)  # noqa: B023, E731
            n_words, at = take("n_words"), take("phrases_at")
            bounds = np.r_[0, np.cumsum(n_words)]
            edge = np.zeros(bounds[-1] + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + take("phrases_size"), -1)
            marked = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
            columns = [pa.array(block["block"].as_py() + np.arange(len(n_words))), block["doc_ids"].values, pa.array(n_words), pa.array(marked[bounds[1:]] - marked[bounds[:-1]])]
            for kind in ("phrases", "nears"):
                place, window = take(f"{kind}_at"), take(f"{kind}_window")
                order = np.lexsort((window, place))
                place, window = place[order], window[order]
                cut = np.searchsorted(place, bounds[:-1])
                starts = place - np.repeat(bounds[:-1], np.diff(np.r_[cut, len(place)]))
                split = lambda x: np.split(x, cut[1:])  # noqa: B023, E731
                columns += [lists(split(starts), pa.int32()), lists(split(window), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c for c, _ in _fields(FOUND)])


def search_index(index: DataFrame, windows: DataFrame, near: int = 0, least: float = 0.8) -> DataFrame:
    """A row per document: ``doc`` (its number), ``doc_id, n_words, n_hit``, offsets and numbers of the windows that
    occur (``phrase_starts``, ``phrase_windows``), and of those that occur nearly (``near_``), from ``(window, words)``.

    A window starts from the posting list of its rarest term in the whole corpus and is checked against the next
    rarest in turn. With ``near``, a window also occurs nearly where its two rarest words that the corpus has, and
    ``least`` of all its words, stand at most ``near`` words off their places to the rarest one; ``near_starts`` has that
    one's place. Tasks hold ``MAX_WINDOWS`` windows or so at a time; more are searched in rounds, which read the index
    and write a narrow row of hits for each block that has some. The index is never written again; all rounds' hits are
    brought to their blocks once.
    """
    numbered = saved(windows.select("window", F.transform("words", lambda w: w.cast("binary")).alias("words")).distinct(), "windows")
    rounds = max(1, -(-numbered.count() // MAX_WINDOWS))
    counted = F.explode(F.arrays_zip("terms", "counts")).alias("t")
    sums = index.select(counted).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))
    path = new_path(index.sparkSession, "search-hits")
    for k in range(rounds):
        part = numbered.where(F.pmod(F.xxhash64("words"), F.lit(rounds)) == k)
        terms = part.select(F.explode("words").alias("term")).distinct()
        frequency = {bytes(r["term"]): r["n"] for r in sums.join(terms, "term").collect()}  # terms of this round's windows
        rows = [(r["window"], [bytes(w) for w in r["words"]]) for r in part.collect()]  # MAX_WINDOWS or so
        if rounds == 1:
            state = index.mapInArrow(_search(rows, frequency, near, least, True), f"{DOCUMENTS}, {HITS}")
            break
        index.mapInArrow(_search(rows, frequency, near, least, False), f"block long, {HITS}").write.mode("append").parquet(path)
    else:
        names = [c for c, _ in _fields(HITS)]
        hits = index.sparkSession.read.schema(f"block long, {HITS}").parquet(path)
        hits = hits.groupBy("block").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in names])  # of one block's text
        state = index.select(*[c for c, _ in _fields(DOCUMENTS)]).join(hits, "block", "left")
        state = state.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in (f.split(" ") for f in HITS.split(", "))})
    return state.mapInArrow(_report, FOUND)


def contaminated(docs: DataFrame, items: DataFrame, *, size: int = 10, near: int = 0, least: float = 0.8) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, n_words, n_hit``, the ``items`` (``item_id, text``) of which a window of ``size``
    words occurs, ``phrase_starts``, and with ``near`` the ``near_items`` of which one occurs nearly, and ``near_starts``.

    Words are runs of characters other than ASCII ones that are neither letter nor digit, A-Z lower-cased. A null or
    wordless text has no words and no hits; a doc_id may be of any type; an item without words has no window; rows that repeat a doc_id or have
    none are searched like any other; a text of any length is one piece of a block. Other columns are ignored.

    Only windows reach the tasks of the search; which items hold a window is joined to what was found.
    """
    windows = saved(windows_of(items, size), "item-windows")
    terms = windows.select(F.explode(F.transform("words", lambda w: w.cast("binary"))).alias("term"))
    with small_batches(docs.sparkSession):
        found = saved(search_index(build_index(docs, terms), windows.select("window", "words"), near, least), "window-hits")
    found = found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    holders = windows.select("window", "item_id")
    out = found.select("doc", "doc_id", "n_words", "n_hit", "phrase_starts", "near_starts")
    for kind, name in (("phrase", "items"), ("near", "near_items")):
        hits = found.select("doc", F.explode(F.array_distinct(f"{kind}_windows")).alias("window"))
        named = hits.join(holders, "window").groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias(name))
        out = out.join(named, "doc", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.drop("doc")

"""Grouping of spelling variants with a bit-sliced position index over blocks of the vocabulary."""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks
from .common import saved, small, small_batches

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
CHUNK_BYTES = 1_000_000
#: Distinct words that a task counts before it sends them on.
FLUSH_WORDS = 200_000
#: Pieces of a word have at most so many letters, but a word has at most so many pieces.
PIECE, PIECES = 16, 64
#: Words that share a key are compared as one bucket up to so many; a larger one is cut by pieces of FINE letters. Words of a
#: fine bucket differ in two letters, so its size is bounded by the square of the alphabet.
BUCKET_WORDS, FINE = 2048, 2

PART = "key string, size int, id long, n long, middle string, guard string"
NEAR = "id long, n_near long, best_n long, best_id long"


def _table(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _counted(shortest: int, typo_every: int | None):
    """Counts of the words of a task's texts, with a letter left out of some, as the docstring of ``vocabulary`` says."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        flush = lambda: _table([list(counts), list(counts.values())], "word string, n long")
        for batch, texts in chunks(batches, "text", CHUNK_BYTES):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                found = Counter(runs.findall(text.decode("utf-8").translate(LOWER)))
                if typo_every is None:
                    counts.update(found)
                else:
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                        counts[word] += n
                if len(counts) > FLUSH_WORDS:
                    yield flush()
                    counts.clear()
        yield flush()

    return run


def vocabulary(docs: DataFrame, *, shortest: int = 7, least: int = 2, typo_every: int | None = None) -> DataFrame:
    """``(id, word, n)``: runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least ``shortest`` code
    points and ``least`` occurrences in all texts; ids follow the words' code-point order.

    With ``typo_every``, a run loses a letter where that number divides h, the crc32 of ``<doc_id>:<run>``: the one at h
    modulo the run's length. Tasks count first, so a frequent word is one row a task."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        counted = saved(texts.mapInArrow(_counted(shortest, typo_every), "word string, n long"), "spelling-counts")
    words = saved(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "spelling-words")
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    return saved(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-vocabulary")


def _cut(key: str, text: str, size: int, step: int, guard: str) -> Iterator[tuple[str, int, str, str]]:
    """Key, size, middle and guard of each piece of a ``text`` that has ``size`` letters, or one fewer (a short one).

    A piece covers letters ``a`` to ``b`` of the longer text; the key holds the letters before it and, counted from the end,
    those behind it, so that both of a pair whose one edit lies in the piece have it. The guard is the letter behind the
    middle."""
    for a in range(0, size, step):
        b = min(a + step, size)
        end = len(text) - (size - b)
        whole = f"{key}{size}:{a}:{text[:a]}\0{text[end:]}"
        if len(whole) > 40:
            whole = "#" + hashlib.blake2b(whole.encode(), digest_size=16).hexdigest()
        yield whole, b - a, text[a:end], text[end : end + 1] or guard


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of every word, as the longer and as the shorter text of a pair."""
    for batch in batches:
        columns = [[] for _ in range(6)]
        for i, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
            for size in (len(word), len(word) + 1):
                step = min(max(PIECE, -(-size // PIECES)), -(-size // 2))
                for key, s, middle, guard in _cut("", word, size, step, ""):
                    for column, x in zip(columns, (key, s, i, n, middle, guard), strict=True):
                        column.append(x)
            if len(columns[0]) > 50_000:
                yield _table(columns, PART)
                columns = [[] for _ in range(6)]
        yield _table(columns, PART)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [[] for _ in range(6)]
        for key, size, i, n, middle, guard in zip(*(batch.column(f.split(" ")[0]).to_pylist() for f in PART.split(", ")), strict=True):
            for fine, s, inner, behind in _cut(key + "\1", middle, size, FINE, guard):
                for column, x in zip(columns, (fine, s, i, n, inner, behind), strict=True):
                    column.append(x)
        yield _table(columns, PART)


def bit_planes(letters: np.ndarray, codes: int) -> np.ndarray:
    """Bitsets over the rows of ``letters``, one for each position and letter: ``planes[position, letter]``."""
    rows, width = letters.shape
    words = -(-rows // 64)
    planes = np.zeros((width, codes, words * 64), dtype=bool)
    planes[np.arange(width)[None, :], letters, np.arange(rows)[:, None]] = True
    return np.packbits(planes, axis=2, bitorder="little").view(np.uint64).reshape(width, codes, words)


def _bits(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit number of the ones in an array of bitsets."""
    row, word = np.nonzero(planes)
    bit = np.unpackbits(planes[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, b = np.nonzero(bit)
    return row[k], word[k] * 64 + b


def near_pairs(bucket: np.ndarray, size: np.ndarray, middles: list[str], guards: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs of rows of one bucket whose texts are one replaced letter apart (both of ``size`` letters) or one
    letter more or less; a pair that a later piece finds too is left to that one.

    For all words of the block at once, a query's letters move two recurrences on: the words equal so far, and those with
    one error, a letter replaced (positions agree) or left out (the other's positions are one behind). A step is a few
    operations on bitsets: the plane of the position and letter, and the planes of the position before.
    """
    rows, width = len(middles), int(size.max())
    text = "".join((m + g).ljust(width, "\0")[:width] for m, g in zip(middles, guards, strict=True))
    alphabet, letters = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
    letters = letters.reshape(rows, width)
    planes = bit_planes(letters, len(alphabet))
    long = np.array([len(m) for m in middles]) == size
    names, bucket = np.unique(bucket, return_inverse=True)
    same = bit_planes(bucket[:, None], len(names))[0]
    longs = bit_planes(long.astype(np.int64)[:, None], 2)[0]
    left, right = [], []
    for s in np.unique(size[long]) if long.any() else []:
        queries = np.flatnonzero(long & (size == s))
        equal = same[bucket[queries]]
        replaced = lacking = np.zeros_like(equal)
        for i in range(s):
            letter = letters[queries, i]
            here = planes[i, letter]
            replaced = (replaced & here) | (equal & ~here)
            lacking = ((lacking & planes[i - 1, letter]) | equal) if i else equal
            equal = equal & here
        q, other = _bits(replaced & longs[1])
        left.append(queries[q])
        right.append(other)
        q, other = _bits(lacking & longs[0] & ~equal)
        left += [queries[q], other]
        right += [other, queries[q]]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and best of the near words that each word meets, from rows in the order of their keys."""

    def block(rows: list[list]) -> pa.RecordBatch:
        keys, size, ids, n, middles, guards = rows
        ids, n = np.array(ids), np.array(n)
        a, b = near_pairs(np.array(keys), np.array(size), middles, guards)
        order = np.lexsort((ids[b], -n[b], ids[a]))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, ids[a][1:] != ids[a][:-1]][: len(a)])
        return _table([ids[a[first]], np.diff(np.r_[first, len(a)]), n[b[first]], ids[b[first]]], NEAR)

    rows: list[list] = [[] for _ in range(6)]
    for batch in batches:
        columns = [batch.column(f.split(" ")[0]).to_pylist() for f in PART.split(", ")]
        keys = columns[0]
        starts = [i for i in range(len(keys)) if keys[i] != (keys[i - 1] if i else (rows[0] or [None])[-1])]
        low = 0
        for cut in [*starts, len(keys)]:
            for row, column in zip(rows, columns, strict=True):
                row += column[low:cut]
            low = cut
            if cut < len(keys) and len(rows[0]) >= BUCKET_WORDS:
                yield block(rows)
                rows = [[] for _ in range(6)]
    if rows[0]:
        yield block(rows)


def near_words(words: DataFrame) -> DataFrame:
    """``(id, n_near, best_n, best_id)`` for the words of ``(id, word, n)`` that have a near one, exactly one insertion,
    deletion or replacement of a code point away: how many, and the most frequent (ties: the smallest id).

    A pair with one edit agrees before and behind the piece of the word in which the edit lies, so words meet under keys
    made of all but one piece, halves as a rule; the pair counts in the piece where its common prefix ends, once. Rows
    of a key that holds over ``BUCKET_WORDS`` words are cut into finer pieces before anything is shuffled, so no key is hot
    however many words begin alike. Tasks take rows in the order of their keys, pack whole buckets into blocks and
    compare a block's words by bitsets; only a row for each word leaves a block."""
    parts = saved(words.mapInArrow(_parts, PART), "spelling-parts")
    hot = saved(parts.groupBy("key").count().where(F.col("count") > BUCKET_WORDS).select("key", F.lit(True).alias("hot")), "spelling-hot")
    marked = parts.join(small(hot), "key", "left")
    fine = marked.where("hot").drop("hot").mapInArrow(_finer, PART)
    dealt = marked.where("hot is null").drop("hot").unionByName(fine)
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = saved(dealt.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_matched, NEAR), "spelling-near")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_id").alias("id")))
    near = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return near.select("id", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.id").alias("best_id"))


def roots(forms: DataFrame) -> DataFrame:
    """``(id, root_id)`` from ``(id, form_id)``, which has no cycle: pointers are doubled until all stand at a last form."""
    at = saved(forms.select("id", F.col("form_id").alias("root_id")), "spelling-roots")
    while True:
        jump = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        moved = saved(at.join(jump, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("id", "root_id")
        if not moved.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, *, shortest: int = 7, least: int = 2, ratio: int = 10, typo_every: int | None = None) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of the ``vocabulary`` of ``docs`` (``doc_id, text``).

    Two words are near if one code point inserted, deleted or replaced makes one the other. ``form`` is the near word with
    the most occurrences (ties: smallest in code-point order) if it has at least ``ratio`` times the word's own, else null;
    ``root`` is the last of the forms that follow from there, or the word. Null and empty texts have no words; a text, and
    a word, of any length is taken whole; repeated rows count as often as they stand there; a null doc_id reads as an empty
    one. Other columns are ignored. An empty table gives no rows."""
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants: ratio is 2 or more")
    words = vocabulary(docs, shortest=shortest, least=least, typo_every=typo_every)
    near = saved(near_words(words), "spelling-best")
    ranked = words.join(near, "id", "left").withColumn("formed", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    ranked = saved(ranked, "spelling-ranked")
    last = roots(ranked.where("formed").select("id", F.col("best_id").alias("form_id")))
    forms = ranked.where("formed").join(last, "id").select("id", F.col("best_id").alias("form_id"), "root_id")
    named = lambda c: words.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    forms = saved(forms.join(named("form"), "form_id").join(named("root"), "root_id").select("id", "form", "root"), "spelling-forms")
    return ranked.join(forms, "id", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form",
        F.when(F.col("formed"), F.col("best_n")).alias("form_n"),
        F.coalesce("root", "word").alias("root"),
    )

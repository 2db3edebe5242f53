"""Importance resampling of documents towards a target distribution over hashed word runs."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import ALNUM, chunks, lists
from .common import saved, small_batches

CHUNK_BYTES = 1_000_000
#: Frequent words, and as many pairs, that are broadcast with their checksums; only speed depends on them.
HEAD = 50_000
#: A task looks at so many words at a time for frequent ones, and sends those on that are one in ``SHARE`` there at least.
SPAN_WORDS, SHARE = 1_000_000, 100_000

FEATURES = "n_words long, buckets array<int>"


def _frequent(pairs: bool):
    """Words (and pairs, joined by a space) with a share of one in ``SHARE`` of a span of a task's words: whatever has that
    share of the corpus has it in some span. A row is ``term, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        seen = 0

        def flush() -> pa.RecordBatch:
            kept = [(t, n) for t, n in counts.items() if n * SHARE >= seen]
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["term", "n"])

        for _, texts in chunks(batches, "text", CHUNK_BYTES):
            for text in texts:
                words = text.translate(ALNUM).split()
                counts.update(words)
                if pairs:
                    counts.update(map(b" ".join, zip(words, words[1:], strict=False)))
                seen += len(words)
            if seen >= SPAN_WORDS:
                yield flush()
                counts.clear()
                seen = 0
        yield flush()

    return run


def head_terms(texts: DataFrame, pairs: bool, head: int = HEAD) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Checksums of the ``head`` most frequent words and of as many pairs in all ``texts``."""
    counted = saved(texts.mapInArrow(_frequent(pairs), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")), "resample-frequent")
    pair = F.instr(F.decode("term", "ISO-8859-1"), " ") > 0
    out = []
    for which in (~pair, pair):
        rows = counted.where(which).orderBy(F.desc("n"), "term").limit(head).collect()  # at most ``head`` terms
        out.append({bytes(r["term"]): zlib.crc32(r["term"]) for r in rows})
    return out[0], out[1]


def _features(n: int, buckets: int, words_head: dict[bytes, int], pairs_head: dict[bytes, int]):
    """Buckets of every feature of a text. A word's checksum comes from the broadcast ones or directly, and goes on over
    the next word for longer runs; frequent pairs are looked up as wholes."""
    state, pair_state, crc = words_head.get, pairs_head.get, zlib.crc32

    def hashed(text: bytes) -> tuple[int, np.ndarray]:
        words = text.translate(ALNUM).split()
        states = [state(w) or crc(w) for w in words]
        runs = [states]
        for k in range(2, n + 1):
            behind = words[k - 1 :]
            if k == 2:
                states = [pair_state(a + b" " + b) or crc(b" " + b, s) for a, b, s in zip(words, behind, states, strict=False)]
            else:
                states = [crc(b" " + b, s) for b, s in zip(behind, states, strict=False)]
            runs.append(states)
        return len(words), np.concatenate([np.array(r, dtype=np.int64) % buckets for r in runs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", CHUNK_BYTES):
            found = [hashed(t) for t in texts]
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.int64()), lists([f[1] for f in found], pa.int32())], [*names, "n_words", "buckets"])

    return run


def _totals(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    return run


def bucket_totals(featured: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: a task sends its own sums, the driver gets ``buckets`` rows."""
    sums = featured.select("buckets").mapInArrow(_totals(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to that in the corpus, one added to each count."""
    ratio = (target + 1.0) * float(corpus.sum() + len(corpus)) / ((corpus + 1.0) * float(target.sum() + len(target)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("buckets")
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            sums = np.r_[0, np.cumsum(gain[column.flatten().to_numpy()])]
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            weight = np.where(sizes > 0, total // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(sizes), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` (a saved table) with ``rank``, 1 and up in the given order: a range exchange deals them to sorted partitions,
    the row's place there and the sizes of the partitions before give its rank."""
    row = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(row, 33).cast("int"), "_place": row.bitwiseAND(F.lit(2**33 - 1))})
    placed = saved(placed, "resample-ranked")
    before, starts = 0, []
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        starts.append((r["_part"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def importance_resample(
    docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int | str = 2024, head: int = HEAD
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_features, weight, score, rank``; ``rank`` is 1, 2, ... for
    the ``percent`` hundredths of the documents of ``least_words`` or more that are drawn, null for the others.

    Features are the runs of 1 to ``n`` words (characters other than ASCII ones that are neither letter nor digit; A-Z
    lower-cased), a run's bucket the crc32 of its words joined by a space, modulo ``buckets``. A bucket's gain compares its
    counts in all texts of ``docs`` and of ``target`` (a column ``text``); ``weight`` is the floored mean of the gains of a
    text's features, and a Gumbel number from the sha256 of ``<seed>:<doc_id>`` is added, so that the highest scores are a
    draw without replacement. Ties go to the smaller doc_id.

    Frequent words and pairs are broadcast with their checksums, at most ``head`` of each; other features are hashed
    directly, so totals are exact whatever is in the head. Features are hashed once and written as bucket numbers, from
    which totals and weights are taken. Null and empty texts have no features and weight 0; an empty target has no
    counts; texts of any length are taken whole; rows that repeat a doc_id are documents of their own with the same
    number; a null doc_id hashes as an empty one and comes last among ties. Other columns are ignored."""
    spark = docs.sparkSession
    as_bytes = F.col("text").cast("string").cast("binary").alias("text")
    ours, theirs = docs.select("doc_id", as_bytes), target.select(as_bytes)
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FEATURES}"
    with small_batches(spark):
        terms = head_terms(ours.select("text").unionByName(theirs), n > 1, head)
        featured = saved(ours.mapInArrow(_features(n, buckets, *terms), fields), "resample-features")
        aimed = saved(theirs.mapInArrow(_features(n, buckets, *terms), FEATURES), "resample-target")
        gain = gains(bucket_totals(featured, buckets), bucket_totals(aimed, buckets))
        weighed = featured.mapInArrow(_weights(gain), f"{fields.split(',')[0]}, n_words long, n_features long, weight long")
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
        noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
        scored = saved(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    fit = F.col("n_words") >= least_words
    wanted = percent * scored.where(fit).count() // 100
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    placed = ranked(scored.where(fit).drop("n_words"), *order)
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    out = drawn.unionByName(scored.where(~fit).drop("n_words").withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")

"""Exact deduplication with a two-pass Bloom filter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, new_path, saved, small, text_of

#: Bits of one bitmap of ``bitmap_construct_agg``.
BUCKET_BITS = 32768
#: Digests that one task deals to the folders of several filters.
COPY_ROWS = 25_000_000


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """First pass: ``(bucket, bits)``, bitmaps of the slots that ``digests`` (``sha``) sets more than once.

    Bitmaps merged by OR forget whether a bit was set twice, so slots are counted: a task counts its own first, then one
    narrow number moves for each slot it saw, of a hot digest too. Only slots that repeat become bits.
    """
    slots = digests.select(F.pmod(F.xxhash64("sha"), F.lit(bits)).alias("slot"))
    twice = slots.groupBy("slot").count().where("count > 1")
    return twice.groupBy(F.expr(f"slot div {BUCKET_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BUCKET_BITS).alias("bits"))


def flagged(digests: DataFrame, bits: int, repeated: DataFrame) -> DataFrame:
    """Second pass: ``digests`` (``doc_id, sha``) with ``maybe``: is its slot in the broadcast filter? No row moves."""
    slotted = digests.withColumn("slot", F.pmod(F.xxhash64("sha"), F.lit(bits)))
    at = F.expr(f"slot % {BUCKET_BITS}")
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(slot % {BUCKET_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    joined = slotted.join(F.broadcast(repeated), F.expr(f"slot div {BUCKET_BITS}") == F.col("bucket"), "left")
    return joined.select("doc_id", "sha", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("maybe"))


def by_range(digests: DataFrame, ranges: int, rows: int) -> DataFrame:
    """``digests`` with ``range``, a folder for each. Few large tasks write them, as each has a file in every folder."""
    tasks = max(digests.sparkSession.sparkContext.defaultParallelism, -(-rows // COPY_ROWS))
    path = new_path(digests.sparkSession, "exact-ranges")
    digests.withColumn("range", F.pmod(F.hash("sha"), F.lit(ranges))).coalesce(tasks).write.partitionBy("range").option("compression", "zstd").parquet(path)
    return digests.sparkSession.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in digests.schema)}, range int").parquet(path)


def exact_dedup(docs: DataFrame, *, bits_per_row: int = 32, filter_bits: int = 2**30) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
    largest ``doc_id`` stays. Rows that repeat that doc_id are the same document and all stay marked ``kept``; a null
    doc_id is smaller than any other. A text of any length is digested in its row. Other columns are ignored.

    First pass: each digest sets a slot of a Bloom filter with ``bits_per_row`` bits a row; slots set twice are kept.
    Second pass: rows whose slot is in the filter may be repeated, and only those shuffle on the digest; about one in
    ``bits_per_row`` of the others goes with them, the rest are unique for certain and pass straight through.

    A filter has ``filter_bits`` bits at most (128 MB, the bound of what is broadcast). More digests are split by a range
    of their hashes into as many filters as keep the bits a row; the table of digests is then dealt to a folder for each
    range, by a copy without a shuffle, so that each filter reads its own rows and all together read the table once.
    """
    rows = saved(docs.select("doc_id", F.unhex(F.sha2(ascii_lower(text_of()), 256)).alias("sha")), "exact-digests")
    wanted = rows.count() * bits_per_row
    ranges = max(1, math.ceil(wanted / filter_bits))
    bits = max(1, math.ceil(wanted / ranges / BUCKET_BITS)) * BUCKET_BITS
    if ranges > 1:
        rows = by_range(rows, ranges, wanted // bits_per_row)
    path = new_path(rows.sparkSession, "exact-maybe")
    for k in range(ranges):
        part = rows.where(F.col("range") == k) if ranges > 1 else rows
        flagged(part, bits, saved(repeated_slots(part, bits), "exact-filter")).write.mode("append").parquet(path)
    marked = rows.sparkSession.read.schema("doc_id {}, sha binary, maybe boolean".format(dict(docs.dtypes)["doc_id"])).parquet(path)

    maybe = marked.where("maybe")
    groups = maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    resolved = maybe.join(small(saved(groups, "exact-groups")), "sha", "left")
    known = F.col("group_size").isNotNull()
    resolved = resolved.select("doc_id", F.when(known, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha")
    unique = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return unique.unionByName(resolved).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, saved, text_of

#: At most so many cells of the ring are counted, sent to the driver and broadcast back.
MAX_CELLS = 131_072
#: Rows that repeat id, size and checksum up to so often are numbered by one task; more are cut into parts of this size.
COPIES = 100_000


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes (signed 64 bits, ascending) and the shard of each. A shard's nodes depend on its
    number alone, so another shard moves none of them."""
    at = [(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(nodes)]
    at.sort()
    return np.array([p for p, _ in at], dtype=np.int64), np.array([s for _, s in at], dtype=np.int64)


def bounded_loads(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(cell, from rank, to rank, shard, first slot)`` that fill every shard up to its capacity.

    Cells stand in ring order. A shard first takes the keys of its own cells, clockwise, while it has room; keys beyond
    continue clockwise to the next node whose shard is not full.
    """
    used, pieces, over = np.zeros_like(capacity), [], []

    def put(cell: int, low: int, n: int, shard: int) -> None:
        pieces.append((cell, low, low + n, int(shard), int(used[shard])))
        used[shard] += n

    for cell in np.flatnonzero(counts):
        n = int(counts[cell])
        fits = min(n, int(capacity[owner[cell]] - used[owner[cell]]))
        if fits:
            put(int(cell), 0, fits, owner[cell])
        if fits < n:
            over.append((int(cell), fits, n))
    for cell, low, high in over:
        step = cell
        while low < high:
            step = (step + 1) % len(owner)
            fits = min(high - low, int(capacity[owner[step]] - used[owner[step]]))
            if fits > 0:
                put(cell, low, fits, owner[step])
                low += fits
    return pieces


def ranges(docs: DataFrame, *, shards: int = 16, nodes: int = 64, cell_rows: int = 20_000, slack: float = 0.0) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, first_slot, first_copy, n)``: ``n`` rows of one id, size and checksum that take
    neighbouring slots of a shard, counted from ``first_copy`` among all such rows.

    The ring is cut at the nodes and then evenly into cells of about ``cell_rows`` keys, ``MAX_CELLS`` at most. Equal rows
    are counted before the shuffle, so a row repeated without end is one entry with a count. Cell counts decide how many
    rows of each cell every shard takes; entries are ranked within their cell only, so no task holds a shard.
    """
    spark = docs.sparkSession
    at, shard_of = ring(shards, nodes)
    rows = docs.count()
    parts = int(min(max(1, -(-rows // (cell_rows * len(at)))), MAX_CELLS // len(at)))

    @F.pandas_udf("int")
    def cell(position: pd.Series) -> pd.Series:
        where = position.to_numpy()
        arc = np.searchsorted(at, where, side="left") % len(at)  # the next node clockwise
        start = np.where(arc == 0, at[-1], at[arc - 1])
        width = (at[arc].astype(np.uint64) - start.astype(np.uint64)).astype(np.float64)
        gone = (where.astype(np.uint64) - start.astype(np.uint64)).astype(np.float64)
        inner = np.minimum((gone / np.maximum(width, 1.0) * parts).astype(np.int64), parts - 1)
        return pd.Series((arc * parts + inner).astype(np.int32))

    keyed = docs.select(
        "doc_id",
        (F.octet_length(text_of()).cast("long") + 1).alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
        F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.crc32(text_of()))).alias("position"),
    )
    keyed = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))
    keyed = saved(keyed.withColumn("cell", cell("position")), "ring-keys")
    counts = np.zeros(len(at) * parts, dtype=np.int64)
    for r in keyed.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most MAX_CELLS rows
        counts[r["cell"]] = r["n"]
    total = int(counts.sum())
    if slack:
        capacity = np.full(shards, int(np.ceil((1 + slack) * total / shards)), dtype=np.int64)
    else:
        capacity = total // shards + (np.arange(shards) < total % shards).astype(np.int64)
    pieces = bounded_loads(counts, np.repeat(shard_of, parts), capacity)
    cells = spark.createDataFrame(pieces, "piece_cell int, low long, high long, shard int, first_slot long")
    before = Window.partitionBy("cell").orderBy("position", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = (F.col("cell") == F.col("piece_cell")) & (F.col("rank") < F.col("high")) & (F.col("rank") + F.col("n") > F.col("low"))
    start, end = F.greatest("rank", "low"), F.least(F.col("rank") + F.col("n"), F.col("high"))
    return ranked.join(F.broadcast(cells), hit).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("first_slot") + start - F.col("low")).alias("first_slot"), (start - F.col("rank")).alias("first_copy"), (end - start).alias("n"),
    )


def _each(found: DataFrame, step: int = COPIES) -> DataFrame:
    """A row for each of the ``n`` rows of a range. Ranges of over ``step`` rows are cut and dealt to all tasks first."""
    cut = found.where(F.col("n") > step).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.repartition(tasks, "doc_id", "at").withColumn("stop", F.least(F.col("at") + step, F.col("n")))
    whole = found.where(F.col("n") <= step).withColumns({"at": F.lit(0).cast("long"), "stop": F.col("n")})
    one = whole.unionByName(cut).withColumn("i", F.explode(F.sequence("at", F.col("stop") - 1)))
    return one.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("i")).alias("slot"), (F.col("first_copy") + F.col("i")).alias("copy"))


def place(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row.

    A key's position is a hash of its doc_id, or of the text's checksum if it has none; rows that share a position
    are told apart by size and checksum. Capacity is ``(1 + slack)`` times the mean; without slack the first shards take the
    remainder, so row counts are at most one apart. Slots run from 0 without gaps. Rows that repeat id, size and checksum
    take neighbouring slots and overflow clockwise as others do. A text of any length counts as one row; only its size and
    checksum move.
    """
    return _each(saved(ranges(docs, **how), "ring-ranges")).drop("copy")


def shard_report(docs: DataFrame, *, shards: int = 16, **how) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``rows``."""
    return place(docs, shards=shards, **how).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_documents(docs: DataFrame, *, shards: int = 16, copies: int = COPIES, **how) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, which take the place of columns that have these names; all others stay as they
    are. Rows that repeat a doc_id are numbered, so each takes a slot of its own; where some row repeats over ``copies``
    times, rows are dealt to parts of about so many first and numbered in these.

    The ranges of equal rows are brought together before the join, so a text is shuffled once: its numbering takes place
    where the join put it. An id, size and checksum has at most a range for each piece of its cell.
    """
    ring_id, crc, size, part, taken_, before_, copy, own_ = fresh_names(docs, 8)
    key = [ring_id, crc, size]
    ident = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias(ring_id)  # null has one of its own
    found = saved(ranges(docs, shards=shards, **how), "ring-ranges")
    most = found.agg(F.max(F.col("first_copy") + F.col("n"))).first()[0] or 0
    found = found.select(ident, F.col("text_crc32").alias(crc), F.col("size").alias(size), F.struct("first_copy", "n", "shard", "first_slot").alias("range"))
    taken = found.groupBy(*key).agg(F.collect_list("range").alias(taken_))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    marked = docs.select(*kept, ident, F.crc32(text_of()).alias(crc), (F.octet_length(text_of()).cast("long") + 1).alias(size))
    if most > copies:
        parts = F.lit(-(-most // copies))
        marked = saved(marked.withColumn(part, F.pmod(F.monotonically_increasing_id(), parts)), "ring-dealt")
        before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        count = marked.groupBy(*key, part).agg(F.count("*").alias("n"))
        taken = count.withColumn(before_, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(taken, key)
        key = [*key, part]
    else:
        taken = taken.withColumn(before_, F.lit(0))
    placed = marked.join(taken, key).withColumn(copy, F.row_number().over(Window.partitionBy(*key).orderBy(ring_id)) - 1 + F.col(before_))
    own = F.filter(taken_, lambda r: (r["first_copy"] <= F.col(copy)) & (F.col(copy) < r["first_copy"] + r["n"]))[0]
    placed = placed.withColumn(own_, own)
    slot = F.col(f"{own_}.first_slot") + F.col(copy) - F.col(f"{own_}.first_copy")
    return placed.select(*kept, F.col(f"{own_}.shard").alias("shard"), slot.alias("slot"))

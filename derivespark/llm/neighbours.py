"""Approximate nearest neighbours by a forest of sorted hash strings, read in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small, small_batches

#: Bits of a hash string.
BITS = 64
#: Vectors of one block of a tree's sorted array, and queries that are compared with a block at a time.
BLOCK_ROWS, QUERY_ROWS = 2048, 256
#: Queries descend to the longest prefixes at which their trees together hold so many candidates for each neighbour wanted.
AMPLE = 16
#: Candidates that a task keeps before it drops all but the best of each query.
HELD = 500_000

BLOCKS = "tree int, cell long, ids binary, hashes binary, vectors binary"
FOUND = "query_id long, class long, score double"


class Planes:
    """Hash strings of each tree: signs of projections on random directions. ``norm`` is the largest length of a vector:
    points get one more component, which makes all equally long, so that the inner product orders them as the angle does;
    for queries it is zero."""

    def __init__(self, trees: int, width: int, norm: float, seed: int = 5) -> None:
        self.trees, self.norm = trees, norm
        self.planes = np.random.default_rng(seed).normal(size=(trees * BITS, width + 1))

    def __call__(self, x: np.ndarray, point: bool) -> np.ndarray:
        """``(rows, trees)`` unsigned numbers whose highest bit is the first."""
        rest = np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", x, x), 0)) if point else np.zeros(len(x))
        signs = (np.c_[x, rest] @ self.planes.T > 0).reshape(len(x), self.trees, BITS // 8, 8)
        return np.packbits(signs, axis=3).reshape(len(x), self.trees, BITS // 8).view(">u8")[:, :, 0].astype(np.uint64)


def _padded(values: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of ``width`` doubles; shorter ones are filled with zeros."""
    out, sizes = np.zeros((len(values), width)), np.diff(values.offsets.to_numpy())
    row = np.repeat(np.arange(len(values)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.flatten().to_numpy()
    return out


def usable(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """``(id, vector)``: a row for each id of which some vector has only finite components, one of them not zero; of
    several the least, component by component."""
    x = F.col(vector_name).cast("array<double>")
    sound = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))  # null and NaN pass neither
    some = F.exists("vector", lambda v: v != 0)
    rows = vectors.select(F.col(id_name).cast("long").alias("id"), x.alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(sound & some).groupBy("id").agg(F.min("vector").alias("vector"))


def classes(points: DataFrame, k: int) -> DataFrame:
    """``(class, ids, vector)``: distinct vectors of ``(id, vector)`` with their ``k + 1`` smallest ids; no more of equal
    vectors can be among the ``k`` nearest. Spark limits each task's rows of a vector so before it shuffles them. Numbers
    of classes follow their smallest ids."""
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = points.withColumn("_nth", first).where(F.col("_nth") <= k + 1)
    grouped = saved(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "forest-vectors")
    ordered = grouped.repartitionByRange("ids", "vector").sortWithinPartitions("ids", "vector")
    return ordered.select(F.monotonically_increasing_id().alias("class"), "ids", "vector")


def _strings(planes: Planes, width: int, kind: str, point: bool):
    """Hash strings of all trees for the ``vector`` of each row, its length, and the vector itself in bytes of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _padded(batch.column("vector"), width)
                hashes = planes(x, point).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * planes.trees), pa.array(hashes.ravel()))
                length = pa.array(np.sqrt(np.einsum("ij,ij->i", x, x)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), length, flat], ["id", "x", "length", "hashes"])

    return run


def _cell(bits, hash_="hash"):
    """Number of the first ``bits`` bits (a column); the empty prefix is number 0."""
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned({hash_}, cast(64 - _bits as int))"))


def _block(key, rows):
    """One block: its vectors in the order of their hash strings."""
    hashes = rows.column("hash").to_numpy().view(np.uint64)
    ids = rows.column("id").to_numpy()
    order = np.lexsort((ids, hashes))
    vectors = rows.column("x").combine_chunks().take(pa.array(order))
    columns = [[key[0].as_py()], [key[1].as_py()], [ids[order].tobytes()], [hashes[order].tobytes()], [b"".join(vectors.to_pylist())]]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split(" ")[0] for f in BLOCKS.split(", ")])


def _spread(found: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``found`` with ``_salt``: groups of ``keys`` with over ``rows`` rows are dealt to parts of about so many."""
    large = found.groupBy(*keys).count().where(F.col("count") > rows).withColumn("_parts", F.ceil(F.col("count") / rows).cast("int")).drop("count")
    marked = found.join(small(saved(large, "forest-large")), keys, "left")
    return marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")


def forest(strings: DataFrame, bits: int) -> DataFrame:
    """The written trees: every point in each tree, in blocks of about ``BLOCK_ROWS`` that share the first ``bits`` bits."""
    each = strings.select("id", "x", F.posexplode("hashes").alias("tree", "hash")).withColumn("_bits", F.lit(bits))
    each = each.withColumn("cell", _cell(F.col("_bits"))).drop("_bits")
    spread = _spread(each.select("id", "x", "tree", "cell", "hash"), ["tree", "cell"], BLOCK_ROWS)
    return saved(spread.select("tree", "cell", "_salt", "id", "hash", "x").groupBy("tree", "cell", "_salt").applyInArrow(_block, BLOCKS), "forest-blocks")


def _query_blocks(asked: DataFrame, bits: int, vectors: bool) -> DataFrame:
    """Queries that ask for one range of a tree, in blocks, a row for each cell of that range: ``tree, cell, asks``.
    ``asked`` has ``id, level, hashes`` and ``x``; above the cells a query's prefix covers several."""
    each = asked.select("id", "level", *(["x"] if vectors else []), F.posexplode("hashes").alias("tree", "hash"))
    each = each.withColumn("_bits", F.least("level", F.lit(bits)))
    each = each.withColumn("prefix", _cell(F.col("_bits")))
    spread = _spread(each, ["tree", "_bits", "prefix"], QUERY_ROWS)
    ask = F.struct("id", "level", "hash", *(["x"] if vectors else []))
    packed = spread.groupBy("tree", "_bits", "prefix", "_salt").agg(F.collect_list(ask).alias("asks"))  # QUERY_ROWS or so
    more = F.expr(f"shiftleft(1L, cast({bits} - _bits as int))")
    return packed.withColumn("cell", F.explode(F.sequence(F.col("prefix") * more, (F.col("prefix") + 1) * more - 1))).select("tree", "cell", "asks")


def _ranges(hashes: np.ndarray, wanted: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the sorted ``hashes`` that shares the first ``level`` bits with each of ``wanted``: binary search."""
    mask = np.where(level == 0, 0, np.uint64(2**64 - 1) << (64 - np.maximum(level, 1)).astype(np.uint64)).astype(np.uint64)
    return np.searchsorted(hashes, wanted & mask, "left"), np.searchsorted(hashes, wanted | ~mask, "right")


def _asks(asks: pa.StructScalar) -> tuple[np.ndarray, ...]:
    values = asks.values
    return tuple(values.field(f).to_numpy() for f in ("id", "level")) + (values.field("hash").to_numpy().view(np.uint64),)


def _depths(bits: int):
    """How many points of a block share each number of bits, from ``bits`` up, with each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _, wanted = _asks(batch.column("asks")[i])
                hashes = np.frombuffer(batch.column("hashes")[i].as_py(), dtype=np.uint64)
                counts = []
                for level in range(bits, BITS + 1):
                    low, high = _ranges(hashes, wanted, np.full(len(ids), level))
                    counts.append(high - low)
                counts = np.array(counts, dtype=np.int64).T
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * counts.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(counts.ravel()))], ["id", "counts"])

    return run


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, the products added one by one from the first on."""
    out = np.empty(len(q))
    for i in range(0, len(q), 20_000):
        out[i : i + 20_000] = (q[i : i + 20_000] * x[i : i + 20_000]).cumsum(axis=1)[:, -1]
    return out


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row of ``q``, id and exact score of the ``k`` rows of ``x`` with the largest inner product with each, ties to smaller
    ids. A matrix product finds all that rounding could put among these, and those are added up again."""
    rough = q @ x.T
    take = min(k, len(x))
    least = np.partition(rough, len(x) - take, axis=1)[:, len(x) - take]
    slack = 1e-12 * np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", x, x).max())
    row, column = np.nonzero(rough >= (least - slack)[:, None])
    return best_candidates(row, ids[column], _exact(q[row], x[column]), k)


def best_candidates(query: np.ndarray, classes: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best different classes of each query, ties to smaller ones."""
    order = np.lexsort((classes, -score, query))
    query, classes, score = query[order], classes[order], score[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (classes[1:] != classes[:-1])][: len(query)]  # equal classes score alike
    query, classes, score = query[new], classes[new], score[new]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return query[nth < k], classes[nth < k], score[nth < k]


def _searched(k: int, width: int, kinds: tuple[str, str]):
    """The ``k`` best of a task's candidates for each query: points of its blocks whose strings share the query's level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def best() -> tuple[np.ndarray, ...]:
            none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return best_candidates(*(np.concatenate(x) for x in zip(none, *held, strict=True)), k)

        for batch in batches:
            for i in range(batch.num_rows):
                asks = batch.column("asks")[i]
                queries, level, wanted = _asks(asks)
                q = np.frombuffer(b"".join(asks.values.field("x").to_pylist()), kinds[0]).reshape(len(queries), width).astype(np.float64)
                block = {c: batch.column(c)[i].as_py() for c in ("ids", "hashes", "vectors")}
                ids, hashes = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["hashes"], np.uint64)
                x = np.frombuffer(block["vectors"], kinds[1]).reshape(len(ids), width).astype(np.float64)
                low, high = _ranges(hashes, wanted, level)
                order = np.lexsort((high, low))
                cuts = np.flatnonzero(np.r_[True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)])
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):  # queries with one range together
                    which, (f, t) = order[a:b], (low[order[a]], high[order[a]])
                    if t > f:
                        row, classes, score = best_of(q[which], x[f:t], ids[f:t], k)
                        held.append((queries[which[row]], classes, score))
                        size += len(row)
            if size > HELD:
                held = [best()]
                size = len(held[0][0])
                if 2 * size > HELD:  # so many queries
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["query_id", "class", "score"])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best()], ["query_id", "class", "score"])

    return run


def _search(trees: DataFrame, asked: DataFrame, bits: int, k: int, width: int, kinds: tuple[str, str]) -> DataFrame:
    """``(query_id, class, score, nth)``: the ``k`` best classes of each query among the candidates at its level."""
    blocks = saved(_query_blocks(asked, bits, True), "forest-asks")
    found = blocks.join(trees, ["tree", "cell"]).select("asks", "ids", "hashes", "vectors")
    with small_batches(trees.sparkSession, 16):
        each = saved(found.mapInArrow(_searched(k, width, kinds), FOUND), "forest-found")
    pairs = each.groupBy("query_id", "class").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "class"))
    return saved(pairs.withColumn("nth", best).where(F.col("nth") <= k), "forest-best")


def nearest(
    points: DataFrame, queries: DataFrame, *, k: int = 20, trees: int = 12, miss: float = 0.05, point_id: str = "vec_id", query_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` rows of ``points`` with another id and the
    largest inner product found, nearest first, ties to smaller ids; all, if there are fewer.

    Vectors that are null, zero, or hold null, NaN or infinite components take no part, nor do rows without an id. Of
    rows that share an id the one with the least vector counts, component by component; a shorter vector reads as if zeros
    followed. Equal vectors are searched as one and given back under each of their ids. Other columns are ignored.

    A tree holds all points sorted by a string of random bits that near points tend to share. A query first descends, in all
    trees alike, to the longest prefix under which they hold ``AMPLE * k`` candidates for it, then ascends until no
    neighbour nearer than the ``k``-th found is missed by every tree with a probability above ``miss``: two vectors at the
    angle a share a bit with probability 1 - a / pi. At the root this is all points, so the bound holds for any data,
    and points in no clusters only cost more. Two searches do it, as the first gives a lower bound of the ``k``-th score.

    Blocks of points meet blocks of queries by a join on tree and first bits; groups of equal first bits are dealt to
    blocks of bounded size on both sides, so a hot string is many small products instead of one task."""
    spark = points.sparkSession
    sound, asking = usable(points, point_id, vector), usable(queries, query_id, vector)
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    width, most = sound.agg(F.max(F.size("vector")), F.max(square)).first()
    width = max(width or 0, asking.agg(F.max(F.size("vector"))).first()[0] or 0)
    planes = Planes(trees, width, math.sqrt(most or 0))
    kinds = tuple("<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8" for df in (queries, points))
    fields = "id long, x binary, length double, hashes array<long>"
    with small_batches(spark, 2000):
        distinct = saved(classes(sound, k), "forest-classes")
        strings = saved(distinct.select("class", "vector").mapInArrow(_strings(planes, width, kinds[1], True), fields), "forest-strings")
        asked = saved(asking.mapInArrow(_strings(planes, width, kinds[0], False), fields), "forest-queries")
    bits = min(30, max(0, math.ceil(math.log2(max(strings.count(), 1) / BLOCK_ROWS))))
    blocks = forest(strings, bits)

    # descend: the longest prefix at which all trees together hold enough candidates
    every = _query_blocks(asked.withColumn("level", F.lit(bits)), bits, False)
    with small_batches(spark, 50):
        shared = every.join(blocks.select("tree", "cell", "hashes"), ["tree", "cell"]).select("asks", "hashes")
        shared = saved(shared.mapInArrow(_depths(bits), "id long, counts array<long>"), "forest-depths")
    levels = range(BITS + 1 - bits)
    sums = shared.groupBy("id").agg(*[F.sum(F.col("counts")[i]).alias(f"l{i}") for i in levels])
    deep = F.greatest(F.lit(bits), *[F.when(F.col(f"l{i}") >= AMPLE * k, bits + i) for i in levels])
    first = asked.join(sums.select("id", deep.alias("level")), "id", "left").withColumn("level", F.coalesce("level", F.lit(bits)))
    first = saved(first, "forest-first")
    found = _search(blocks, first, bits, k + 1, width, kinds)

    # ascend: to the level at which a point as near as the last found shares some tree's prefix often enough
    last = found.where(F.col("nth") == k + 1).select(F.col("query_id").alias("id"), F.col("score").alias("last"))
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("last") / (F.col("length") * planes.norm)))
    same = F.lit(1.0) - F.acos(cosine) / math.pi
    least = F.when(same >= 1, F.lit(BITS)).otherwise(F.floor(math.log(1 - miss ** (1 / trees)) / F.log(same)))
    needed = F.when(F.col("last").isNull() | least.isNull(), 0).otherwise(F.least(least, F.lit(BITS)))  # too few found, or the opposite way: all points
    risen = first.join(last, "id", "left").withColumn("needed", needed.cast("int")).where("needed < level")
    risen = saved(risen.select("id", "x", "hashes", F.col("needed").alias("level")), "forest-risen")
    more = _search(blocks, risen, bits, k + 1, width, kinds)
    found = found.join(risen.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)

    each = found.join(distinct.select("class", "ids"), "class").select("query_id", F.explode("ids").alias("vec_id"), "score")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.where("query_id <> vec_id").withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

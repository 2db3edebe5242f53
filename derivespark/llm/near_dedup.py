"""Near-duplicate detection with circulant MinHash, banding and exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import U, chunks, lists, mix, shingle_sets
from .common import components, saved, small_batches, whole_id

#: The two permutations of a set of up to LARGE shingles act on so many elements, and on all 64-bit numbers beyond: a set
#: that filled much of a universe would share its least elements with any other such set.
UNIVERSE, LARGE = 2**20, 2**16
CHUNK_BYTES = 500_000
#: Shingles of the sets that one verifying task holds: this many, twice for a pair of blocks.
BLOCK_SHINGLES = 100_000


def band_plan(percent: int, rows: int = 8, miss: float = 1e-6) -> tuple[int, int]:
    """Bands and rows with which a pair at the least similarity stays unseen with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)), rows


class Circulant:
    """MinHash signatures from two permutations: one scrambles the elements, the other, shifted by one more place for
    each coordinate, orders them. ``wide`` signatures use permutations of all 64-bit numbers."""

    def __init__(self, coordinates: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.scramble = rng.permutation(UNIVERSE)
        order = rng.permutation(UNIVERSE).astype(np.uint32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([order[1 - coordinates :], order]), coordinates)

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        at = self.scramble[(elements % U(UNIVERSE)).astype(np.int64)]
        return np.min([self.shifts[at[i : i + 2048]].min(axis=0) for i in range(0, len(at), 2048)], axis=0)

    def wide(self, elements: np.ndarray) -> np.ndarray:
        at, steps = mix(elements ^ U(0x5851F42D4C957F2D)), np.arange(self.shifts.shape[1], dtype=np.uint64)
        return np.min([mix(at[i : i + 1024, None] + steps).min(axis=0) for i in range(0, len(at), 1024)], axis=0)


def _signatures(k: int, percent: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = Circulant(bands * rows)
        marks = mix(np.arange(2 * bands, dtype=np.uint64) + U(1)).reshape(2, bands)

        def banded(signature: np.ndarray, key: np.ndarray) -> np.ndarray:
            for column in signature.reshape(bands, rows).T.astype(np.uint64):
                key = mix(key + column)
            return key.view(np.int64)

        for batch, texts in chunks(batches, "text", CHUNK_BYTES):
            sets = shingle_sets(texts, k)
            keys = []
            for s in sets:  # linked sets differ in size by the least similarity at most: near LARGE a set has both signatures
                own = [banded(minhash(s), marks[0])] if 0 < len(s) <= LARGE else []
                own += [banded(minhash.wide(s), marks[1])] if 100 * len(s) >= percent * LARGE else []
                keys.append(np.concatenate(own) if own else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    lists(keys, pa.int64()),
                ],
                ["doc_id", "n_shingles", "same", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", CHUNK_BYTES):
            sets = pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "component", "units")), sets], ["doc_id", "component", "units", "shingles"])

    return run


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links ``100 * intersection >= percent * union`` that join all sets which such links connect: a forest, not all
    pairs. A search from each set counts shared shingles with the sets not yet reached through their postings."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.flatnonzero(new)
    df = np.diff(np.r_[first, len(flat)])
    term = np.empty(len(flat), dtype=np.int64)
    term[order] = np.cumsum(new) - 1
    posted, at = owner[order], np.r_[0, np.cumsum(sizes)]
    alive, links = np.ones(len(sets), dtype=bool), []
    for root in range(len(sets)):
        if not alive[root]:
            continue
        alive[root], stack = False, [root]
        while stack:
            v = stack.pop()
            terms = term[at[v] : at[v + 1]]
            terms = terms[df[terms] > 1]
            if not len(terms):
                continue
            spans = df[terms]
            index = np.repeat(first[terms] - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
            shared = np.bincount(posted[index], minlength=len(sets))
            hit = np.flatnonzero(alive & (100 * shared >= percent * (sizes + sizes[v] - shared)) & (shared > 0))
            alive[hit] = False
            links += [(v, int(u)) for u in hit]
            stack += hit.tolist()
    return links


def _verify(percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in part.groupby("component", sort=False):
            if len(group) > 1:
                ids = group["doc_id"].to_numpy()
                sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
                out += [(ids[a], ids[b]) for a, b in spanning_links(sets, percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, rows: int = 8) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of characters other than the six ASCII blanks, A-Z lower-cased; a document's set holds its distinct
    shingles of ``shingle`` words, or its whole sequence if it has fewer. Documents link if their sets share
    ``percent`` hundredths of their union; component_id is the smallest doc_id reachable. Null and wordless texts
    have an empty set and link with nothing. Rows that share a doc_id count as one document; rows without a
    doc_id link with nothing and stay; a doc_id of another kind than a whole number is an error. A text of any length is
    one set; of a very long one the signature is taken over 64-bit numbers. Other columns are ignored.

    Documents with equal sets form a class, which the smallest doc_id stands for. Classes that meet in a band form
    candidate clusters: a class points to the smallest member of its buckets, and the smallest members of its other
    buckets do so too, once for all classes that say it, so a hot bucket gives no pairs and a class one edge of its own.
    Every link lies inside a cluster. A task takes the full sets of small clusters together. A large cluster is cut into blocks, and each
    block is verified together with the cluster's smallest member: near copies of one text come together there, at a cost
    that follows the cluster's size. Only members that did not reach the smallest one, if any, are then compared with
    all blocks, a block of them at a time. So every pair that could join two components is met within bounded memory,
    and only a forest of links leaves a task.
    """
    bands, rows = band_plan(percent, rows)
    texts = docs.select(whole_id(docs), F.col("text").cast("string").cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        signed = saved(texts.mapInArrow(_signatures(shingle, percent, bands, rows), "doc_id long, n_shingles long, same binary, bands array<long>"), "minhash")
    known = signed.where("same is not null and doc_id is not null")
    classes = saved(
        known.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands")),
        "minhash-classes",
    )
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    met = banded.join(shared, "key").where("rep <> low").select("rep", "low")
    met = saved(met.withColumn("first", F.min("low").over(Window.partitionBy("rep"))), "minhash-met")  # over one class's bands
    near = met.groupBy(F.col("rep").alias("a")).agg(F.first("first").alias("b"))
    near = near.unionByName(met.where("low <> first").select(F.col("low").alias("a"), F.col("first").alias("b")).distinct())
    clusters = components(near, "minhash-clusters")

    sized = clusters.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    load = sized.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = sized.join(load, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = saved(members, "minhash-members")
    total = classes.agg(F.sum("n")).first()[0] or 0
    bundles = F.lit(max(1, 2 * total // BLOCK_SHINGLES))

    def verified(units: DataFrame) -> DataFrame:
        sets = texts.join(units, texts["doc_id"] == units["node"]).select("doc_id", "component", "units", "text")
        sets = sets.mapInArrow(_sets(shingle), "doc_id long, component long, units array<long>, shingles binary")
        each = sets.select("doc_id", "component", "shingles", F.explode("units").alias("unit"))
        with small_batches(docs.sparkSession):
            return saved(each.groupBy("unit").applyInPandas(_verify(percent), "a long, b long"), "minhash-links")

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.when(F.col("node") == F.col("component"), every).otherwise(F.array("block"))
    units = F.when(F.col("blocks") > 1, F.transform(own, lambda i: F.xxhash64("component", i))).otherwise(F.array(F.pmod(F.xxhash64("component"), bundles)))
    links = verified(members.select("node", "component", units.alias("units")))

    large = members.where("blocks > 1")
    linked = components(links, "minhash-components")
    apart = large.join(linked.select("node", F.col("component").alias("reached")), "node", "left").where("reached is null or reached <> component")
    apart = saved(apart.drop("reached"), "minhash-apart")
    if apart.limit(1).count():
        rests = apart.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("rests"))
        paired = large.join(rests, "component").join(apart.select("node", F.lit(True).alias("is_apart")), "node", "left")
        rest = F.pmod(F.xxhash64("node", F.lit("rest")), F.col("rests")).cast("int")
        unit = lambda i, j: F.xxhash64("component", i, j)
        met = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: unit(F.col("block"), j))
        meets = F.when(F.col("is_apart"), F.transform(every, lambda i: unit(i, rest))).otherwise(F.array().cast("array<long>"))
        links = links.unionByName(verified(paired.select("node", "component", F.array_union(met, meets).alias("units"))))
        linked = components(links, "minhash-components")

    reached = classes.select("same", "rep").join(linked, F.col("rep") == F.col("node"), "left")
    reached = reached.select(F.col("same").alias("of"), F.coalesce("component", "rep").alias("component"))
    found = signed.select("doc_id", "n_shingles", "same").join(reached, F.col("same") == F.col("of"), "left")
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

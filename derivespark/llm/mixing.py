"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, saved, small, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
HASH_RANGE = 2**32


def _hash(seed: str):
    """0 to 2^32 - 1, from the seed and the doc_id alone: reruns agree. A null doc_id hashes as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def in_order(per_source: DataFrame) -> DataFrame:
    """``per_source`` with ``place``, from 0, in code-point order of ``source``, null last. Sources are dealt by range and
    counted within their range, so that any number of them can be ranked; only a count for each range meets in one task."""
    order = F.col("source").asc_nulls_last()
    dealt = per_source.repartitionByRange(order).sortWithinPartitions(order)
    dealt = saved(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "mix-sources")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "first", before.alias("before"))
    return dealt.join(small(starts), "part").withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def source_targets(sized: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all sizes; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above. Each
    round sums one aggregated row per source; the words per unit of weight rise from round to round.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighed = saved(in_order(per_source).withColumn("weight", weight).drop("place"), "mix-weights")
    level, stops = None, F.lit(False)
    while True:
        held = F.when(stops, F.col("source_size")).otherwise(0)
        total, capped, free = weighed.agg(F.sum("source_size"), F.sum(held), F.sum(F.when(stops, 0).otherwise(F.col("weight")))).first()
        found = (share * total - most * capped) / free if free else None
        if found is None or found == level:
            break
        level = found
        stops = F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size")
    rest = F.lit(0.0 if level is None else level) * F.col("weight")
    return weighed.select("source", "source_size", F.when(stops, F.lit(most) * F.col("source_size")).otherwise(rest).alias("target"))


def mix_plan(sized: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target, whole, cut)`` from ``(source, size)``: every document of the source is taken
    ``whole`` times, and once more if its hash is below ``cut``.

    The repetition rate is target / source_size; ``whole`` is its floor, and ``cut`` its fraction of all hash values, so
    the hash decides a Bernoulli draw whose probability is the fraction.
    """
    targets = source_targets(sized, weights=weights, share=share, most=most)
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    targets = targets.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    return targets.withColumn("cut", (F.col("rate") - F.col("whole")) * F.lit(float(HASH_RANGE))).drop("rate")


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    words = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), _hash(seed).alias("hash"))


def mix_report(docs: DataFrame, *, seed: str = "mix", **how) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, source``; ``taken`` is its words times its copies.

    A null or empty text has no words; a null source is a source of its own; without any words all targets are 0.
    Rows that repeat a doc_id share its hash and so its draw. Texts of any length are counted whole. Other columns
    are ignored.
    """
    sized = saved(_sizes(docs, seed), "mix-sizes")
    plan = saved(mix_plan(sized, **how), "mix-plan").withColumnRenamed("source", "plan_source")
    joined = sized.join(small(plan), F.col("source").eqNullSafe(F.col("plan_source")))
    copies = F.col("whole") + (F.col("hash") < F.col("cut")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source")


def deviation(report: DataFrame) -> DataFrame:
    """``(source, target, taken, expected)``: the words that the mix of a ``mix_report`` takes of each source, and the
    standard deviation of the Bernoulli draws there."""
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    part = rate - F.floor(rate)
    spread = F.sqrt(F.sum(part * (1 - part) * F.col("size") * F.col("size")))
    return report.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), spread.alias("expected"))


def mix(docs: DataFrame, *, seed: str = "mix", **how) -> DataFrame:
    """The documents of the mix, each repeated as often as the mix takes it, with the columns of ``docs``."""
    plan = saved(mix_plan(saved(_sizes(docs, seed), "mix-sizes"), **how), "mix-plan")
    named = dict(zip(("source", "whole", "cut"), fresh_names(docs, 3), strict=True))
    plan = plan.select(*[F.col(c).alias(n) for c, n in named.items()])
    times = (F.col(named["whole"]) + (_hash(seed) < F.col(named["cut"])).cast("long")).cast("int")
    joined = docs.join(small(plan), F.col("source").cast("string").eqNullSafe(F.col(named["source"]))).where(times > 0)
    (copy,) = fresh_names(joined, 1)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)

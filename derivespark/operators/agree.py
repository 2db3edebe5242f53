"""Votes and agreement of labellers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consensus_vote(votes: DataFrame, item: str, voter: str, label: str, strategy: str = "majority") -> DataFrame:
    """``item, votes, label, unanimous, needs_review``. NULL votes do not count; a tie, or no valid vote, gives a NULL label
    and a review; ``first`` takes the lowest voter's label."""
    counted = votes.groupBy(item, F.col(label).cast("string").alias("_label")).agg(F.count(F.col(label)).alias("_n"), F.min(F.when(F.col(label).isNotNull(), F.col(voter))).alias("_first"))
    valid = F.col("_label").isNotNull()
    per = counted.groupBy(item).agg(
        F.array_sort(F.collect_list(F.when(valid, F.struct("_label", "_n")))).alias("_all"),
        F.max(F.when(valid, F.col("_n"))).alias("_top"),
        F.min_by(F.when(valid, F.col("_label")), F.when(valid, F.col("_first"))).alias("_earliest"),
    )
    best = F.filter("_all", lambda x: x["_n"] == F.col("_top"))
    chosen = F.col("_earliest") if strategy == "first" else F.when(F.size(best) == 1, best[0]["_label"])
    texts = F.array_join(F.transform("_all", lambda x: F.concat_ws(":", x["_label"], x["_n"].cast("string"))), "; ")
    out = per.select(item, texts.alias("votes"), chosen.alias("label"), (F.size("_all") == 1).alias("unanimous"))
    return out.withColumn("needs_review", F.col("label").isNull())


def agreement_rates(wide: DataFrame, voters: Sequence[str], levels: Mapping[str, callable]) -> DataFrame:
    """``level, n_items, agree_rate`` of items on which all voters give one value, for levels from coarse to fine; each maps
    a voter's column to the value compared (NULL equals NULL)."""
    first, *others = voters
    stats = []
    for name, level in levels.items():
        same = F.lit(True)
        for v in others:
            same = same & level(F.col(first)).eqNullSafe(level(F.col(v)))
        stats.append((name, same))
    row = wide.agg(F.count(F.lit(1)).alias("n"), *[F.avg(s.cast("double")).alias(f"r{i}") for i, (_, s) in enumerate(stats)])
    each = F.array(*[F.struct(F.lit(name).alias("level"), F.col("n").alias("n_items"), F.col(f"r{i}").alias("agree_rate")) for i, (name, _) in enumerate(stats)])
    return row.select(F.explode(each).alias("_s")).select("_s.*")


def inflated_items(wide: DataFrame, voters: Sequence[str], coarse: callable, fine: callable) -> DataFrame:
    """Items that agree on the coarse level only: their share is the overstatement of the coarse rate."""
    first, *others = voters
    c, f = F.lit(True), F.lit(True)
    for v in others:
        c = c & coarse(F.col(first)).eqNullSafe(coarse(F.col(v)))
        f = f & fine(F.col(first)).eqNullSafe(fine(F.col(v)))
    return wide.filter(c & ~f)


def agreement_crosstab(wide: DataFrame, a: str, b: str) -> DataFrame:
    return wide.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_items"))


def dual_compare(a: DataFrame, b: DataFrame, item: str, label: str) -> DataFrame:
    """``item, label_a, label_b, class``: agree (both abstaining included), a_abstain, b_abstain or disagree. An item that one
    side lacks counts as abstained there."""
    left, right = (x.select(item, F.col(label).alias(f"label_{n}")) for x, n in ((a, "a"), (b, "b")))
    x, y = F.col("label_a"), F.col("label_b")
    kind = F.when(x.eqNullSafe(y), "agree").when(x.isNull(), "a_abstain").when(y.isNull(), "b_abstain").otherwise("disagree")
    return left.join(right, item, "full").withColumn("class", kind)


def dual_rate(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.col("class") == "agree").cast("double")).alias("agree_rate"), F.count_if(F.col("class") != "agree").alias("n_review"))


def accuracy(pred: DataFrame, truth: DataFrame, item: str, label: str) -> DataFrame:
    """``n_items, accuracy``: a missing or NULL prediction is wrong."""
    joined = truth.select(item, F.col(label).alias("_truth")).join(pred.select(item, F.col(label).alias("_pred")), item, "left")
    return joined.agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.coalesce(F.col("_pred") == F.col("_truth"), F.lit(False)).cast("double")).alias("accuracy"))


def accept(rates: Mapping[str, float], minimums: Mapping[str, float]) -> tuple[bool, list[str]]:
    """Whether every rate reaches its minimum, fixed beforehand; and the reasons against."""
    reasons = [f"{k}: {rates.get(k)} is below {m}" for k, m in minimums.items() if rates.get(k) is None or rates[k] < m]
    return not reasons, reasons



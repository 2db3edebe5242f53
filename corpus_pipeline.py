"""The corpus pipeline: five stages, each an operator of ``derivespark.llm``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivespark.llm.common import fresh_names, new_path, saved, small, table
from derivespark.llm.decontaminate import contaminated
from derivespark.llm.mixing import mix
from derivespark.llm.near_dedup import near_duplicates
from derivespark.llm.quality import described, score, train
from derivespark.llm.sharding import shard_documents

#: The first stage learns its scores, which SQL cannot; the stages are tested against brute force instead.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone``; rows that share a doc_id go or stay together."""
    return docs.join(small(saved(gone.distinct(), "pipeline-gone")), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores one half or more."""
    (name,) = fresh_names(docs, 1)
    rows = described(docs, name)
    model = train(rows.select("doc_id", F.col(name).alias("x")), table(spark, sf_dir, "labels"))
    return rows.where(score(model, name) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return _without(docs, near_duplicates(docs).where("not kept").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0").select("doc_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there."""
    return shard_documents(docs, shards=16)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

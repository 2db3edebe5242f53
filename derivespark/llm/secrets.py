"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, saved, text_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


#: Fixed patterns, in the order in which spans at one start are listed. A run of hex digits or of an access key can
#: only match whole, so their least lengths stand in the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
RULES_VERSION = "base-1"
SCANNED = "sha binary, rules string"
FINDINGS = "sha binary, rules string, kind string, start int, end int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no such table yet
        return spark.createDataFrame([], schema)


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``(sha, kind, start, end)`` of ``(sha, text)``, a row per blob; code points, end exclusive. A match starts after the
    texts between matches and the matches before it."""
    out = None
    for rule in rules:
        pattern = F.lit(rule.pattern)
        found = blobs.where(F.col("text").rlike(rule.pattern)).select(
            "sha",
            F.posexplode(
                F.arrays_zip(
                    F.regexp_extract_all("text", pattern, F.lit(0)).alias("whole"),
                    F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("value"),
                    F.slice(F.split("text", rule.pattern, -1), 1, F.size(F.regexp_extract_all("text", pattern, F.lit(0)))).alias("gap"),
                )
            ).alias("at", "m"),
        )
        upto = Window.partitionBy("sha").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = found.select(
            "sha",
            F.length("m.whole").alias("long"),
            F.length("m.value").alias("value"),
            F.sum(F.length("m.gap") + F.length("m.whole")).over(upto).cast("int").alias("end"),
        )
        spans = ends.where(F.col("value") >= rule.least).select("sha", F.lit(rule.kind).alias("kind"), (F.col("end") - F.col("long")).alias("start"), "end")
        out = spans if out is None else out.unionByName(spans)
    return out


def scan_ledger(docs: DataFrame, ledger: str, *, rules=RULES, version: str = RULES_VERSION, path_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Bring the ledger at ``ledger`` up to date with ``docs``; gives ``(paths, findings)``.

    ``paths`` has ``(path, sha)`` for every row; ``findings`` has ``(sha, kind, start, end)`` for the blobs under this
    rule version. Only pairs of blob and rule version that the ledger lacks are scanned, each from one row that holds
    the blob; rows that repeat a path and a text are one blob too. Findings are written before the pairs that say they
    were scanned: after a crash a pair is scanned again, and equal findings count once. A text of any length is one row.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(path_col).alias("path"), text_of().alias("text"))
    paths = saved(source.select("path", F.unhex(F.sha2("text", 256)).alias("sha")), "ledger-paths")
    seen = _read(spark, f"{ledger}/scanned", SCANNED).where(F.col("rules") == version).select("sha")
    unseen = saved(paths.groupBy("sha").agg(F.min("path").alias("path")).join(seen, "sha", "left_anti"), "ledger-unseen")
    reps = unseen.select(F.col("path").alias("rep"), F.col("sha").alias("rep_sha"))
    with_sha = source.withColumn("sha", F.unhex(F.sha2("text", 256)))
    likely = with_sha.where(F.greatest(*[F.col("text").rlike(r.pattern) for r in rules]))
    blobs = likely.join(reps, F.col("path").eqNullSafe(F.col("rep")) & (F.col("sha") == F.col("rep_sha")), "left_semi")
    once = blobs.select("sha", "text").dropDuplicates(["sha"])  # rows that repeat a path bring the same blob again
    fresh = find_spans(saved(once, "ledger-blobs"), rules).distinct()
    fresh.select("sha", F.lit(version).alias("rules"), "kind", "start", "end").write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("sha", F.lit(version).alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    findings = _read(spark, f"{ledger}/findings", FINDINGS).where(F.col("rules") == version).drop("rules").distinct()
    return paths, findings


def scan_secrets(docs: DataFrame, ledger: str | None = None, *, rules=RULES, version: str = RULES_VERSION) -> DataFrame:
    """One row per document: ``doc_id``, a count ``n_<kind>`` for each rule, ``base_sha256``, ``spans``.

    ``spans`` lists ``kind:start:end`` by start, then rule order, comma-joined; ``base_sha256`` is its SHA-256. Null and
    empty texts have no spans; rows that repeat a doc_id are paths of their own. Copies of a text are scanned once.
    """
    paths, findings = scan_ledger(docs, ledger or new_path(docs.sparkSession, "ledger"), rules=rules, version=version)
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules]
    listed = F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end")))
    per_blob = findings.groupBy("sha").agg(*counts, listed.alias("listed"))
    joined = F.array_join(F.transform("listed", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per_blob = per_blob.select("sha", *[f"n_{r.kind}" for r in rules], joined.alias("spans"))
    spans = F.coalesce("spans", F.lit(""))
    return paths.join(per_blob, "sha", "left").select(
        F.col("path").alias("doc_id"),
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )

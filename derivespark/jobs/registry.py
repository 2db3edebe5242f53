"""The registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scratch
from ..operators import agree, analysis, checks, compare, dates, finalize, joins, project, records, windows
from ..sources import dataset_json, json_ranges, xport
from . import pipelines

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def events(spark, sf_dir) -> DataFrame:
    """Findings: a parameter per event type."""
    return project.to_bds(read(spark, sf_dir, "events"), "event_type", "value")


def subjects(spark, sf_dir) -> DataFrame:
    """A start date per user in January 2024."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), "c_mktsegment", F.date_add(F.lit("2024-01-08").cast("date"), (F.col("c_custkey") % 14).cast("int")).alias("TRTSDT"))


E_SQL = "SELECT event_id, user_id, ts, event_type AS PARAMCD, value AS AVAL FROM events"
S_SQL = "SELECT c_custkey AS user_id, c_mktsegment, DATE '2024-01-08' + (c_custkey % 14)::INTEGER AS TRTSDT FROM customer"
CHANGE_SQL = f"""
WITH e AS ({E_SQL}), s AS ({S_SQL}),
j AS (SELECT e.*, TRTSDT FROM e LEFT JOIN s USING (user_id)),
f AS (SELECT *, coalesce(ts <= TRTSDT, false) AS ok FROM j),
b AS (SELECT *, CASE WHEN ok AND row_number() OVER (PARTITION BY user_id, PARAMCD, ok ORDER BY ts DESC, event_id DESC) = 1 THEN 'Y' END AS ABLFL FROM f),
c AS (SELECT *, max(CASE WHEN ABLFL = 'Y' THEN AVAL END) OVER (PARTITION BY user_id, PARAMCD) AS BASE FROM b)
"""


def changed(spark, sf_dir) -> DataFrame:
    out = joins.merge_var(events(spark, sf_dir), subjects(spark, sf_dir), "TRTSDT", "TRTSDT", ["user_id"])
    keys = ["user_id", "PARAMCD"]
    out = windows.extreme_flag(out, "ABLFL", keys, ["ts", "event_id"], "last", restrict="ts <= TRTSDT")
    out = joins.derive_base(out, keys)
    out = project.compute_var(out, "CHG", "AVAL - BASE")
    return project.compute_var(out, "PCHG", "try_divide(100 * (AVAL - BASE), BASE)")


@query(CHANGE_SQL + "SELECT event_id, user_id, PARAMCD, AVAL, ABLFL, BASE, round(AVAL - BASE, 4) AS CHG, round(100 * (AVAL - BASE) / nullif(BASE, 0), 4) AS PCHG FROM c")
def findings_change(spark, sf_dir):
    return changed(spark, sf_dir).select("event_id", "user_id", "PARAMCD", "AVAL", "ABLFL", "BASE", F.round("CHG", 4).alias("CHG"), F.round("PCHG", 4).alias("PCHG"))


@query(
    CHANGE_SQL
    + """SELECT 'T1' AS output, 'AN01' AS analysis_id, PARAMCD, NULL::VARCHAR AS level, op AS operation, ord AS op_order, round(v, 4) AS value, printf('%.' || places || 'f', round(v, places)) AS display FROM (
SELECT PARAMCD, unnest(['n', 'mean', 'sd', 'median', 'q1', 'q3', 'min', 'max']) AS op, unnest([1, 4, 5, 6, 7, 8, 9, 10]) AS ord, unnest([0, 1, 2, 1, 1, 1, 1, 1]) AS places,
unnest([count(x)::DOUBLE, avg(x), stddev_samp(x), median(x), quantile_cont(x, 0.25), quantile_cont(x, 0.75), min(x), max(x)]) AS v
FROM (SELECT PARAMCD, AVAL - BASE AS x FROM c) GROUP BY PARAMCD)"""
)
def n_change_statistics(spark, sf_dir):
    spec = {"output": "T1", "analysis_id": "AN01", "variable": "CHG", "operations": ["sd", "n", "mean", "median", "q1", "q3", "min", "max"], "grouping": ["PARAMCD"]}
    return analysis.analysis_table(changed(spark, sf_dir), [spec]).withColumn("value", F.round("value", 4))


@query("SELECT o_orderkey, o_custkey AS SUBJECT, 'STUDY1' AS STUDYID FROM orders")
def p1_assign(spark, sf_dir):
    o = project.assign(read(spark, sf_dir, "orders"), "SUBJECT", from_="o_custkey")
    return project.assign(o, "STUDYID", literal="STUDY1").select("o_orderkey", "SUBJECT", "STUDYID")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_quantity - 1, 0) AS RATIO FROM lineitem")
def p2_compute_var(spark, sf_dir):
    out = project.compute_var(read(spark, sf_dir, "lineitem"), "RATIO", "try_divide(l_extendedprice, l_quantity - 1)")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "RATIO")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'Y' ELSE 'N' END AS SAFFL FROM orders")
def p3_assign_conditional(spark, sf_dir):
    return project.assign_conditional(read(spark, sf_dir, "orders"), "SAFFL", "o_orderstatus = 'F' AND o_totalprice > 100000", "Y", "N").select("o_orderkey", "SAFFL")


@query("""SELECT event_id,
CASE WHEN value >= 0 AND value <= 10 THEN 'LOW' WHEN value > 10 AND value <= 50 THEN 'NORMAL' WHEN value > 50 THEN 'HIGH' END AS ANRIND,
CASE WHEN value >= 0 AND value < 10 THEN 'LOW' WHEN value >= 10 AND value < 50 THEN 'NORMAL' WHEN value >= 50 THEN 'HIGH' END AS BNRIND FROM events""")
def p4_categorize(spark, sf_dir):
    breaks, labels = [0, 10, 50, float("inf")], ["LOW", "NORMAL", "HIGH"]
    out = project.categorize(events(spark, sf_dir), "ANRIND", "AVAL", breaks, labels)
    return project.categorize(out, "BNRIND", "AVAL", breaks, labels, right=False).select("event_id", "ANRIND", "BNRIND")


SEGMENTS_SQL = "SELECT row_number() OVER (ORDER BY c_mktsegment) AS code, c_mktsegment AS decode FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)"


@query(f"SELECT c_custkey, code AS SEGN FROM customer LEFT JOIN ({SEGMENTS_SQL}) ON c_mktsegment = decode")
def p5_codelist_var(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return project.codelist_var(c, "SEGN", "c_mktsegment", project.codelist_from_data(c, "c_mktsegment")).select("c_custkey", "SEGN")


@query(SEGMENTS_SQL)
def p6_codelist_from_data(spark, sf_dir):
    return project.codelist_from_data(read(spark, sf_dir, "customer"), "c_mktsegment")


@query(E_SQL)
def p7_to_bds(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", "ts", "PARAMCD", "AVAL")


@query("SELECT p_partkey, CASE WHEN contains(p_name, '1') OR contains(p_name, 'a') OR (p_brand = 'Brand#1' AND p_name NOT IN ('x')) THEN 'CQ01' END AS CQ01NAM FROM part")
def p8_keyword_flag(spark, sf_dir):
    out = project.keyword_flag(read(spark, sf_dir, "part"), "CQ01NAM", "CQ01", contains={"p_name": ["1", "a"]}, equals={"p_brand": ["Brand#1"]}, exclude={"p_name": ["x"]})
    return out.select("p_partkey", "CQ01NAM")


@query("SELECT o_orderkey, o_orderpriority || ' (' || o_orderstatus || ')' AS PARAM FROM orders")
def p9_param_label(spark, sf_dir):
    return project.param_label(read(spark, sf_dir, "orders"), "PARAM", "o_orderpriority", "o_orderstatus").select("o_orderkey", "PARAM")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice < 50000")
def p10_keep_where(spark, sf_dir):
    return project.keep_where(read(spark, sf_dir, "orders"), "o_orderstatus <> 'O' AND o_totalprice < 50000").select("o_orderkey", "o_totalprice")


def partial(spark, sf_dir) -> DataFrame:
    """ISO strings cut after the year, month, day, hour, minute or second."""
    e = read(spark, sf_dir, "events")
    cut = F.element_at(F.array(*map(F.lit, (4, 7, 10, 13, 16, 19, 19))), (F.col("event_id") % 7 + 1).cast("int"))
    return e.withColumn("DTC", F.expr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")").substr(F.lit(1), cut))


PARTIAL_SQL = "SELECT event_id, (event_id % 7)::INT AS k, ts FROM events"


@query(f"""SELECT event_id,
CASE WHEN k >= 2 THEN ts::DATE WHEN k = 1 THEN date_trunc('month', ts)::DATE END AS ASTDT,
CASE WHEN k = 1 THEN 'D' END AS ASTDTF,
CASE WHEN k >= 2 THEN ts::DATE WHEN k = 1 THEN last_day(ts::DATE) ELSE make_date(year(ts), 12, 31) END AS AENDT,
CASE WHEN k = 1 THEN 'D' WHEN k = 0 THEN 'M' END AS AENDTF
FROM ({PARTIAL_SQL})""")
def d1_impute_date(spark, sf_dir):
    out = dates.impute_dtc(partial(spark, sf_dir), "ASTDT", "DTC")
    out = dates.impute_dtc(out, "AENDT", "DTC", highest_imputation="M", date_imputation="last")
    return out.select("event_id", "ASTDT", "ASTDTF", "AENDT", "AENDTF")


@query(f"""SELECT event_id,
CASE k WHEN 0 THEN date_trunc('year', ts) WHEN 1 THEN date_trunc('month', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('hour', ts) WHEN 4 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END::TIMESTAMP AS ADTM,
CASE k WHEN 0 THEN 'M' WHEN 1 THEN 'D' END AS ADTF, CASE k WHEN 0 THEN 'H' WHEN 1 THEN 'H' WHEN 2 THEN 'H' WHEN 3 THEN 'M' WHEN 4 THEN 'S' END AS ATMF
FROM ({PARTIAL_SQL})""")
def d1_impute_datetime(spark, sf_dir):
    out = dates.impute_dtc(partial(spark, sf_dir), "ADTM", "DTC", output="dtm", highest_imputation="M", time_imputation="first")
    return out.select("event_id", F.col("ADTM").cast("timestamp_ntz").alias("ADTM"), "ADTF", "ATMF")


@query("SELECT event_id, ts::DATE AS ADT FROM events")
def d2_dtm_to_dt(spark, sf_dir):
    return dates.dtm_to_dt(read(spark, sf_dir, "events").withColumnRenamed("ts", "ADTM"), "ADTM").select("event_id", "ADT")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS s, DATE '2001-03-31' AS e FROM orders)
SELECT o_orderkey, (e - s + CASE WHEN e >= s THEN 1 ELSE 0 END)::DOUBLE AS DAYS, round((e - s) / 30.4375::DOUBLE, 4) AS MONTHS,
(year(e) - year(s) - CASE WHEN strftime(e, '%m%d') < strftime(s, '%m%d') THEN 1 ELSE 0 END)::DOUBLE AS YEARS FROM o WHERE e >= s
UNION ALL SELECT o_orderkey, (e - s)::DOUBLE, round((e - s) / 30.4375::DOUBLE, 4),
(-(year(s) - year(e) - CASE WHEN strftime(s, '%m%d') < strftime(e, '%m%d') THEN 1 ELSE 0 END))::DOUBLE FROM o WHERE e < s""")
def d3_duration(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("SDT"), F.lit("2001-03-31").cast("date").alias("EDT"))
    out = dates.duration(o, "DAYS", "SDT", "EDT", "days", add_one=True)
    out = dates.duration(out, "MONTHS", "SDT", "EDT", "months")
    out = dates.duration(out, "YEARS", "SDT", "EDT", "years")
    return out.select("o_orderkey", "DAYS", F.round("MONTHS", 4).alias("MONTHS"), "YEARS")


@query("SELECT o_orderkey, (o_orderdate::DATE - 14) AS VISITDT FROM orders")
def d4_date_shift(spark, sf_dir):
    return dates.date_shift(read(spark, sf_dir, "orders"), "VISITDT", "o_orderdate", -14).select("o_orderkey", "VISITDT")


@query(f"""SELECT event_id, CASE WHEN ts::DATE >= TRTSDT THEN ts::DATE - TRTSDT + 1 ELSE ts::DATE - TRTSDT END::INTEGER AS ADY FROM events LEFT JOIN ({S_SQL}) USING (user_id)""")
def d5_study_day(spark, sf_dir):
    out = joins.merge_var(read(spark, sf_dir, "events"), subjects(spark, sf_dir), "TRTSDT", "TRTSDT", ["user_id"])
    return dates.study_day(out, "ADY", "ts", "TRTSDT").select("event_id", "ADY")


@query("""WITH f AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS LASTPR FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, LASTPR FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def j1_merge_var(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("o_custkey", F.col("c_custkey"))
    out = joins.merge_var(c, read(spark, sf_dir, "orders"), "LASTPR", "o_totalprice", ["o_custkey"], "last", ["o_orderdate", "o_orderkey"], "o_orderstatus = 'F'")
    return out.select("c_custkey", "LASTPR")


@query("SELECT s_suppkey, n_name AS COUNTRY, n_regionkey::BIGINT AS REGION FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j1b_merge_vars(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumn("n_nationkey", F.col("s_nationkey"))
    out = joins.merge_vars(s, read(spark, sf_dir, "nation"), {"COUNTRY": "n_name", "REGION": "n_regionkey"}, ["n_nationkey"])
    return out.select("s_suppkey", "COUNTRY", F.col("REGION").cast("long").alias("REGION"))


@query("SELECT c_custkey, n_name AS COUNTRY FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j2_lookup_join(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    return joins.lookup_join(c, read(spark, sf_dir, "nation"), "COUNTRY", "n_name", ["n_nationkey"]).select("c_custkey", "COUNTRY")


@query(CHANGE_SQL + "SELECT event_id, ABLFL, BASE FROM c")
def j3_derive_base(spark, sf_dir):
    return changed(spark, sf_dir).select("event_id", "ABLFL", "BASE")


@query(f"""WITH s AS ({S_SQL}), m AS (SELECT user_id, min(ts::DATE) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, CASE WHEN d IS NOT NULL THEN 'Y' ELSE 'N' END AS EVERFL, CASE WHEN coalesce(d <= TRTSDT, false) THEN 'Y' ELSE 'N' END AS PRIORFL FROM s LEFT JOIN m USING (user_id)""")
def j4_exists_flag(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    out = joins.exists_flag(subjects(spark, sf_dir), e, "EVERFL", ["user_id"], "event_type = 'purchase'")
    out = joins.exists_flag(out, e, "PRIORFL", ["user_id"], "event_type = 'purchase'", at_or_before=("d", "TRTSDT"))
    return out.select("user_id", "EVERFL", "PRIORFL")


@query("""WITH f AS (SELECT o_custkey, max(o_orderdate::DATE) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT o_custkey, min(o_orderdate::DATE) AS d FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(f.d, p.d) AS TRTEDT FROM customer LEFT JOIN f ON c_custkey = f.o_custkey LEFT JOIN p ON c_custkey = p.o_custkey""")
def j5_merge_coalesce(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    c = read(spark, sf_dir, "customer").withColumn("o_custkey", F.col("c_custkey"))
    how = {"add": o, "source": "d", "by": ["o_custkey"], "order": ["d"]}
    return joins.merge_coalesce(c, "TRTEDT", [how | {"mode": "last", "filter": "o_orderstatus = 'F'"}, how | {"mode": "first"}]).select("c_custkey", "TRTEDT")


DAILY_SQL = "SELECT user_id, event_type AS PARAMCD, ts::DATE AS ADT, round(sum(value), 2) AS AVAL FROM events GROUP BY 1, 2, 3"


def daily(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ADT", F.to_date("ts"))
    return e.groupBy("user_id", "PARAMCD", "ADT").agg(F.round(F.sum("AVAL"), 2).alias("AVAL"))


@query(f"""WITH d AS ({DAILY_SQL}), a AS (SELECT user_id, ADT, max(AVAL) FILTER (PARAMCD = 'click') AS click, max(AVAL) FILTER (PARAMCD = 'view') AS view FROM d GROUP BY 1, 2)
SELECT user_id, PARAMCD, ADT, round(AVAL, 4) AS AVAL, NULL AS PARAM FROM d UNION ALL
SELECT user_id, 'CTR', ADT, round(100 * click / nullif(view, 0), 4), 'Click rate' FROM a WHERE click IS NOT NULL AND view IS NOT NULL""")
def a1_compute_param(spark, sf_dir):
    out = records.compute_param(daily(spark, sf_dir), "CTR", "Click rate", ["click", "view"], "try_divide(100 * click, view)", ["user_id", "ADT"])
    return out.withColumn("AVAL", F.round("AVAL", 4)).select("user_id", "PARAMCD", "ADT", "AVAL", "PARAM")


@query(f"""WITH e AS ({E_SQL}) SELECT event_id, user_id, PARAMCD, round(AVAL, 4) AS AVAL FROM e UNION ALL
SELECT NULL, user_id, 'MED', round(median(AVAL), 4) FROM e GROUP BY user_id UNION ALL SELECT NULL, user_id, 'MEAN', round(avg(AVAL), 4) FROM e GROUP BY user_id""")
def a2_summary_record(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "PARAMCD", "AVAL")
    out = records.summary_record(e, "MED", None, ["user_id"], "median")
    out = records.summary_record(out, "MEAN", None, ["user_id"], "mean", filter="PARAMCD <> 'MED'")
    return out.withColumn("AVAL", F.round("AVAL", 4))


@query("""WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS TOTAL FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, TOTAL FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def a3_merge_summary(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("o_custkey", F.col("c_custkey"))
    return records.merge_summary(c, read(spark, sf_dir, "orders"), "TOTAL", ["o_custkey"], F.round(F.sum(F.col("o_totalprice").try_cast("double")), 2), "o_orderstatus = 'F'").select("c_custkey", "TOTAL")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def a4_first_per_key(spark, sf_dir):
    return records.first_per_key(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber FROM lineitem")
def a4_distinct_pairs(spark, sf_dir):
    return records.distinct_pairs(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("""WITH v AS (SELECT o_custkey, min(o_orderdate::DATE) AS d1, min(o_orderdate::DATE) FILTER (o_orderstatus = 'F') AS d2, max(o_orderdate::DATE) AS last FROM orders GROUP BY 1)
SELECT o_custkey, (greatest(coalesce(least(last, coalesce(d2 - 1, last)) - d1 + 1, 0), 0) * 54 + greatest(coalesce(last - d2 + 1, 0), 0) * 81)::DOUBLE AS CUMDOSE FROM v""")
def a5_interval_dose(spark, sf_dir):
    d = F.to_date("o_orderdate")
    v = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(d).alias("d1"), F.min(F.when(F.col("o_orderstatus") == "F", d)).alias("d2"), F.max(d).alias("last"))
    return records.interval_dose(v, "CUMDOSE", ["d1", "d2"], ["54", "81"], "last").select("o_custkey", "CUMDOSE")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) = 1 THEN 'Y' END AS AOCCFL FROM orders")
def w1_extreme_flag(spark, sf_dir):
    return windows.extreme_flag(read(spark, sf_dir, "orders"), "AOCCFL", ["o_custkey"], ["o_orderdate", "o_orderkey"], "first", restrict="o_orderstatus = 'F'").select("o_orderkey", "AOCCFL")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN row_number() OVER (PARTITION BY o_custkey, o_totalprice > 100000 ORDER BY o_orderkey) END AS SEQ FROM orders")
def w2_restrict_derivation(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return windows.restrict_derivation(o, lambda d: windows.obs_number(d, "SEQ", ["o_custkey"], ["o_orderkey"]), "o_totalprice > 100000").select("o_orderkey", F.col("SEQ").cast("long").alias("SEQ"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ASEQ FROM orders")
def w3_obs_number(spark, sf_dir):
    return windows.obs_number(read(spark, sf_dir, "orders"), "ASEQ", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("ASEQ").cast("long").alias("ASEQ"))


@query("SELECT event_id, CASE WHEN value = max(value) OVER (PARTITION BY user_id, event_type) THEN 'Y' END AS ANL01FL FROM events")
def w4_max_value_flag(spark, sf_dir):
    return windows.max_value_flag(events(spark, sf_dir), "ANL01FL", ["user_id", "PARAMCD"], "AVAL").select("event_id", "ANL01FL")


W_LARGE_SQL = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY ts DESC, event_id DESC) AS back,
max(value) OVER (PARTITION BY event_type) AS most, bool_or(user_id = 3) OVER (PARTITION BY event_type) AS has, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS last FROM events)
SELECT event_id, n AS ASEQ, CASE WHEN value > 50 AND back = 1 THEN 'Y' END AS LASTFL, CASE WHEN value = most THEN 'Y' END AS MAXFL, CASE WHEN user_id = 3 OR (NOT has AND last = 1) THEN 'Y' END AS ENDFL FROM e"""


@query(W_LARGE_SQL)
def w_large_groups(spark, sf_dir):
    """Number and flags within five groups that hold all events, without a task that takes a group."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    by, order = ["event_type"], ["ts", "event_id"]
    out = windows.obs_number(e, "ASEQ", by, order, large_groups=True)
    out = windows.extreme_flag(out, "LASTFL", by, order, "last", restrict="value > 50", large_groups=True)
    out = windows.max_value_flag(out, "MAXFL", by, "value", large_groups=True)
    out = windows.last_or_visit_flag(out, "ENDFL", by, order, "user_id", 3, large_groups=True)
    return out.select("event_id", "ASEQ", "LASTFL", "MAXFL", "ENDFL")


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' OR (NOT bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, ts::DATE)
AND row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1) THEN 'Y' END AS AENTMTFL FROM events""")
def w5_last_or_visit_flag(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ADT", F.to_date("ts"))
    return windows.last_or_visit_flag(e, "AENTMTFL", ["user_id", "ADT"], ["ts", "event_id"], "event_type", "purchase").select("event_id", "AENTMTFL")


@query("""WITH b AS (SELECT c_mktsegment AS g, n_regionkey AS v, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT g, count(*) AS n FROM b GROUP BY g), c AS (SELECT g, v, count(*) AS k FROM b WHERE c_acctbal > 0 GROUP BY g, v)
SELECT 'T2' AS output, 'AN02' AS analysis_id, g AS c_mktsegment, v::VARCHAR AS level, unnest(['count', 'pct']) AS operation, unnest([2, 3]) AS op_order, unnest([k::DOUBLE, round(100.0::DOUBLE * k / n, 4)]) AS value, unnest([printf('%d', k), printf('%.1f', round(100.0::DOUBLE * k / n, 1))]) AS display
FROM c JOIN d USING (g)""")
def n_level_counts(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    c = joins.lookup_join(c, read(spark, sf_dir, "nation"), "REGION", "n_regionkey", ["n_nationkey"])
    spec = {"output": "T2", "analysis_id": "AN02", "variable": "REGION", "operations": ["pct", "count"], "grouping": ["c_mktsegment"], "data_subset": "c_acctbal > 0"}
    return analysis.analysis_table(c, [spec]).withColumn("value", F.round("value", 4))


@query("""WITH k AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS dup FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))
SELECT 'l_comment' AS variable, 'not_all_na' AS "check", 'FAIL' AS status, 'column is absent' AS details
UNION ALL SELECT 'l_quantity', 'not_all_na', 'PASS', count(l_quantity) || ' rows' FROM lineitem
UNION ALL SELECT 'l_quantity', 'non_negative', CASE WHEN count(*) FILTER (l_quantity < 0) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FILTER (l_quantity < 0) || ' rows' FROM lineitem
UNION ALL SELECT 'l_returnflag', 'flag_rate', CASE WHEN count(*) FILTER (l_returnflag <> '') = 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FILTER (l_returnflag <> '') || ' rows' FROM lineitem
UNION ALL SELECT 'l_orderkey', 'key_uniqueness', CASE WHEN dup > 0 THEN 'FAIL' ELSE 'PASS' END, dup || ' duplicated key rows' FROM k
UNION ALL SELECT 'l_returnflag', 'values_in_ct', CASE WHEN count(*) FILTER (l_returnflag NOT IN ('A', 'N')) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) || ' values outside the codelist' FROM lineitem
UNION ALL SELECT 'l_shipDT', 'imputation_flag', 'MANUAL', 'l_shipDTF absent'""")
def c_run_checks(spark, sf_dir):
    codes = spark.createDataFrame([(1, "A"), (2, "N")], "code long, decode string")
    wanted = [("l_comment", "not_all_na"), ("l_quantity", "not_all_na"), ("l_quantity", "non_negative"), ("l_returnflag", "flag_rate"), ("l_orderkey", "key_uniqueness"), ("l_returnflag", "values_in_ct"), ("l_shipDT", "imputation_flag")]
    return checks.run_checks(read(spark, sf_dir, "lineitem"), wanted, ["l_orderkey", "l_linenumber"], {"l_returnflag": codes})


@query("SELECT l_returnflag AS value, count(*) AS n_rows FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 1")
def c5_codelist_violations(spark, sf_dir):
    codes = spark.createDataFrame([(1, "A"), (2, "N")], "code long, decode string")
    return checks.codelist_violations(read(spark, sf_dir, "lineitem"), "l_returnflag", codes)


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def c2_key_duplicates(spark, sf_dir):
    return checks.key_duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT variable, value, count(*) AS n_rows FROM (
SELECT 'l_returnflag' AS variable, l_returnflag AS value FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem WHERE l_linestatus NOT IN ('F')
UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem WHERE l_linenumber NOT IN (1, 2)) GROUP BY 1, 2""")
def c5_codelists_violations(spark, sf_dir):
    codes = lambda *x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "code long, decode string")
    return checks.codelists_violations(read(spark, sf_dir, "lineitem"), {"l_returnflag": codes("A", "N"), "l_linestatus": codes("F"), "l_linenumber": codes("1", "2")})


KEY_SETS = {"line": ["l_orderkey", "l_linenumber"], "order": ["l_orderkey"], "part": ["l_partkey", "l_suppkey"]}


@query(" UNION ALL ".join(f"SELECT '{n}' AS key_set, coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(k)})" for n, k in KEY_SETS.items()))
def c2_key_sets_duplicates(spark, sf_dir):
    return checks.key_sets_duplicates(read(spark, sf_dir, "lineitem"), KEY_SETS)


S6_TEXTS = {
    "customer": "concat_ws('|', c_custkey, coalesce(c_name, 'NULL'), coalesce(c_nationkey::VARCHAR, 'NULL'), coalesce(c_acctbal::DECIMAL(18,2)::VARCHAR, 'NULL'), coalesce(c_mktsegment, 'NULL'))",
    "orders": "concat_ws('|', o_orderkey, o_custkey, coalesce(o_orderstatus, 'NULL'), coalesce(o_totalprice::DECIMAL(18,2)::VARCHAR, 'NULL'), o_orderdate::DATE, coalesce(o_orderpriority, 'NULL'))",
}
S6_COLUMNS = {"customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment", "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority"}
S6_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS source, count(*) AS n_rows, {len(S6_COLUMNS[t].split(','))} AS n_columns, '{S6_COLUMNS[t]}' AS columns, sum(h)::DECIMAL(38,0) AS digest_sum, bit_xor(h) AS digest_xor FROM (SELECT ('0x' || substr(md5({text}), 1, 15))::BIGINT AS h FROM {t})"
    for t, text in S6_TEXTS.items()
)


def snapshots(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    o = read(spark, sf_dir, "orders").withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate": F.to_date("o_orderdate")})
    return checks.table_snapshot(c, "customer", "md5").unionByName(checks.table_snapshot(o, "orders", "md5"))


@query(S6_SQL)
def s6_table_snapshot(spark, sf_dir):
    return snapshots(spark, sf_dir)


@query(f"SELECT count(*) AS n_sources, sum(n_rows)::BIGINT AS n_rows FROM ({S6_SQL})")
def s6_snapshot_rollup(spark, sf_dir):
    return checks.snapshot_rollup(snapshots(spark, sf_dir)).drop("digest")


TREE_WIDTH, TREE_FANOUT = 100, 8


def two_days(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders, and as they are a day later: some prices changed, rows gone and added, all within a few ranges of keys."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    at = F.col("o_orderkey") % 1000
    later = o.where(at != 5).withColumn("o_totalprice", F.when(at.isin(1, 2), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"))
    return o, later.unionByName(o.where(at == 7).withColumn("o_orderkey", -F.col("o_orderkey")))


DAYS_SQL = """b AS (SELECT o_orderkey, o_totalprice FROM orders),
c AS (SELECT o_orderkey, 'removed' AS change, 1 AS n_before, 0 AS n_after FROM b WHERE o_orderkey % 1000 = 5 UNION ALL SELECT o_orderkey, 'changed', 1, 1 FROM b WHERE o_orderkey % 1000 IN (1, 2)
UNION ALL SELECT -o_orderkey, 'added', 0, 1 FROM b WHERE o_orderkey % 1000 = 7)"""


@query(f"WITH {DAYS_SQL} SELECT o_orderkey, change, n_before::BIGINT AS n_before, n_after::BIGINT AS n_after FROM c")
def s6_changed_rows(spark, sf_dir):
    """Rows that differ between two snapshots, read from the ranges of keys whose digests differ."""
    days = two_days(spark, sf_dir)
    ranges = checks.changed_ranges(*[checks.snapshot_tree(d, "orders", "o_orderkey", TREE_WIDTH, fanout=TREE_FANOUT) for d in days], fanout=TREE_FANOUT)
    return checks.changed_rows(*days, ranges, "o_orderkey", TREE_WIDTH)


@query(f"WITH {DAYS_SQL} SELECT DISTINCT floor(o_orderkey / {TREE_WIDTH}.0)::BIGINT AS range FROM c")
def s6_changed_ranges(spark, sf_dir):
    days = two_days(spark, sf_dir)
    return checks.changed_ranges(*[checks.snapshot_tree(d, "orders", "o_orderkey", TREE_WIDTH, fanout=TREE_FANOUT) for d in days], fanout=TREE_FANOUT)


LABEL_SPEC = [("o_orderkey", "Order"), ("o_orderstatus", "Status"), ("o_orderdate", "Date of Order")]


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, '{label}' AS label, count({c}) AS n_values FROM orders" for c, label in LABEL_SPEC))
def s3_labels(spark, sf_dir):
    """Labels travel with the columns; what is labelled is counted."""
    o = finalize.set_labels(read(spark, sf_dir, "orders"), dict(LABEL_SPEC)).where("o_orderkey IS NOT NULL").select(*[c for c, _ in LABEL_SPEC])
    told = finalize.labels_of(o)
    counted = o.agg(*[F.count(c).alias(c) for c in told])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(label).alias("label"), F.col(c).alias("n_values")) for c, label in told.items()])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


ORDER_COLUMNS = [
    {"name": "o_orderkey", "dataType": "integer"},
    {"name": "o_orderstatus", "dataType": "string", "label": "Status"},
    {"name": "o_totalprice", "dataType": "double"},
    {"name": "o_orderdate", "dataType": "date", "targetDataType": "Date"},
    {"name": "seen", "dataType": "datetime", "targetDataType": "Datetime"},
    {"name": "open", "dataType": "boolean"},
]


def orders_for_dataset(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.withColumns({"o_orderdate": F.to_date("o_orderdate"), "seen": F.expr("timestampadd(SECOND, o_orderkey % 86400, o_orderdate)"), "open": F.col("o_orderstatus") == "O"})


def orders_document(spark, sf_dir) -> str:
    path = scratch(spark, "dataset")
    dataset_json.write_dataset_ndjson(orders_for_dataset(spark, sf_dir), path, "ORDERS", ORDER_COLUMNS)
    return path


TYPED_SQL = "SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate__raw, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS seen, o_orderstatus = 'O' AS open FROM orders"


@query(TYPED_SQL)
def s1_read_dataset_ndjson(spark, sf_dir):
    """A table written as a dataset and read back, typed by its metadata."""
    out = dataset_json.read_dataset_ndjson(spark, orders_document(spark, sf_dir))
    return out.withColumn("seen", F.col("seen").cast("timestamp_ntz")).drop("seen__raw")


#: Bytes of one range of the document below, few enough for many ranges on small tables.
RANGE_BYTES = 200_000


@query(TYPED_SQL)
def s1_read_dataset_json(spark, sf_dir):
    """A table written as one JSON object in one file, and read back in ranges."""
    path = scratch(spark, "document")
    dataset_json.write_dataset_json(orders_for_dataset(spark, sf_dir), path, "ORDERS", ORDER_COLUMNS)
    out = dataset_json.read_dataset_json(spark, json_ranges.qualified(spark, path)[0], split=RANGE_BYTES)
    return out.withColumn("seen", F.col("seen").cast("timestamp_ntz")).drop("seen__raw")


@query("""SELECT o_orderkey::DOUBLE AS OKEY, o_orderstatus AS STATUS, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS PRICE, CASE WHEN o_orderkey % 5 = 0 THEN '.' END AS PRICE__missing, o_orderdate::DATE AS ODT FROM orders""")
def s5_read_xport(spark, sf_dir):
    """A table written as transport files and some of its variables read back in ranges of rows, with missing codes."""
    path = scratch(spark, "xport")
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("OKEY"), F.col("o_custkey").alias("CKEY"), F.col("o_orderstatus").alias("STATUS"), price.alias("PRICE"), F.to_date("o_orderdate").alias("ODT"))
    xport.write_xport(o, path, "ORDERS")
    return xport.read_xport(spark, path, ["OKEY", "STATUS", "PRICE", "ODT"], codes=True, split=RANGE_BYTES).drop("OKEY__missing", "ODT__missing")


@query("SELECT 'ORDERS' AS name, '1.1.0' AS version, count(*) AS records, 'o_orderkey:integer,o_orderstatus:string,o_totalprice:double,o_orderdate:date,seen:datetime,open:boolean' AS columns FROM orders")
def s2_dataset_meta(spark, sf_dir):
    header, columns = dataset_json.dataset_ndjson_meta(spark, orders_document(spark, sf_dir))
    listed = columns.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "dataType"))), lambda c: F.concat_ws(":", c["name"], c["dataType"])), ",").alias("columns"))
    return header.join(listed, "path").select("name", F.col("datasetJSONVersion").alias("version"), "records", "columns")


@query("""SELECT event_type AS PARAMCD, unnest(['n', 'mean', 'sd', 'min', 'max']) AS operation, unnest(['any', 'numeric', 'numeric', 'numeric', 'numeric']) AS scale, unnest(['XX', 'XX.X', 'XX.XX', 'XX.X', 'XX.X']) AS pattern,
round(unnest([count(value)::DOUBLE, avg(value), stddev_samp(value), min(value), max(value)]), 4) AS value FROM events GROUP BY 1""")
def n11_method_spec(spark, sf_dir):
    """Statistics beside the methods that they are specified by."""
    names = ["max", "n", "sd", "mean", "min"]
    methods = spark.createDataFrame([(m["operation"], m["scale"], m["pattern"]) for m in analysis.method_spec(names)], "operation string, scale string, pattern string")
    got = analysis.analysis(events(spark, sf_dir), "T3", "AN03", "AVAL", names, ["PARAMCD"])
    return got.join(F.broadcast(methods), "operation").select("PARAMCD", "operation", "scale", "pattern", F.round("value", 4).alias("value"))  # a row per operation


def perturbed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders, and a copy with some prices shifted, some statuses missing, some rows absent."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.to_date("o_orderdate").alias("ODT"))
    other = o.filter("o_orderkey % 10 <> 0").withColumns({
        "o_totalprice": F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 0.3).otherwise(0.0),
        "o_orderstatus": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")),
        "ODT": F.datediff("ODT", F.lit("1960-01-01").cast("date")),
    })
    return o, other


P_SQL = """o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate::DATE AS ODT FROM orders),
p AS (SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 0.3 ELSE 0.0 END::DOUBLE AS o_totalprice, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus FROM o WHERE o_orderkey % 10 <> 0),
j AS (SELECT count(*) AS n, round(100 * avg((abs(o.o_totalprice - p.o_totalprice) <= 1e-6)::INT::DOUBLE), 1) AS price,
round(100 * avg((abs(round(o.o_totalprice, 0) - p.o_totalprice) <= 1e-6)::INT::DOUBLE), 1) AS price_rounded,
round(100 * avg(coalesce(o.o_orderstatus = p.o_orderstatus, false)::INT::DOUBLE), 1) AS status,
round(100 * avg(((o.o_orderstatus IS NULL) = (p.o_orderstatus IS NULL))::INT::DOUBLE), 1) AS na_status FROM o JOIN p USING (o_orderkey))"""
ACC_SQL = f"""WITH {P_SQL}, acc AS (
SELECT 'o_custkey' AS variable, 'id' AS status, round(100 * avg((o_custkey IN (SELECT o_custkey FROM p))::INT::DOUBLE), 1) AS value_agree, NULL::DOUBLE AS value_agree_rounded, count(*) AS n_joined, NULL::DOUBLE AS na_agree FROM o
UNION ALL SELECT 'o_orderkey', 'join_key', NULL, NULL, NULL, NULL
UNION ALL SELECT 'o_clerk', 'not_produced', NULL, NULL, NULL, NULL
UNION ALL SELECT 'o_totalprice', 'compared', price, price_rounded, n, 100.0 FROM j
UNION ALL SELECT 'o_orderstatus', 'compared', status, NULL, n, na_status FROM j
UNION ALL SELECT 'ODT', 'compared', 100.0, NULL, n, 100.0 FROM j) """


def accuracy_table(spark, sf_dir) -> DataFrame:
    ours, oracle = perturbed(spark, sf_dir)
    return compare.compare_datasets(ours, oracle, ["o_custkey", "o_orderkey", "o_clerk", "o_totalprice", "o_orderstatus", "ODT"], ["o_orderkey"], "o_custkey", round_digits={"o_totalprice": 0})


@query(ACC_SQL + "SELECT * FROM acc")
def o1_compare_datasets(spark, sf_dir):
    return accuracy_table(spark, sf_dir)


def repeated_lines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Order lines by order alone, a key that repeats, and a copy with some lines gone, some quantities changed."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    other = li.where("(l_orderkey + l_linenumber) % 9 <> 0").withColumn("l_quantity", F.col("l_quantity") + F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0, 100).otherwise(0))
    return li.drop("l_linenumber"), other.drop("l_linenumber")


LINES_SQL = """l AS (SELECT l_orderkey AS k, l_quantity::DOUBLE AS q, l_returnflag AS f FROM lineitem),
r AS (SELECT l_orderkey AS k, (l_quantity + CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 100 ELSE 0 END)::DOUBLE AS q, l_returnflag AS f FROM lineitem WHERE (l_orderkey + l_linenumber) % 9 <> 0),
ln AS (SELECT *, row_number() OVER (PARTITION BY k, q, f) AS j FROM l), rn AS (SELECT *, row_number() OVER (PARTITION BY k, q, f) AS j FROM r),
eq AS (SELECT ln.k, ln.q, ln.f, ln.q AS q2, ln.f AS f2 FROM ln JOIN rn ON ln.k = rn.k AND ln.q = rn.q AND ln.f = rn.f AND ln.j = rn.j),
lo AS (SELECT k, q, f, row_number() OVER (PARTITION BY k ORDER BY q, f, j) AS n FROM ln WHERE NOT EXISTS (SELECT 1 FROM rn WHERE ln.k = rn.k AND ln.q = rn.q AND ln.f = rn.f AND ln.j = rn.j)),
ro AS (SELECT k, q, f, row_number() OVER (PARTITION BY k ORDER BY q, f, j) AS n FROM rn WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.k = rn.k AND ln.q = rn.q AND ln.f = rn.f AND ln.j = rn.j)),
m AS (SELECT k, 'equal' AS kind, q, f, q2, f2 FROM eq UNION ALL
SELECT coalesce(lo.k, ro.k), CASE WHEN ro.n IS NULL THEN 'ours' WHEN lo.n IS NULL THEN 'oracle' ELSE 'paired' END, lo.q, lo.f, ro.q, ro.f FROM lo FULL JOIN ro ON lo.k = ro.k AND lo.n = ro.n)"""


@query(f"WITH {LINES_SQL} SELECT kind, count(*)::BIGINT AS n_pairs, count(DISTINCT k) AS n_keys FROM m GROUP BY kind")
def o1_match_repeated_keys(spark, sf_dir):
    return compare.match_summary(compare.match_records(*repeated_lines(spark, sf_dir), ["l_quantity", "l_returnflag"], ["l_orderkey"]))


@query(f"""WITH {LINES_SQL}, p AS (SELECT * FROM m WHERE kind IN ('equal', 'paired'))
SELECT 'l_quantity' AS variable, 'compared' AS status, round(100 * avg((abs(q - q2) <= 1e-6)::INT::DOUBLE), 1) AS value_agree, NULL::DOUBLE AS value_agree_rounded, count(*) AS n_joined, 100.0 AS na_agree FROM p
UNION ALL SELECT 'l_returnflag', 'compared', round(100 * avg((f = f2)::INT::DOUBLE), 1), NULL, count(*), 100.0 FROM p""")
def o1_compare_repeated_keys(spark, sf_dir):
    ours, oracle = repeated_lines(spark, sf_dir)
    return compare.compare_datasets(ours, oracle, ["l_quantity", "l_returnflag"], ["l_orderkey"], "l_orderkey", repeated="match")


@query(ACC_SQL + """SELECT count(*) FILTER (status = 'compared') AS n_compared, count(*) FILTER (status = 'compared' AND value_agree = 100) AS n_full,
count(*) FILTER (status = 'compared' AND value_agree < 100) AS n_partial, round(avg(value_agree) FILTER (status = 'compared'), 1) AS mean_agree,
(SELECT count(*) FROM o) AS n_ours, (SELECT count(*) FROM p) AS n_oracle FROM acc""")
def o2_compare_headline(spark, sf_dir):
    ours, oracle = perturbed(spark, sf_dir)
    return compare.compare_headline(accuracy_table(spark, sf_dir), ours, oracle)


@query(f"""WITH {P_SQL} SELECT o.o_orderstatus, count(*) AS n_mismatch FROM o JOIN p USING (o_orderkey) WHERE NOT coalesce(abs(o.o_totalprice - p.o_totalprice) <= 1e-6, false) GROUP BY 1""")
def o3_mismatch_distribution(spark, sf_dir):
    ours, oracle = perturbed(spark, sf_dir)
    return compare.mismatch_distribution(compare.mismatch_rows(ours, oracle, "o_totalprice", ["o_orderkey"], extra=["o_orderstatus"]), "o_orderstatus")


@query(ACC_SQL + "SELECT variable, value_agree FROM acc WHERE status = 'compared' AND value_agree < 100 AND variable <> 'o_orderstatus'")
def o4_silent_errors(spark, sf_dir):
    ours, _ = perturbed(spark, sf_dir)
    told = checks.run_checks(ours.withColumn("o_orderstatus", F.lit("")), [("o_totalprice", "non_negative"), ("o_orderstatus", "flag_rate")])
    ran = spark.createDataFrame([("o_totalprice", "executed"), ("o_orderstatus", "executed"), ("ODT", "executed")], "variable string, status string")
    return compare.silent_errors(accuracy_table(spark, sf_dir), ran, told)


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS lab, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, max(n) OVER (PARTITION BY l_orderkey) AS top FROM c)
SELECT l_orderkey, string_agg(lab || ':' || n, '; ' ORDER BY lab) AS votes, CASE WHEN count(*) FILTER (n = top) = 1 THEN max(lab) FILTER (n = top) END AS label,
count(*) = 1 AS unanimous, count(*) FILTER (n = top) <> 1 AS needs_review FROM t GROUP BY l_orderkey""")
def g1_consensus_vote(spark, sf_dir):
    return agree.consensus_vote(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


LEVELS = {"abstained": lambda c: c.isNull(), "full": lambda c: c}


@query("""SELECT 'abstained' AS level, count(*) AS n_items, round(avg(((quality IS NULL) = (toxic IS NULL))::INT::DOUBLE), 6) AS agree_rate FROM labels
UNION ALL SELECT 'full', count(*), round(avg((quality IS NOT DISTINCT FROM toxic)::INT::DOUBLE), 6) FROM labels""")
def g2_agreement_rates(spark, sf_dir):
    return agree.agreement_rates(read(spark, sf_dir, "labels"), ["quality", "toxic"], LEVELS).withColumn("agree_rate", F.round("agree_rate", 6))


@query("SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels WHERE ((quality IS NULL) = (toxic IS NULL)) AND quality IS DISTINCT FROM toxic")
def g2_inflated_items(spark, sf_dir):
    out = agree.inflated_items(read(spark, sf_dir, "labels"), ["quality", "toxic"], LEVELS["abstained"], LEVELS["full"])
    return out.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


@query("SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n_items FROM labels GROUP BY 1, 2")
def g3_agreement_crosstab(spark, sf_dir):
    out = agree.agreement_crosstab(read(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), "n_items")


def voters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf_dir, "labels")
    a = v.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("quality").cast("string")).alias("label"))
    return a, v.filter("doc_id % 5 <> 0").select("doc_id", F.col("toxic").cast("string").alias("label"))


V_SQL = """a AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN quality::VARCHAR END AS label_a FROM labels), b AS (SELECT doc_id, toxic::VARCHAR AS label_b FROM labels WHERE doc_id % 5 <> 0),
d AS (SELECT doc_id, label_a, label_b, CASE WHEN label_a IS NOT DISTINCT FROM label_b THEN 'agree' WHEN label_a IS NULL THEN 'a_abstain' WHEN label_b IS NULL THEN 'b_abstain' ELSE 'disagree' END AS class FROM a FULL JOIN b USING (doc_id))"""


@query(f"WITH {V_SQL} SELECT * FROM d")
def g4_dual_compare(spark, sf_dir):
    return agree.dual_compare(*voters(spark, sf_dir), "doc_id", "label")


@query(f"WITH {V_SQL} SELECT count(*) AS n_items, round(avg((class = 'agree')::INT::DOUBLE), 6) AS agree_rate, count(*) FILTER (class <> 'agree') AS n_review FROM d")
def g4_dual_rate(spark, sf_dir):
    return agree.dual_rate(agree.dual_compare(*voters(spark, sf_dir), "doc_id", "label")).withColumn("agree_rate", F.round("agree_rate", 6))


@query("""SELECT count(*) AS n_items, round(avg(coalesce(p.toxic = t.quality, false)::INT::DOUBLE), 6) AS accuracy FROM labels t LEFT JOIN (SELECT * FROM labels WHERE doc_id % 5 <> 0) p USING (doc_id)""")
def g5_accuracy(spark, sf_dir):
    v = read(spark, sf_dir, "labels")
    pred, truth = v.filter("doc_id % 5 <> 0").select("doc_id", F.col("toxic").alias("label")), v.select("doc_id", F.col("quality").alias("label"))
    return agree.accuracy(pred, truth, "doc_id", "label").withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT o_custkey::BIGINT AS SUBJECT, o_totalprice::DOUBLE AS AVAL, o_orderdate::DATE AS ADT FROM orders")
def s4_conform(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "SUBJECT", "o_totalprice": "AVAL", "o_orderdate": "ADT"})
    spec = [{"variable": "SUBJECT", "type": "integer", "label": "Subject"}, {"variable": "AVAL", "type": "float"}, {"variable": "ADT", "type": "date"}]
    return finalize.conform(o, spec)


def domains(spark, sf_dir) -> dict[str, DataFrame]:
    """The tables in the roles of trial domains: customers are subjects, orders doses, events findings and occurrences."""
    c, o, e = (read(spark, sf_dir, t) for t in ("customer", "orders", "events"))
    study, subject = F.lit("S1").alias("STUDYID"), lambda x: F.col(x).cast("string").alias("USUBJID")
    iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    findings = [study, subject("user_id"), F.col("event_id").alias("{}SEQ"), F.col("event_type").alias("{}TESTCD"), F.col("value").alias("{}STRESN"), F.expr(iso.format("ts")).alias("{}DTC"), F.dayofmonth("ts").alias("VISITNUM")]

    def named(prefix: str) -> DataFrame:
        out = e.select(*findings)
        return out.withColumnsRenamed({n: n.format(prefix) for n in out.columns})

    day = "yyyy-MM-dd"
    arm = F.col("c_custkey") % 3
    visit = (F.col("o_orderkey") % 13).cast("int").alias("VISITNUM")
    return {
        "dm": c.select(
            study, subject("c_custkey"), F.col("c_nationkey").cast("string").alias("SITEID"), F.col("c_mktsegment").alias("RACE"), F.col("c_mktsegment").alias("ARM"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise("A").alias("ARMCD"), arm.alias("ARMN"),
            (arm * 27).cast("double").alias("TRT01PN"), F.date_sub(F.lit("1990-06-15").cast("date"), (F.col("c_custkey") % 90 * 365).cast("int")).alias("BRTHDT"),
            F.date_format(F.date_add(F.lit("1997-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")), "yyyy-MM").alias("RFENDTC"),
        ),
        "ex": o.select(study, subject("o_custkey"), (F.col("o_totalprice") - 50000).alias("EXDOSE"), F.date_format("o_orderdate", day).alias("EXSTDTC"), F.when(F.col("o_custkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("EXENDTC")),
        "sv": o.select(study, subject("o_custkey"), visit, F.date_format("o_orderdate", day).alias("SVSTDTC")),
        "ds": o.select(study, subject("o_custkey"), visit, F.when(F.col("o_orderstatus") == "P", "ADVERSE EVENT").otherwise("COMPLETED").alias("DSDECOD"), F.date_format("o_orderdate", day).alias("DSSTDTC"), F.when(F.col("o_orderkey") % 4 == 0, "DISPOSITION EVENT").otherwise("OTHER EVENT").alias("DSCAT"), F.when(F.col("o_orderkey") % 3 == 0, "PROTCOL COMPLETED").alias("DSTERM")),
        "sc": c.select(study, subject("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "EDLEVEL").otherwise("OTHER").alias("SCTESTCD"), (F.col("c_custkey") % 20).cast("double").alias("SCSTRESN")),
        "qs": e.select(study, subject("user_id"), (F.col("event_id") % 12).cast("int").alias("VISITNUM"), F.expr("CASE event_type WHEN 'click' THEN 'ADAS-COG' WHEN 'view' THEN 'CIBIC+' WHEN 'signup' THEN 'MINI-MENTAL STATE' END").alias("QSCAT"), F.floor("value").cast("string").alias("QSORRES")),
        "mh": c.select(study, subject("c_custkey"), F.lit("PRIMARY DIAGNOSIS").alias("MHCAT"), F.date_format(F.date_add(F.lit("1985-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")), "yyyy-MM").alias("MHSTDTC")),
        "vs": c.select(
            study, subject("c_custkey"),
            F.explode(F.array(*[F.struct(F.lit(code).alias("VSTESTCD"), F.lit(visit).alias("VISITNUM"), value.alias("VSSTRESN")) for code, visit, value in (
                ("WEIGHT", 3, (F.col("c_custkey") % 50 + 50).cast("double")), ("WEIGHT", 1, F.lit(1.0)), ("HEIGHT", 1, (F.col("c_custkey") % 40 + 150).cast("double")), ("HEIGHT", 3, F.lit(2.0)),
            )])).alias("m"),
        ).select("STUDYID", "USUBJID", "m.*"),
        "findings": named,
        "subjects": c.select(study, subject("c_custkey"), F.date_add(F.lit("2024-01-08").cast("date"), (F.col("c_custkey") % 14).cast("int")).cast("timestamp").alias("TRTSDTM")),
        "ae": e.select(study, subject("user_id"), F.col("event_id").alias("AESEQ"), F.col("event_type").alias("AEDECOD"), F.concat(F.lit("SOC"), (F.col("event_id") % 3).cast("string")).alias("AEBODSYS"), F.when(F.col("value") > 50, "Y").otherwise("N").alias("AESER"), F.expr(iso.format("ts")).alias("AESTDTC"), F.lit(None).cast("string").alias("AEENDTC")),
    }


@query(f"""WITH x AS (SELECT o_custkey, min(o_orderdate::DATE) AS s, last_day(max(CASE WHEN o_custkey % 4 <> 0 THEN o_orderdate::DATE END)) AS e FROM orders WHERE o_totalprice > 50000 GROUP BY 1), l AS ({SEGMENTS_SQL}),
v AS (SELECT o_custkey, min(o_orderdate::DATE) FILTER (o_orderkey % 13 = 1) AS v1, min(o_orderdate::DATE) FILTER (o_orderkey % 13 = 4) AS v4, min(o_orderdate::DATE) FILTER (o_orderkey % 13 = 12) AS v12,
 min(o_orderdate::DATE) FILTER (o_orderkey % 13 = 8) AS v8, min(o_orderdate::DATE) FILTER (o_orderkey % 13 = 10) AS v10, min(o_orderdate::DATE) FILTER (o_orderstatus = 'P' AND o_orderkey % 13 > 3) AS disc FROM orders GROUP BY 1),
q AS (SELECT user_id, bool_or(event_type = 'click' AND event_id % 12 > 3) AS adas, bool_or(event_type = 'view' AND event_id % 12 > 3) AS cibic, sum(floor(value)) FILTER (event_type = 'signup') AS mm FROM events GROUP BY 1),
dd AS (SELECT o_custkey, arg_min(CASE WHEN o_orderstatus = 'P' THEN 'ADVERSE EVENT' ELSE 'COMPLETED' END, (o_orderdate::DATE, o_orderkey % 13, CASE WHEN o_orderstatus = 'P' THEN 'ADVERSE EVENT' ELSE 'COMPLETED' END)) FILTER (o_orderkey % 4 = 0) AS dc,
 max(o_orderkey % 13) FILTER (o_orderkey % 3 = 0)::INTEGER AS visend FROM orders GROUP BY 1),
sn AS (SELECT c_nationkey AS site, c_mktsegment AS arm, count(*) AS n FROM customer GROUP BY 1, 2),
sp AS (SELECT site, sum(n) AS total, min(n) < 9 OR count(*) < (SELECT count(DISTINCT arm) FROM sn) AS small FROM sn GROUP BY site),
pl AS (SELECT count(*) AS held, min(n) AS least FROM (SELECT arm, sum(n) AS n FROM sn WHERE site IN (SELECT site FROM sp WHERE small) GROUP BY arm)),
nx AS (SELECT arg_min(site, (total, site::VARCHAR)) AS site FROM sp WHERE NOT small),
sg AS (SELECT site, CASE WHEN small OR ((SELECT held > 0 AND (least < 9 OR held < (SELECT count(DISTINCT arm) FROM sn)) FROM pl) AND site IS NOT DISTINCT FROM (SELECT site FROM nx)) THEN '900' ELSE site::VARCHAR END AS pooled FROM sp),
a AS (SELECT c_custkey AS k, c_mktsegment, s, coalesce(e, disc) AS e, v1, v4, v8, v10, v12, adas, cibic, mm, code, last_day(DATE '1997-01-01' + (c_custkey % 900)::INTEGER) AS rfend, dc, visend, c_nationkey AS site,
 DATE '1990-06-15' - (c_custkey % 90 * 365)::INTEGER AS birth, date_trunc('month', DATE '1985-01-01' + (c_custkey % 3000)::INTEGER)::DATE AS onset
 FROM customer LEFT JOIN x ON c_custkey = x.o_custkey LEFT JOIN v ON c_custkey = v.o_custkey LEFT JOIN q ON c_custkey = user_id LEFT JOIN dd ON c_custkey = dd.o_custkey LEFT JOIN l ON c_mktsegment = decode),
b AS (SELECT *, (e - s + CASE WHEN e >= s THEN 1 ELSE 0 END)::DOUBLE AS dur, CASE WHEN s >= birth THEN year(s) - year(birth) - CASE WHEN strftime(s, '%m%d') < strftime(birth, '%m%d') THEN 1 ELSE 0 END
 ELSE -(year(birth) - year(s) - CASE WHEN strftime(birth, '%m%d') < strftime(s, '%m%d') THEN 1 ELSE 0 END) END::DOUBLE AS age, (k % 10 <> 0 AND s IS NOT NULL) AS safe,
 54.0::DOUBLE * greatest(coalesce(least(e, coalesce(v4, e)) - s + 1, 0), 0) + 81.0::DOUBLE * greatest(coalesce(least(e, coalesce(v12, e)) - (v4 + 1) + 1, 0), 0) + 54.0::DOUBLE * greatest(coalesce(e - (v12 + 1) + 1, 0), 0) AS titrated FROM a),
c AS (SELECT *, CASE WHEN k % 3 = 2 THEN CASE WHEN e IS NOT NULL THEN titrated END ELSE (k % 3) * 27 * dur END::DOUBLE AS cum FROM b)
SELECT k::VARCHAR AS USUBJID, c_mktsegment AS TRT01P, s AS TRTSDT, e AS TRTEDT, dur AS TRTDURD, round((k % 50 + 50) / power((k % 40 + 150) / 100.0, 2), 4) AS BMIBL, age AS AGE,
CASE WHEN age < 0 THEN NULL WHEN age < 18 THEN '<18' WHEN age < 65 THEN '18-64' WHEN age <= 200 THEN '>=65' END AS AGEGR1, code AS RACEN, CASE WHEN safe THEN 'Y' ELSE 'N' END AS SAFFL,
CASE WHEN safe AND coalesce(adas, false) AND coalesce(cibic, false) THEN 'Y' ELSE 'N' END AS EFFFL, mm AS MMSETOT, v1 AS VISIT1DT,
CASE WHEN coalesce(v8 <= rfend, false) THEN 'Y' ELSE 'N' END AS COMP8FL, CASE WHEN coalesce(v10 <= rfend, false) THEN 'Y' ELSE 'N' END AS COMP16FL, CASE WHEN coalesce(v12 <= rfend, false) THEN 'Y' ELSE 'N' END AS COMP24FL,
cum AS CUMDOSE, round(cum / nullif(dur, 0), 4) + 0.0 AS AVGDD, round((v1 - onset) / 30.4375::DOUBLE, 4) AS DURDIS,
c_mktsegment AS TRT01A, (k % 3 * 27)::DOUBLE AS TRT01AN, (k % 40 + 150)::DOUBLE AS HEIGHTBL, (k % 50 + 50)::DOUBLE AS WEIGHTBL,
CASE WHEN (k % 50 + 50) / power((k % 40 + 150) / 100.0, 2) < 25 THEN '<25' WHEN (k % 50 + 50) / power((k % 40 + 150) / 100.0, 2) < 30 THEN '25-<30' ELSE '>=30' END AS BMIBLGR1,
CASE WHEN age < 65 THEN 1 WHEN age <= 80 THEN 2 WHEN age > 80 THEN 3 END AS AGEGR1N, CASE WHEN (v1 - onset) / 30.4375::DOUBLE < 12 THEN '<12' WHEN v1 IS NOT NULL THEN '>=12' END AS DURDSGR1,
dc AS DCDECOD, CASE dc WHEN 'ADVERSE EVENT' THEN 'Adverse event' WHEN 'COMPLETED' THEN 'Completed' END AS DCSREAS, CASE WHEN dc <> 'COMPLETED' THEN 'Y' END AS DISCONFL, CASE WHEN dc = 'ADVERSE EVENT' THEN 'Y' END AS DSRAEFL,
CASE WHEN dc = 'COMPLETED' THEN 'COMPLETED' WHEN dc IS NOT NULL THEN 'DISCONTINUED' END AS EOSSTT, visend AS VISNUMEN, CASE WHEN k % 2 = 0 THEN (k % 20)::DOUBLE END AS EDUCLVL, pooled AS SITEGR1
FROM c LEFT JOIN sg USING (site)""")
def l1_build_adsl(spark, sf_dir):
    d = domains(spark, sf_dir)
    out = pipelines.build_adsl(d["dm"], d["ex"], d["vs"], {"RACE": project.codelist_from_data(d["dm"], "RACE")}, **{k: d[k] for k in ("qs", "sv", "ds", "mh", "sc")}, site_least=9)
    more = ("TRT01A", "TRT01AN", "HEIGHTBL", "WEIGHTBL", "BMIBLGR1", "AGEGR1N", "DURDSGR1", "DCDECOD", "DCSREAS", "DISCONFL", "DSRAEFL", "EOSSTT", "VISNUMEN", "EDUCLVL", "SITEGR1")
    rounded = [F.round(c, 4).alias(c) for c in ("BMIBL", "AVGDD", "DURDIS")]
    return out.select("USUBJID", "TRT01P", "TRTSDT", "TRTEDT", "TRTDURD", "AGE", "AGEGR1", "RACEN", "SAFFL", "EFFFL", "MMSETOT", "VISIT1DT", "COMP8FL", "COMP16FL", "COMP24FL", "CUMDOSE", *rounded, *more)


@query("""WITH n AS (SELECT l_suppkey % 40 AS g, l_returnflag AS arm, count(*) AS n FROM lineitem GROUP BY 1, 2), least AS (SELECT quantile_disc(n, 0.1) AS k FROM n),
p AS (SELECT g, sum(n) AS total, min(n) < (SELECT k FROM least) OR count(*) < 3 AS small FROM n GROUP BY g)
SELECT g::VARCHAR AS SITE, CASE WHEN small THEN '900' ELSE g::VARCHAR END AS SITEGR1, total::BIGINT AS n_rows FROM p""")
def j6_pool_groups(spark, sf_dir):
    """Small groups of suppliers pooled; the pool is large enough by itself. The limit is a tenth of the counts by group and flag."""
    li = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).cast("string").alias("SITE"), "l_returnflag")
    least = li.groupBy("SITE", "l_returnflag").count().agg(F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY count)")).first()[0]
    return joins.pool_groups(li, "SITEGR1", "SITE", "l_returnflag", int(least)).groupBy("SITE", "SITEGR1").agg(F.count(F.lit(1)).alias("n_rows"))


FINDINGS_SQL = """e AS (SELECT event_id AS SEQ, user_id::VARCHAR AS USUBJID, event_type AS PARAMCD, value AS AVAL, date_trunc('second', ts) AS ADTM, (DATE '2024-01-08' + (c_custkey % 14)::INTEGER)::TIMESTAMP AS TRTSDTM, ts FROM events LEFT JOIN customer ON user_id = c_custkey),
f AS (SELECT *, coalesce(ADTM <= TRTSDTM, false) AS ok FROM e),
b AS (SELECT *, CASE WHEN ok AND row_number() OVER (PARTITION BY USUBJID, PARAMCD, ok ORDER BY ADTM DESC, SEQ DESC) = 1 THEN 'Y' END AS ABLFL FROM f),
c AS (SELECT *, max(CASE WHEN ABLFL = 'Y' THEN AVAL END) OVER (PARTITION BY USUBJID, PARAMCD) AS BASE FROM b)"""


def lookup(spark, sf_dir, prefix: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias(f"{prefix}TESTCD")).distinct().withColumn("PARAM", F.upper(f"{prefix}TESTCD"))


@query(f"""WITH {FINDINGS_SQL} SELECT SEQ AS VSSEQ, upper(PARAMCD) AS PARAM, ABLFL, BASE, round(AVAL - BASE, 4) AS CHG, 'mg' AS AVALU,
CASE WHEN SEQ % 3 = 0 THEN 'SCREENING' ELSE 'WEEK ' || SEQ % 3 END AS AVISIT, CASE WHEN PARAMCD = 'purchase' THEN CASE WHEN AVAL < 20 THEN 'LOW' WHEN AVAL > 60 THEN 'HIGH' ELSE 'NORMAL' END END AS ANRIND,
(CASE WHEN ADTM::DATE >= TRTSDTM::DATE THEN ADTM::DATE - TRTSDTM::DATE + 1 ELSE ADTM::DATE - TRTSDTM::DATE END)::INTEGER AS ADY FROM c""")
def l2_build_advs(spark, sf_dir):
    d = domains(spark, sf_dir)
    at = (F.col("VSSEQ") % 3).cast("string")
    vs = d["findings"]("VS").withColumns({"VSSTRESU": F.lit("mg"), "VISIT": F.when(at == "0", "SCREENING 1").otherwise(F.concat(F.lit("WEEK "), at))})
    out = pipelines.build_advs(vs, d["subjects"], lookup(spark, sf_dir, "VS"), {"purchase": (20, 60)})
    return out.select("VSSEQ", "PARAM", "AVALU", "AVISIT", "ANRIND", "ABLFL", "BASE", F.round("CHG", 4).alias("CHG"), "ADY")


@query("""WITH m AS (SELECT user_id, min(date_trunc('second', ts)) AS d FROM events WHERE date_trunc('second', ts) >= (DATE '2024-01-08' + (user_id % 14)::INTEGER)::TIMESTAMP GROUP BY 1)
SELECT c_custkey::VARCHAR AS USUBJID, round(epoch(d - (DATE '2024-01-08' + (c_custkey % 14)::INTEGER)::TIMESTAMP)) / 86400 AS AVAL, (d IS NULL)::INTEGER AS CNSR FROM customer LEFT JOIN m ON user_id = c_custkey""")
def l3_build_adtte(spark, sf_dir):
    d = domains(spark, sf_dir)
    return pipelines.build_adtte(d["subjects"], d["ae"]).select("USUBJID", "AVAL", "CNSR")


def _first(by: str, ok: str) -> str:
    return f"CASE WHEN {ok} AND row_number() OVER (PARTITION BY {by}, {ok} ORDER BY ASTDT, AESEQ) = 1 THEN 'Y' END"


@query(f"""WITH e AS (SELECT event_id AS AESEQ, user_id, event_type AS PT, 'SOC' || (event_id % 3) AS SOC, value > 50 AS ser, ts::DATE AS ASTDT, DATE '2024-01-08' + (c_custkey % 14)::INTEGER AS TRTSDT FROM events LEFT JOIN customer ON user_id = c_custkey),
t AS (SELECT *, coalesce(ASTDT >= TRTSDT, false) AS te, coalesce(ASTDT >= TRTSDT, false) AND ser AS ts, PT LIKE '%click%' OR SOC = 'SOC2' AS skin, last_day(ASTDT) AS AENDT FROM e)
SELECT AESEQ, CASE WHEN te THEN 'Y' END AS TRTEMFL, CASE WHEN skin THEN 'DERMATOLOGIC EVENTS' END AS CQ01NAM, (AENDT - ASTDT + 1)::INTEGER AS ADURN, {_first("user_id", "te AND skin")} AS AOCC01FL, {_first("user_id", "te")} AS AOCCFL, {_first("user_id, SOC", "te")} AS AOCCSFL, {_first("user_id, SOC, PT", "te")} AS AOCCPFL, {_first("user_id", "ts")} AS AOCC02FL,
{_first("user_id, SOC", "ts")} AS AOCC03FL, {_first("user_id, SOC, PT", "ts")} AS AOCC04FL FROM t""")
def l4_build_adae(spark, sf_dir):
    d = domains(spark, sf_dir)
    adsl = d["subjects"].withColumns({"TRTSDT": F.to_date("TRTSDTM"), "TRTEDT": F.lit(None).cast("date")})
    ae = d["ae"].withColumn("AEENDTC", F.substring("AESTDTC", 1, 7))
    return pipelines.build_adae(ae, adsl, words=["click"], system="SOC2").select("AESEQ", "TRTEMFL", "CQ01NAM", "ADURN", "AOCC01FL", "AOCCFL", "AOCCSFL", "AOCCPFL", "AOCC02FL", "AOCC03FL", "AOCC04FL")


@query(f"""WITH {FINDINGS_SQL}, r AS (SELECT *, AVAL / 10 AS R2A1LO, greatest(AVAL - 75, 5 - AVAL) AS trv, day(ts) = 12 AS v FROM c)
SELECT SEQ AS LBSEQ, round(R2A1LO, 4) AS R2A1LO, round(max(CASE WHEN ABLFL = 'Y' THEN R2A1LO END) OVER g, 4) AS BR2A1LO, CASE WHEN trv = max(trv) OVER g THEN 'Y' END AS ANL01FL, 'VISIT ' || day(ts) AS AVISIT, day(ts)::INTEGER AS AVISITN,
CASE WHEN AVAL < 5 THEN 'L' WHEN AVAL > 75 THEN 'H' ELSE 'N' END AS ANRIND, CASE WHEN BASE < 5 THEN 'L' WHEN BASE > 75 THEN 'H' WHEN BASE IS NOT NULL THEN 'N' END AS BNRIND,
CASE WHEN v OR (NOT bool_or(v) OVER g AND row_number() OVER (PARTITION BY USUBJID, PARAMCD ORDER BY day(ts) DESC, SEQ DESC) = 1) THEN 'Y' END AS AENTMTFL
FROM r WINDOW g AS (PARTITION BY USUBJID, PARAMCD)""")
def l5_build_adlbc(spark, sf_dir):
    d = domains(spark, sf_dir)
    lb = d["findings"]("LB").withColumns({"LBSTNRLO": F.lit(10.0), "LBSTNRHI": F.lit(50.0), "VISIT": F.concat(F.lit("VISIT "), F.col("VISITNUM").cast("string"))})
    out = pipelines.build_adlbc(lb, d["subjects"], lookup(spark, sf_dir, "LB"))
    return out.select("LBSEQ", F.round("R2A1LO", 4).alias("R2A1LO"), F.round("BR2A1LO", 4).alias("BR2A1LO"), "ANL01FL", "AVISIT", "AVISITN", "ANRIND", "BNRIND", "AENTMTFL")

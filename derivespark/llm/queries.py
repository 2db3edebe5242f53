"""The corpus operators' queries, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .licenses import COPYRIGHT_LINES, KNOWN, SPELLINGS, license_scan
from .mixing import HASH_RANGE, mix_report
from .near_dedup import near_duplicates
from .neighbours import nearest
from .quality import quality_report
from .resample import importance_resample
from .secrets import RULES, scan_secrets
from .sharding import shard_report
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup
from .warc import archive_report


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"), shards=16)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10, near=NEAR, least=LEAST)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), shortest=7, least=2, ratio=10, typo_every=31)


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, least_words=20, percent=10, seed=2024)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


#: Near matches of ``op6_decontaminate``: words off their place, and the share of a window's words that is there.
NEAR, LEAST = 1, 0.8

QUERIES = {f.__name__: f for f in (op1_warc, op2_exact_dedup, op3_sharding, op4_license_scan, op5_quality, op6_decontaminate, op7_mixing, op8_suffix_dedup, op9_secrets, op10_near_dedup, op11_spelling_variants, op12_importance_resample, op13_nearest_neighbours)}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT_LINES)}, '', 'g')"
    out = f"'  ' || regexp_replace({out}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F©]+', '  ', 'g') || '  '"
    for other, one in SPELLINGS.items():
        out = f"replace({out}, {_quoted(' ' + other.replace(' ', '  ') + ' ')}, {_quoted(' ' + one.replace(' ', '  ') + ' ')})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _secrets_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, m, string_split_regex(text, {_quoted(r.pattern)}) AS gaps, "
        f"v FROM (SELECT *, regexp_extract_all(text, {_quoted(r.pattern)}) AS m, regexp_extract_all(text, {_quoted(r.pattern)}, {r.group}) AS v FROM texts)"
        for k, r in enumerate(RULES)
    )
    least = " ".join(f"WHEN kind = '{r.kind}' THEN {r.least}" for r in RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (
  SELECT doc_id, rank, kind, length(v[i]) AS value, length(m[i]) AS long,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS begin
  FROM each),
spans AS (SELECT doc_id, rank, kind, begin::BIGINT AS begin, (begin + long)::BIGINT AS finish FROM placed WHERE value >= CASE {least} END),
listed AS (
  SELECT doc_id, {counts}, string_agg(kind || ':' || begin || ':' || finish, ',' ORDER BY begin, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)},
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)"""


#: The table of crc32 by its rule, as a relation ``crc`` with the list ``t``; and the checksum of a text with it.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32_sql(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


SPAN = 10 + NEAR
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op2_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOWER.format("text")}) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op4_license_scan": f"""
WITH known AS (
  SELECT min(license_id) AS license_id, sha256({_canonical_sql("text")}) AS digest
  FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in KNOWN.items())}) AS v(license_id, text) GROUP BY 2)
SELECT doc_id, d.digest, license_id
FROM (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents) AS d LEFT JOIN known USING (digest)""",
    "op6_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + 9], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw))),
hits AS (SELECT doc_id, p, size, item_id FROM dw JOIN iw USING (size, words)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
place AS (
  SELECT doc_id, w[p] AS word, w[greatest(p - {SPAN}, 1):p + {SPAN}] AS around, least(p, {SPAN} + 1) AS here
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d)),
freq AS (SELECT word, count(*) AS n FROM place GROUP BY word),
win AS (SELECT DISTINCT words, string_split(words, ' ') AS l FROM iw),
rare AS (
  SELECT words, any_value(l) AS l, array_agg(o ORDER BY n NULLS LAST, o) AS rank
  FROM (SELECT words, l, unnest(l) AS word, generate_subscripts(l, 1) AS o FROM win) LEFT JOIN freq USING (word) GROUP BY words),
nears AS (
  SELECT DISTINCT doc_id, words FROM place JOIN rare ON word = l[rank[1]]
  WHERE len(l) > 1 AND list_contains(around[greatest(here + rank[2] - rank[1] - {NEAR}, 1):here + rank[2] - rank[1] + {NEAR}], l[rank[2]])
    AND list_sum(list_transform(range(1, len(l) + 1), lambda o: list_contains(around[greatest(here + o - rank[1] - {NEAR}, 1):here + o - rank[1] + {NEAR}], l[o])::INTEGER)) >= ceil({LEAST} * len(l))
  UNION SELECT doc_id, words FROM place JOIN win ON words = word WHERE len(l) = 1),
near_items AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM nears JOIN iw USING (words)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near_listed, '')) AS near_items_sha256
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)""",
    "op7_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN level * weight > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size
         ELSE weight * (SELECT arg_min(level, source_size::DOUBLE / weight) FROM levels WHERE NOT level * weight > 2.0::DOUBLE * source_size) END AS target
  FROM levels),
rates AS (SELECT *, coalesce(target / nullif(source_size, 0), 0) AS rate FROM targets)
SELECT doc_id, size, s.source_size, target, size * (floor(rate)::BIGINT + (hash < (rate - floor(rate)) * {HASH_RANGE}::DOUBLE)::BIGINT) AS taken, source
FROM (SELECT z.*, r.source_size, target, rate FROM sized z JOIN rates r ON z.source IS NOT DISTINCT FROM r.source) s""",
    "op9_secrets": _secrets_sql(),
    "op11_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
occurs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM occurs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32_sql("doc_id || ':' || run")} AS h FROM counted, crc),
left_out AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM left_out WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
shorter AS (SELECT DISTINCT gaps.word AS a, words.word AS b FROM gaps JOIN words ON rest = words.word),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM gaps x JOIN gaps y USING (p, rest) WHERE x.word <> y.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM pairs JOIN words ON b = word GROUP BY a),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)),
follow AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT f.word, f.next, g.form FROM follow f JOIN formed g ON f.next = g.word)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN (SELECT word, root FROM follow WHERE next IS NULL) USING (word)""",
    "op12_importance_resample": rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM documents),
ours AS (SELECT row, unnest(w) AS word FROM d),
theirs AS (SELECT unnest(regexp_extract_all({_LOWER.format("text")}, '{_WORD}')) AS word FROM benchmark),
known AS (
  SELECT word, {_crc32_sql("word")} % 10000 AS bucket
  FROM (SELECT word FROM ours UNION SELECT word FROM theirs), crc),
s AS (SELECT bucket, count(*) AS n FROM ours JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM theirs JOIN known USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS all_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (all_s + 10000) / ((s.n + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weighed AS (
  SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM ours JOIN known USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (row)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed""",
}

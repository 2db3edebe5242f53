"""Cases in which an operator once did less than its whole job."""

import gzip
import pathlib
import random
import textwrap
import zlib

import brute
import numpy as np
import pytest
from pyspark.errors import PySparkException

from derivespark.llm import common, decontaminate, exact_dedup, licenses, near_dedup, quality, sharding, suffix_dedup, warc


def test_components_of_a_long_chain_in_any_order(spark):
    for seed, n in ((1, 1000), (None, 100)):
        ids = list(range(n))
        if seed:
            random.Random(seed).shuffle(ids)
        edges = [*zip(ids, ids[1:], strict=False), (n + 7, n + 5), (n + 7, n + 6), (n + 9, n + 9)]
        got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == [(i, 0) for i in range(n)] + [(n + i, n + 5) for i in (5, 6, 7)]
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license_id for r in sorted(licenses.license_scan(rows).collect(), key=lambda r: r.doc_id)]


def test_whole_licence_files_with_titles_wraps_and_bullets(spark):
    wrap = lambda text, width: "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))
    notice = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n"
    texts, want = [], []
    for name, text in licenses.KNOWN.items():
        for width in (50, 66, 72, 79):
            bulleted = wrap(text, width).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
            for body in (wrap(text, width), bulleted):
                texts += [notice + body, f"{licenses.TITLES[name][0]}\n\n{notice}{body}", body + "\n\nAnd you must pay."]
                want += [name, name, None]
    texts += [licenses.MIT.replace("substantial portions", "large portions"), "MIT License", "Copyright notice\n\n" + wrap(licenses.MIT, 72)[:-20]]
    assert scanned(spark, texts) == want + [None] * 3


def test_long_licences(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    named = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1"}
    if not all((folder / f).exists() for f in named):
        pytest.skip("no licence texts here")
    texts = [(folder / f).read_text() for f in named]
    ends = [t[: t.index("END OF TERMS AND CONDITIONS")] for t in texts]
    assert scanned(spark, texts + ends + [t[:-3000] + "x" for t in ends]) == [*named.values()] * 2 + [None] * 4


def test_few_labels_among_many_documents(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 60))) + "."
    bad = lambda: " ".join(w + rng.choice(["###", "%%%"]) for w in good().split())
    docs = spark.createDataFrame([(i, bad() if i % 3 == 0 else good()) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(docs, labels, rows=50).collect()
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in got) > 0.95 * len(got)
    mean, deviation = quality.moments(docs)
    x = np.array([quality.features(r.text.encode()) for r in docs.collect()])
    assert np.allclose(mean, x.mean(axis=0), atol=1e-5) and np.allclose(deviation, x.std(axis=0), atol=1e-2)
    with pytest.raises(ValueError, match="positive labels"):
        quality.train(docs, labels.withColumn("doc_id", labels["doc_id"] + 10000))


def test_rounds_of_windows_write_narrow_rows(spark, monkeypatch, tmp_path, capsys):
    """Each round writes its hits alone; the index is written once however many rounds there are."""
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 4)
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    words = [f"w{i}" for i in range(22)]
    docs = spark.createDataFrame([(f"d{i}", " ".join(words[i : i + 12])) for i in range(12)], "doc_id string, text string")
    bench = spark.createDataFrame([(1, " ".join(words[:20]))], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    found.explain()
    assert "MapInArrow" not in capsys.readouterr().out  # what is found is written before the items are joined to it
    assert {r.doc_id: r.n_hit for r in found.collect()} == {f"d{i}": 12 if i < 9 else 20 - i for i in range(11)} | {"d11": 0}
    written = {p.name.rpartition("-")[0]: p for p in tmp_path.iterdir()}
    assert sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir()).count("positional-index") == 1
    hits = spark.read.parquet(f"file://{written['search-hits']}")
    assert "terms" not in hits.columns and "positions" not in hits.columns and len(hits.inputFiles()) > 1


def test_each_filter_reads_its_own_digests(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = spark.createDataFrame([(i, f"text {i % 3000}") for i in range(4000)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows, filter_bits=2**15).collect()
    assert sum(r.kept for r in got) == 3000 and {r.group_size for r in got} == {1, 2}
    (path,) = [p for p in tmp_path.iterdir() if p.name.startswith("exact-ranges")]
    digests = spark.read.parquet(f"file://{path}")
    ranges = [r[0] for r in digests.select("range").distinct().collect()]
    read = [f for k in ranges for f in digests.where(f"range = {k}")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1:2]]
    assert len(ranges) == 4 and all("range" in f.split("]")[0] for f in read)  # a scan is pruned to its folder
    assert digests.count() == 4000  # written once, whatever the number of filters


def test_ids_that_are_no_numbers(spark):
    rows = spark.createDataFrame([("a1", "one two three four five six"), ("a2", "one two three four five six")], "doc_id string, text string")
    for op in (suffix_dedup.suffix_dedup, near_dedup.near_duplicates):
        with pytest.raises(ValueError, match="whole numbers"):
            op(rows)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contaminated(rows, items).collect()} == {"a1": 3, "a2": 3}


def test_settings_of_the_session_stay(spark, tmp_path):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.python.filterPushdown.enabled")
    before = [spark.conf.get(n, None) for n in names]
    docs = spark.createDataFrame([(i, f"some words of document {i} " * 9) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "words of document 3")], "item_id long, text string")
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    for df in (quality.quality_report(docs, labels), decontaminate.contaminated(docs, items), near_dedup.near_duplicates(docs), suffix_dedup.suffix_dedup(docs), warc.archive_report(pages)):
        df.collect()
    assert [spark.conf.get(n, None) for n in names] == before


def test_sharding_keeps_columns_of_its_own_names(spark):
    names = ["_ring_id", "_ring_crc", "_ring_size", "_ring_part", "_ring_ranges", "_ring_before", "_ring_copy", "_ring_own", "_0_", "range", "n"]
    for copies in (100_000, 3):
        docs = spark.createDataFrame([(i % 7, f"t{i % 7}", *(f"{n}{i}" for n in names), "old") for i in range(50)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names), "SHARD string"]))
        got = sharding.shard_documents(docs, shards=4, copies=copies)
        assert got.columns == ["doc_id", "text", *names, "shard", "slot"]
        assert sorted(got.select(*names).collect()) == sorted(docs.select(*names).collect())
        assert got.select("shard", "slot").distinct().count() == 50


def archive(i, block):
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_archives_that_are_cut_off(spark, tmp_path, pack):
    body = random.Random(4).randbytes(5000)
    whole = [pack(archive(i, body)) for i in range(2)]
    (tmp_path / "a").mkdir()
    file, path = tmp_path / "a" / "x.warc", f"file://{tmp_path}/a"
    for lost in (2500, 4800, len(whole[1]) - 30):
        file.write_bytes(b"".join(whole)[:-lost])
        for how in ({}, {"payload": False}, {"only": {"record_id": ["<urn:0>"]}}):
            with pytest.raises(PySparkException, match="the archive ends within"):
                warc.read_warc(spark, path, **how).collect()
        got = warc.read_warc(spark, path, truncated="mark").orderBy("record_id").collect()
        assert (got[0].truncated, bytes(got[0].payload)) == (False, body)
        if lost != len(whole[1]) - 30:
            assert got[1].truncated and body.startswith(bytes(got[1].payload)) and len(got[1].payload) < 5000
        else:
            assert len(got) == 1
    file.write_bytes(b"".join(whole))
    assert [r.record_id for r in warc.read_warc(spark, path, only={"record_id": ["<urn:1>"]}).collect()] == ["<urn:1>"]
    with pytest.raises(ValueError, match="no header column"):
        warc.read_warc(spark, path, only={"payload": ["x"]})


def test_one_anchor_in_different_passages(spark, monkeypatch):
    """A common string shorter than a passage fills one bucket with passages that differ: it is cut by their hashes."""
    monkeypatch.setattr(suffix_dedup, "MERGE_SHARE", 20_000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 50_000)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    common_string, twice = word(45), word(60)
    texts = [word(40) + common_string + word(40) + (twice if i % 1000 == 7 else "") for i in range(4000)]
    seen = []
    shrunk = suffix_dedup._shrunk
    monkeypatch.setattr(suffix_dedup, "_shrunk", lambda opened: seen.append(opened) or seen.append(shrunk(opened)) or seen[-1])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(rows).collect()}
    assert got == brute.suffix(list(enumerate(texts)))
    assert sum(v[1] for v in got.values()) == 3 * 60
    share = lambda df: df.where("bucket >= 0").groupBy("bucket").agg({"size": "sum"}).toDF("b", "v").agg({"v": "max"}).first()[0] / df.where("bucket >= 0").agg({"size": "sum"}).first()[0]
    assert share(seen[0]) > 0.4 and share(seen[1][0]) < 0.05


def test_a_long_chain_of_versions_is_one_component(spark, monkeypatch):
    """Versions that each link only to their neighbours, in a cluster of many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    base = [f"w{i}" for i in range(500)]
    rows = [(120 - i, " ".join(base[3 * i : 3 * i + 80])) for i in range(120)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)
    assert {r.component_id for r in got.collect()} == {1}


def test_junk_that_differs_in_its_words_alone(spark):
    """Junk of the same shape, letters and signs as good text: only its words tell it apart."""
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmn" for b in "aeiou"]
    good_words = ["".join(rng.choices(syllables, k=3)) for _ in range(400)]
    junk_words = ["".join(rng.choices(syllables, k=3)) for _ in range(40)]
    line = lambda share: " ".join(rng.choice(junk_words if rng.random() < share else good_words) for _ in range(rng.randint(60, 120))) + "."
    docs = spark.createDataFrame([(i, line(0.3 if i % 5 == 0 else 0.0)) for i in range(1500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(1500) if i % 2], "doc_id long, quality int, toxic int")
    got = [r for r in quality.quality_report(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 > 0) for r in got) > 0.97 * len(got)


def test_word_ratios_are_the_other_halfs():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("Aa", "b", "c", "DD", "e,")) for _ in range(rng.randint(0, 4))).encode() for _ in range(60)]
    positive, unlabelled = texts[:25], texts[25:]
    bits = [[quality.word_bits(t) for t in part] for part in (positive, unlabelled)]
    of_positive, of_unlabelled, ratios = quality.crossed(*bits)

    def slots(text):
        return {zlib.crc32(w) % quality.WORD_BUCKETS for w in text.lower().split()}

    half = lambda t: zlib.crc32(quality.word_bits(t)) & 1

    def weight(slot, h):
        share = [(sum(slot in slots(t) for t in part if half(t) == h) + 2) / (sum(half(t) == h for t in part) + 4) for part in (positive, unlabelled)]
        return np.log(share[0] / share[1])

    for part, found in ((positive, of_positive), (unlabelled, of_unlabelled)):
        for t, r in zip(part, found, strict=True):
            assert r == pytest.approx(np.mean([weight(s, 1 - half(t)) for s in slots(t)]) if slots(t) else 0)
    for s in set().union(*map(slots, texts)):
        assert ratios[s] == pytest.approx((weight(s, 0) + weight(s, 1)) / 2)
    assert quality.word_ratio([quality.word_bits(b"")], ratios).tolist() == [0]

"""Every corpus operator against a brute-force version, and on nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import io
import random
import textwrap

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

import corpus_pipeline
from derivespark.llm import bytesets, decontaminate, exact_dedup, licenses, mixing, near_dedup, quality, secrets, sharding, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, sha string, score double, slot string, component string"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base, texts = say(25), say(60).split(), []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(say(rng.randint(1, 90)))
        elif kind == 1:
            near = list(base)
            for _ in range(rng.randint(0, 6)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
        elif kind == 2:
            texts.append(say(10) + " " + passage + " " + say(5))
        elif kind == 3:
            texts.append("Same TEXT, twice over " + "x" * 60 if i % 2 else "same text, Twice over " + "x" * 60)
        elif kind == 4:
            texts.append(f"{say(4)} password={'ab1' * (i % 5)} token: short AKIA{'Z9' * (i % 10)} {'0f' * i} éé api-key")
        else:
            texts.append([None, "", " \n\t ", "É", "one", "two words"][i // 6 % 6])
    return list(enumerate(texts)), passage


@pytest.fixture(scope="module")
def rows():
    return corpus()[0]


def frame(spark, rows):
    more = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 1) % 7 else None, 0, -1, "z", -1.0, "s", "c") for i, t in rows]
    return spark.createDataFrame(more, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without an id, and rows that repeat one."""
    return frame(spark, [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (5, "other words here"), (6, "A b c D e f")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, rows, docs, odd, none):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[brute.lower(t)].append(i)
    text = dict(rows)
    for how in ({}, {"bits_per_row": 4000, "filter_bits": 2**15}, {"bits_per_row": 1}):  # one filter, several, a full one
        got = exact_dedup.exact_dedup(docs, **how).collect()
        assert len(got) == len(rows)
        for r in got:
            same = groups[brute.lower(text[r.doc_id])]
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
            assert r.text_sha256 == hashlib.sha256(brute.lower(text[r.doc_id]).encode()).hexdigest()
    found = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect())
    assert found == {(None, 6, 4, False): 1, (None, None, 1, True): 1, (5, 6, 4, False): 2, (5, 5, 1, True): 1, (6, 6, 4, True): 1}
    assert exact_dedup.exact_dedup(none).count() == 0
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    sides = plan.split("Relation")  # the branch of certain rows: a scan under a filter and projections, no join or exchange
    assert "Join" not in sides[0] and "Aggregate" not in plan and "NOT maybe" in sides[0]


def test_exact_dedup_lower_cases_ascii_only(spark):
    df = frame(spark, [(1, "ÉA"), (2, "éa"), (3, "Éa"), (4, "İI"), (5, "İi")])
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df).collect()} == {1: 3, 2: 2, 3: 3, 4: 5, 5: 5}


def test_secrets(spark, rows, docs, odd, none):
    text = dict(rows)
    for r in secrets.scan_secrets(docs).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.spans) == brute.secrets(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert secrets.scan_secrets(odd).count() == 6 and secrets.scan_secrets(none).count() == 0
    text = "password=abcdefgh1 x token=abcdefghij y " + "0f" * 20
    again = secrets.scan_secrets(frame(spark, [(1, text), (1, text), (None, text), (None, text), (2, text + "!")])).collect()
    assert len(again) == 5 and {(r.n_assign, r.n_access, r.n_hex, r.spans) for r in again} == {brute.secrets(text)}


def test_secret_ledger_scans_new_blobs_only(spark, tmp_path):
    key = "password=abcdefgh1"
    ledger = f"file://{tmp_path}/ledger"
    one = frame(spark, [(1, key), (2, key), (3, "none")])
    assert sum(r.n_assign for r in secrets.scan_secrets(one, ledger).collect()) == 2
    two = frame(spark, [(9, key), (4, "x " + key)])
    assert sum(r.n_assign for r in secrets.scan_secrets(two, ledger).collect()) == 2
    scanned = spark.read.parquet(f"{ledger}/scanned")
    assert scanned.count() == scanned.distinct().count() == 3
    assert spark.read.parquet(f"{ledger}/findings").count() == 2
    secrets.scan_secrets(two, ledger, version="next")
    assert spark.read.parquet(f"{ledger}/scanned").count() == 5


def test_near_duplicates(spark, rows, docs, odd, none, monkeypatch):
    for k, percent in ((3, 85), (5, 80), (3, 60)):
        want = brute.near(rows, k, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, shingle=k, percent=percent).collect()}
        assert got == want
    assert any(i != c for i, (_, c) in want.items())
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)  # clusters cut into blocks
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, shingle=3, percent=60).collect()}
    assert got == want
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 250)
    base = [f"w{i}" for i in range(60)]
    drifted = [(900 - i, " ".join(base[2 * i :] + [f"x{j}" for j in range(2 * i)])) for i in range(25)]  # linked in a chain only
    copies = [(i, " ".join([*base[: i % 50], f"y{i}", *base[i % 50 :]])) for i in range(1, 40)]
    hot = drifted + copies
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, hot), shingle=3, percent=85).collect()}
    assert got == brute.near(hot, 3, 85)
    for left, slots, whole in ((0, 50, 30), (60, 12, 60)):  # forms filled in, less alike than the links; two forms in one cluster
        forms = [(i, " ".join([*(f"f{left and i % 2}{j}" for j in range(left)), *base[:whole], *(f"z{i}_{j}" for j in range(slots if i % 3 else 1))])) for i in range(1, 60)]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, forms), shingle=3, percent=85).collect()}
        assert got == brute.near(forms, 3, 85)
    found = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, shingle=3).collect())
    assert found == {(None, None, True): 2, (5, 5, True): 3, (6, 5, False): 1}
    assert near_dedup.near_duplicates(none).count() == 0


def test_signatures_of_large_sets_and_recall(monkeypatch):
    """Disjoint sets of any size share no band; pairs at the threshold are met, also where signatures change kind."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(near_dedup, "LARGE", 500)
    bands, rows = near_dedup.band_plan(85)
    minhash = near_dedup.Circulant(bands * rows)

    def keys(s):
        own = [("n", minhash(s))] if len(s) <= near_dedup.LARGE else []
        own += [("w", minhash.wide(s))] if 100 * len(s) >= 85 * near_dedup.LARGE else []
        return {(kind, i, tuple(band)) for kind, x in own for i, band in enumerate(x.reshape(bands, rows).tolist())}

    met = 0
    for n in (30, 200, 430, 495, 520, 580, 1500) * 6:
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        rest = round(n * (1 / 0.86 - 1))
        more = rng.integers(0, 2**63, rest).astype(np.uint64)
        met += bool(keys(np.r_[common, more[: rest // 2]]) & keys(np.r_[common, more[rest // 2 :]]))
    assert met == 42
    huge = [keys(rng.integers(0, 2**63, 300_000).astype(np.uint64)) for _ in range(3)]
    assert not (huge[0] & huge[1] or huge[1] & huge[2] or huge[0] & huge[2])


def test_spanning_links_reach_every_component():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 400, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        s[rng.integers(0, 60, rng.integers(0, 25))] = rng.integers(400, 900)
        sets.append(np.unique(s))

    def parts(links):
        parent = list(range(len(sets)))
        for a, b in links:
            x, y = parent[a], parent[b]
            parent = [x if p == y else p for p in parent]
        return sorted(collections.Counter(parent).values())

    every = [(a, b) for a in range(80) for b in range(a) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    found = near_dedup.spanning_links(sets, 80)
    assert len(found) < len(sets) and parts(found) == parts(every)


@pytest.mark.parametrize("rounds", [False, True])
def test_decontaminate(spark, rows, docs, odd, none, monkeypatch, rounds):
    if rounds:
        monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 7)
        monkeypatch.setattr(decontaminate, "MAX_TERMS", 3)
    passage = corpus()[1]
    items = [(1, passage.upper()), (2, "two Words"), (3, ""), (4, None), (5, " ".join(passage.split()[3:9]) + "!"), (2, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminate(rows, items)
    found = decontaminate.contaminated(docs, bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 8
    assert decontaminate.contaminated(odd, bench).count() == 6 and decontaminate.contaminated(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contaminated(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = frame(spark, [(1, "rare one two seldom"), (2, "seldom a b c d e f g h i j rare"), (3, "rare seldom")])
    bench = spark.createDataFrame([(7, "rare seldom")], "item_id long, text string")
    got = {r.doc_id: (list(r.phrase_starts), sorted(set(r.near_items))) for r in decontaminate.contaminated(docs, bench, near=5).collect()}
    assert got == {1: ([], ["7"]), 2: ([], []), 3: ([0], ["7"])}


def test_suffix_dedup(spark, rows, docs, odd, none):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    want = brute.suffix(rows)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 10
    assert sum(r.n_removed for r in suffix_dedup.suffix_dedup(odd).collect()) == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    kept = suffix_dedup.suffix_dedup(docs, keep_bytes=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_suffix_dedup_across_chunks(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MERGE_SHARE", 500)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_SHARE", 500)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs.repartition(20)).collect()}
    assert got == brute.suffix(rows)


def test_suffix_dedup_of_a_passage_in_every_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MERGE_SHARE", 300)  # many rounds
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 150)
    rng = random.Random(9)
    letters = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    common = letters(70)
    some = [(i, letters(rng.randint(0, 60)) + common[: rng.randint(40, 70)] + letters(30)) for i in range(150)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, some)).collect()}
    assert got == brute.suffix(some)


def test_passages_are_sorted_and_found():
    rng = np.random.default_rng(3)
    buf = np.concatenate([rng.integers(97, 99, 400), rng.integers(97, 99, 60).repeat(3), np.full(120, 97), np.zeros(90)] * 2).astype(np.uint8)
    words = suffix_dedup.words_at(buf, ">")
    at = np.arange(len(buf) - 50)
    text = lambda i: buf[i : i + 50].tobytes()
    order = suffix_dedup.sorted_passages(words, rng.permutation(at))
    assert [text(i) for i in order] == sorted(map(text, at))
    among = np.array([i for k, i in enumerate(order) if k % 3 == 0])
    among = among[np.r_[True, [text(a) != text(b) for a, b in zip(among[1:], among[:-1], strict=True)]]]
    place = suffix_dedup.located(words, among, at)
    have = {text(i): k for k, i in enumerate(among)}
    assert place.tolist() == [have.get(text(i), -1) for i in at]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "a"])
def test_suffix_array_and_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    text = "".join(rng.choice(alphabet) for _ in range(700))
    text += text[100:400]
    buf = np.frombuffer(text.encode(), np.uint8)
    sa = suffix_dedup.suffix_array(buf)
    padded = text.encode() + bytes(80)
    cut = [padded[i : i + 64] for i in sa]
    assert sorted(sa) == list(range(len(text))) and cut == sorted(cut)
    common = suffix_dedup.kasai(buf, sa)
    for k in range(1, len(sa)):
        a, b = padded[sa[k - 1] : sa[k - 1] + 50], padded[sa[k] : sa[k] + 50]
        assert common[k] == next((i for i in range(50) if a[i] != b[i]), 50)


def test_word_and_window_hashes():
    texts = [b"a bb ccc", b"", b"bb", b" ccc  a "]
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    starts, hashes = bytesets.word_hashes(buf)
    words = b" ".join(texts).split()
    assert len(starts) == len(words) and len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    data = np.random.default_rng(1).integers(97, 100, 300).astype(np.uint8)
    for k in (1, 26, 50):
        rolled = bytesets.rolling(data, k)
        pieces = [data[i : i + k].tobytes() for i in range(300 - k + 1)]
        assert len(set(zip(pieces, rolled.tolist(), strict=True))) == len(set(pieces)) == len(set(rolled.tolist()))
    assert bytesets.window_min(np.arange(9)[::-1], 4).tolist() == [5, 4, 3, 2, 1, 0]


def test_sharding(spark, rows, docs, odd, none):
    got = sharding.shard_report(docs, shards=16).collect()
    text = dict(rows)
    slots = collections.defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, brute.crc(text[r.doc_id]))
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r.doc_id: r.shard for r in sharding.shard_report(docs.repartition(7), shards=16, cell_rows=1).collect()}
    kept = sum(again[r.doc_id] == r.shard for r in got)
    assert kept > len(got) / 2
    placed = sharding.shard_documents(odd.unionByName(odd), shards=4)
    assert placed.count() == 12 == placed.select("shard", "slot").distinct().count()
    assert sharding.shard_report(none).count() == 0 == sharding.shard_documents(none).count()
    hot = frame(spark, [(7, "a")] * 50 + [(None, None)] * 30 + [(i, f"t{i}") for i in range(20)])
    spread = sharding.shard_documents(hot, shards=4, copies=8)  # rows of one key fill shards and go on clockwise
    assert spread.drop("shard", "slot").exceptAll(hot.drop("slot")).count() == 0 and spread.count() == 100
    assert {tuple(r) for r in spread.select("shard", "slot").collect()} == {(s, i) for s in range(4) for i in range(25)}
    assert {tuple(r) for r in sharding.shard_report(hot, shards=4).select("shard", "slot").collect()} == {(s, i) for s in range(4) for i in range(25)}


def test_sharding_against_a_plain_ring(spark, rows, docs):
    """Every key walks the ring in plain Python: first those whose own shard has room, then the others clockwise."""
    at, owner = sharding.ring(5, 8)
    keys = docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(None).cast("long")).alias("p")).collect()
    placed = sorted((int(np.searchsorted(at, k.p)) % len(at), k.p, k.doc_id) for k in keys)
    capacity = [len(keys) // 5 + (s < len(keys) % 5) for s in range(5)]
    slots, want, late = [0] * 5, {}, []

    def put(doc, shard):
        want[doc] = (shard, slots[shard])
        slots[shard] += 1

    for node, _, doc in placed:
        shard = int(owner[node])
        if slots[shard] < capacity[shard]:
            put(doc, shard)
        else:
            late.append((node, doc))
    for node, doc in late:
        while slots[int(owner[node])] == capacity[int(owner[node])]:
            node = (node + 1) % len(at)
        put(doc, int(owner[node]))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_report(docs, shards=5, nodes=8).collect()}
    assert got == want


def test_very_long_texts(spark, tmp_path):
    """A text of some megabytes is one unit everywhere: counted, scanned and matched whole."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(500_000)) + " password=abcdefgh12 one two three four five six seven eight nine ten"
    some = [(1, long), (2, long.upper()), (3, long + " more"), (4, "short text"), (5, None)]
    docs = frame(spark, some).cache()
    n = len(long.split())
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r.doc_id: r.n_assign for r in secrets.scan_secrets(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    near = {r.doc_id: r for r in near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert near[1].n_shingles == len(set(zip(long.split(), long.split()[1:], long.split()[2:], strict=False)))
    assert {i: r.component_id for i, r in near.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contaminated(docs, bench).collect()}[3] == (n + 2, 10)
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert cut[1] == (len(long), 0, 0) and cut[3] == (len(long) + 5, len(long), 1)
    assert {r.doc_id: r["size"] for r in mixing.mix_report(docs).collect()}[1] == n
    assert {r.doc_id: r["size"] for r in sharding.shard_report(docs).collect()}[3] == len(long) + 6
    assert licenses.license_scan(docs).where("license_id IS NOT NULL").count() == 0
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.quality_report(docs, labels).collect())
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long)], "page_id long, url string, html string")
    assert {r.page_id: (r.payload_bytes, r.record_type) for r in warc.archive_report(pages, f"file://{tmp_path}/long").collect()} == {1: (len(long), "response"), 2: (len(long), "revisit")}
    docs.unpersist()


def test_bounded_loads_move_little():
    _, before = sharding.ring(16, 64)
    at, after = sharding.ring(17, 64)
    old, _ = sharding.ring(16, 64)
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    was, now = before[np.searchsorted(old, keys) % len(old)], after[np.searchsorted(at, keys) % len(at)]
    assert set(now[was != now]) == {16}
    counts = np.bincount(np.searchsorted(old, keys) % len(old), minlength=len(old))
    capacity = np.full(16, 1250)
    loads = collections.Counter()
    for _, low, high, shard, slot in sharding.bounded_loads(counts, before, capacity):
        assert slot == loads[shard]
        loads[shard] += high - low
    assert set(loads.values()) == {1250}


def test_mixing(spark, rows, docs, odd, none):
    got = mixing.mix_report(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(9)).collect()))
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    text, per, total = dict(rows), collections.defaultdict(list), 0
    for r in got:
        assert r["size"] == len(brute.blank_words(text[r.doc_id])) and r.taken <= 2 * r["size"]
        per[source[r.doc_id]].append(r)
        total += r["size"]
    assert sum(p[0].target for p in per.values()) == pytest.approx(1.5 * total)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per, key=lambda s: (s is None, s)))}
    level = {p[0].target / weights[s] for s, p in per.items() if p[0].target < 2 * p[0].source_size}
    assert max(level) == pytest.approx(min(level))
    for s, p in per.items():
        rate = p[0].target / max(p[0].source_size, 1)
        for r in p:  # the draw by plain Python
            hashed = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:8], 16)
            assert r.taken == r["size"] * (int(rate) + (hashed < (rate - int(rate)) * 2**32))
        assert p[0].target <= 2 * sum(r["size"] for r in p) and all(t * weights[s] >= p[0].target - 1e-6 for t in level)
    for r in mixing.deviation(mixing.mix_report(docs)).collect():
        assert abs(r.taken - r.target) <= 4 * r.expected + 1e-6
    mixed = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(mixed[r.doc_id] * r["size"] == r.taken for r in got)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(odd).count() == 6 and mixing.mix_report(none).count() == 0 == mixing.mix(none).count()


def test_licenses(spark, docs, odd, none):
    shouted = "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + licenses.MIT.upper().replace(",", " ,")
    owner = licenses.BSD_2 + licenses.BSD_3.replace("holder", "owner") + licenses.BSD_END.replace("DAMAGES", "damages")
    texts = [(1, shouted), (2, owner), (3, licenses.MIT + " And more."), (4, None), (5, "© 2020 X"), (6, licenses.ZLIB.replace("acknowledgment", "acknowledgement"))]
    got = {r.doc_id: r.license_id for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert got == {1: "MIT", 2: "BSD-3-Clause", 3: None, 4: None, 5: None, 6: "Zlib"}
    assert licenses.license_scan(docs).where("license_id is not null").count() == 0
    assert licenses.license_scan(odd).count() == 6 and licenses.license_scan(none).count() == 0
    wrapped = "The ISC License\n\nCopyright (c) 2020 by Someone\n\n" + "\n".join(textwrap.fill(p, 70) for p in licenses.ISC.split("\n\n"))
    bullets = "BSD 2-Clause License\n\nCopyright 2011, A. Body\n\n" + (licenses.BSD_2 + licenses.BSD_END).replace("1. ", "* ").replace("2. ", "* ")
    house = "You may use this in the house.\nCopyright 1999 House"
    table = spark.createDataFrame([("HOUSE", house), ("ISC", licenses.ISC), (None, None)], "license_id string, text string")
    files = frame(spark, [(1, wrapped), (2, bullets), (3, house.upper()), (4, None)])
    assert {r.doc_id: r.license_id for r in licenses.license_scan(files).collect()} == {1: "ISC", 2: "BSD-2-Clause", 3: None, 4: None}
    assert {r.doc_id: r.license_id for r in licenses.license_scan(files, table).collect()} == {1: "ISC", 2: None, 3: "HOUSE", 4: None}


def test_quality(spark, none):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90))) + "."
    bad = lambda: " ".join(w + rng.choice(["###", "%%%"]) for w in good().split())
    texts = [(i, bad() if i % 6 == 0 else good()) for i in range(600)]
    docs = frame(spark, [*texts, (1000, None), (1001, ""), (None, "words")])
    labels = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [(r.predicted, int(r.doc_id % 6 > 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95
    changed = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((str(r.doc_id), r.score) for r in quality.quality_report(docs, changed).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    assert quality.quality_report(none, labels).count() == 0
    assert {r.score for r in quality.quality_report(docs, labels.limit(0)).collect()} == {0.5}
    model = quality.fit_nnpu(np.ones((5, 3)), np.r_[np.ones((5, 3)), np.zeros((5, 3))], 0.5)
    assert model.score(np.ones((1, 3)))[0] > 0.5 > model.score(np.zeros((1, 3)))[0]
    clash = docs.withColumnsRenamed({"score": "_score", "sha": "_predicted", "lang": "_0_", "slot": "_1_"})
    assert quality.described(clash, "_x_").where(quality.score(quality.Model(0, 1, np.zeros((len(quality.features(b"")), 1)), np.zeros(1), np.zeros(1), 0.0), "_x_") == 0.5).count() == 603
    negatives = labels.withColumn("quality", F.when(F.col("quality") == 1, 1))  # a label but 1 is never used
    assert sorted((str(r.doc_id), r.score) for r in quality.quality_report(docs, negatives).collect()) == sorted((str(r.doc_id), r.score) for r in got)


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_nnpu_risk_and_gradient(prior):
    """Against the risk written out for each row, and numeric differences of it."""
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(30, 5)), 12
    weights = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3) * 2, np.array(0.4)]

    def parts(w):
        z = [float(np.tanh(r @ w[0] + w[1]) @ w[2] + w[3]) for r in x]
        loss = lambda v: np.log(1 + np.exp(-v))
        positive = prior * sum(loss(v) for v in z[:n]) / n
        return positive, sum(loss(-v) for v in z[n:]) / (len(z) - n) - prior * sum(loss(-v) for v in z[:n]) / n

    positive, rest = parts(weights)
    risk, gradients = quality.nnpu_risk(weights, x, n, prior)
    assert risk == pytest.approx(positive + max(0, rest))
    goal = (lambda w: -parts(w)[1]) if rest < 0 else (lambda w: sum(parts(w)))
    for i, g in enumerate(gradients):
        for at in np.ndindex(np.shape(g)):
            ends = []
            for step in (1e-5, -1e-5):
                moved = [w.copy() for w in weights]
                moved[i][at] += step
                ends.append(goal(moved))
            assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)


def test_class_prior_of_known_mixtures():
    rng = np.random.default_rng(8)
    for share in (0.4, 0.8):
        good, bad = rng.normal(2, 1, (6000, 3)), rng.normal(-2, 1, (6000, 3))
        unlabelled = np.r_[good[3000 : 3000 + int(3000 * share)], bad[: int(3000 * (1 - share))]]
        assert abs(quality.class_prior(good[:3000], rng.permutation(unlabelled)) - share) < 0.05


def test_warc(spark, tmp_path):
    long = "<p>é</p>" * 30
    pages = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, "short"), (4, "http://b/ x\r\ny", "short"), (5, "u", None), (None, "n", long), (1, "http://a/1", long), (7, "r", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    got = collections.Counter(map(tuple, warc.archive_report(df).collect()))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = collections.Counter()
    for i, _, t in pages:
        revisit = t == long and i != 1
        want[(i, len((t or "").encode()), sha(t), "revisit" if revisit else "response", 1 if revisit else None)] += 1
    assert got == want
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path)
    revisits = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    assert [(r.record_id, r.payload) for r in revisits.collect()] == [("<urn:page:2>", None)]
    reader = warc.WarcReader({"path": path, "payload": "false"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringStartsWith(("target_uri",), "http://a"), In(("record_id",), (1, 2)), GreaterThan(("content_length",), 5)]))
    assert left == [GreaterThan(("content_length",), 5)]
    assert reader.tests == [("record_type", "in", ("revisit",)), ("target_uri", "prefix", "http://a"), ("record_id", "in", (1, 2))]
    two = warc_record(1, b"x" * 5_000_000) + warc_record(2, b"yes")
    stream = Counting(two)
    buffered = io.BufferedReader(stream, 4096)
    assert [r[-1] for r in warc.records(buffered, lambda h: h["record_id"] == "<urn:2>", True)] == [b"yes"]
    assert stream.read_bytes < 20_000  # the block that no one wants is not read
    import gzip
    import pathlib

    records = [warc_record(i, b"x" * i) for i in range(3)]
    (pathlib.Path(tmp_path) / "z").mkdir()
    (pathlib.Path(tmp_path) / "z" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    read = warc.read_warc(spark, f"file://{tmp_path}/z").where("record_type in ('resource', 'other')").collect()
    assert [bytes(r.payload) for r in read] == [b"", b"x", b"xx"]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_report(empty).count() == 0


class Counting(io.RawIOBase):
    """A seekable file that counts what is read from it."""

    def __init__(self, data):
        self.inner, self.read_bytes = io.BytesIO(data), 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, *how):
        return self.inner.seek(*how)

    def tell(self):
        return self.inner.tell()

    def readinto(self, into):
        n = self.inner.readinto(into)
        self.read_bytes += n
        return n


def warc_record(i, block):
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_pipeline_stages(spark, docs, tmp_path):
    passage = corpus()[1]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 2 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    want = brute.decontaminate(list(text.items()), [(1, passage)])
    assert {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[1]}
    alone = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    near = brute.near(list(text.items()), 5, 80)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i, (_, c) in near.items() if i == c)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    good = {r.doc_id for r in quality.quality_report(docs, labels).collect() if r.predicted}
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(good) and {(r.doc_id, r.text) for r in kept} == {(i, text[i]) for i in good}
    copies = collections.Counter(r.doc_id for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect())
    told = mixing.mix_report(docs).collect()
    assert {r.doc_id: copies[r.doc_id] * r["size"] for r in told} == {r.doc_id: r.taken for r in told}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {"shard", "slot"} <= set(final.columns) and final.count() == final.select("shard", "slot").distinct().count()

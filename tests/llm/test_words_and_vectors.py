"""Spelling variants, importance resampling and nearest neighbours against brute-force versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from derivespark.llm import neighbours, resample, spelling

SCHEMA = "doc_id long, text string, word string, id long, n long, score double, vector string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", -1, -1, -1.0, "v", 9) for i, t in rows], SCHEMA).repartition(3)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, shortest, least, ratio, every):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", brute.lower(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= shortest
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: sorted((v for v in words if one_edit(v, w)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= ratio * n else None for w, n in words.items()}
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def spelled(seed=1, n=40):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abÉé") for _ in range(rng.randint(4, 12))) for _ in range(60)]
    texts = []
    for _ in range(n):
        some = [rng.choice(known[: rng.choice((3, 60))]) for _ in range(60)]
        for k in range(0, 60, 7):
            at = rng.randrange(len(some[k]))
            some[k] = some[k][:at] + rng.choice(["", "a", "bé"]) + some[k][at + rng.randint(0, 1) :]
        texts.append(rng.choice([" ", "-", "1", "\n"]).join(some))
    return [*enumerate(texts), (90, None), (91, ""), (92, "×÷ÀÿABCDEFG ABCDEFG×÷Àÿ" * 2), (92, "abababab"), (None, "abababab"), (None, "abababab")]


@pytest.mark.parametrize(("bucket", "shortest", "every", "ratio"), [(2048, 7, 3, 2), (6, 5, None, 3), (1, 1, 5, 2)])
def test_spelling_variants(spark, monkeypatch, bucket, shortest, every, ratio):
    monkeypatch.setattr(spelling, "BUCKET_WORDS", bucket)
    rows = spelled()
    got = spelling.spelling_variants(frame(spark, rows), shortest=shortest, least=2, ratio=ratio, typo_every=every).collect()
    want = variants(rows, shortest, 2, ratio, every)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)
    assert sum(w[2] is not None for w in want.values()) > 3


def test_spelling_variants_of_nothing_and_of_very_long_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="ratio"):
        spelling.spelling_variants(spark.createDataFrame([], SCHEMA), ratio=1)
    long = "ab" * 40_000
    rows = [(1, f"{long} {long}"), (2, " ".join([long[:-1]] * 30)), (3, " ".join([long[:70_001] + "xy" + long[70_003:]] * 2))]
    got = sorted((len(r.word), r.n, r.n_near, r.form and len(r.form)) for r in spelling.spelling_variants(frame(spark, rows)).collect())
    assert got == [(79_999, 30, 1, None), (80_000, 2, 1, 79_999), (80_000, 2, 0, None)] or got == [(79_999, 30, 1, None), (80_000, 2, 0, None), (80_000, 2, 1, 79_999)]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_pairs_within_a_bucket(size):
    rng = random.Random(size)
    texts = ["".join(t) for t in itertools.product("abc", repeat=size)] + ["".join(t) for t in itertools.product("abc", repeat=size - 1)]
    texts = sorted({t: None for t in texts}) * 2
    buckets = np.array([i // (len(texts) // 2) for i in range(len(texts))])
    guards = [rng.choice(["", "a", "b"]) for _ in texts]
    a, b = spelling.near_pairs(buckets, np.full(len(texts), size), texts, guards)
    got = collections.Counter(zip(a.tolist(), b.tolist(), strict=True))
    want = collections.Counter()
    for i, j in itertools.permutations(range(len(texts)), 2):
        x, y = texts[i], texts[j]
        if buckets[i] == buckets[j] and one_edit(x, y) and max(len(x), len(y)) == size:
            short, long = (i, j) if len(x) < len(y) else (j, i)
            later = len(x) != len(y) and texts[short] + guards[short] == texts[long]
            want[i, j] += not later
    assert +got == +want


def resampled(rows, items, n, buckets, least_words, percent, seed):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def features(text):
        w = re.findall(pattern, brute.lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    ours, s = [features(t) for _, t in rows], collections.Counter()
    t = collections.Counter(b for x in items for b in features(x)[1])
    for _, f in ours:
        s.update(f)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for (i, _), (n_words, f) in zip(rows, ours, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words])
    fit = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("n", "head", "percent"), [(1, 50_000, 10), (2, 5, 50), (3, 3, 100)])
def test_importance_resample(spark, n, head, percent):
    rng = random.Random(n)
    words = ["The", "of", "ÀB", "x1", "and", *(f"w{i}" for i in range(60))]
    say = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(words[: rng.choice((5, 65))]) for _ in range(k))
    rows = [(i, say(rng.randint(0, 60))) for i in range(80)] + [(80, None), (81, ""), (82, "--"), (5, say(30)), (None, say(40)), (None, say(40))]
    items = [say(20) for _ in range(5)] + [None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "doc_id long, text string")
    got = resample.importance_resample(frame(spark, rows), target, n=n, buckets=500, least_words=20, percent=percent, seed=7, head=head).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == resampled(rows, items, n, 500, 20, percent, 7)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(r.rank is not None for r in got)))


def test_importance_resample_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    words = " ".join(f"w{i % 7}" for i in range(25))
    same = frame(spark, [(4, words)] * 30 + [(3, words)] * 10)
    got = resample.importance_resample(same, none, percent=50).collect()
    best = max(got, key=lambda r: (r.score, -r.doc_id))
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21)) and len({(r.doc_id, r.weight, r.score) for r in got}) == 2
    assert {r.doc_id for r in got if r.rank == 1} == {best.doc_id}
    assert resample.importance_resample(none, same).collect() == []
    named = frame(spark, [(1, words)]).withColumn("doc_id", F.lit("a1"))
    assert [r.doc_id for r in resample.importance_resample(named, same).collect()] == ["a1"]
    long = frame(spark, [(1, words * 20_000), (2, words)])
    assert {r.doc_id: r.n_features for r in resample.importance_resample(long, none).collect()} == {1: 25 * 20_000 - 19_999, 2: 25}


def closest(points, queries, k):
    """Of ``(id, vector)`` rows, the least vector of an id; exact inner products, added up from the first component on."""
    one = lambda rows: {i: min(v for j, v in rows if j == i) for i, _ in rows}
    out = {}
    for q, x in one(queries).items():
        found = []
        for i, y in one(points).items():
            if i != q:
                s = 0.0
                for a, b in itertools.zip_longest(x, y, fillvalue=0.0):
                    s += a * b
                found.append((-s, i))
        if found:
            out[q] = sorted(found)[:k]
    return out


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, class string").repartition(3)


def results(df):
    found = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((-r.score, r.vec_id))
    return dict(found)


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_nearest_neighbours(spark, monkeypatch, scale):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 600)] + 0.2 * rng.normal(size=(600, 8))
    x[:200] = centres[0] + 0.01 * rng.normal(size=(200, 8))  # a third is one tight group
    x *= np.exp(scale * rng.normal(size=600))[:, None]
    x[300:340] = x[300]  # equal vectors
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    points = vectors(spark, rows)
    got = results(neighbours.nearest(points, points.where("vec_id % 5 = 0"), k=10))
    want = closest(rows, [r for r in rows if r[0] % 5 == 0], 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    shared = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert shared >= 0.95 * sum(map(len, want.values()))  # pairs of the exact score and the id
    assert got[300] == want[300] and got[335] == want[335]
    sure = results(neighbours.nearest(points, points.where("vec_id % 50 = 0"), k=10, miss=1e-9))
    assert sure == {q: want[q] for q in sure}


def test_nearest_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [])]
    good = [(10, [1.0, 0.0]), (11, [1.0, 0.0, 2.0]), (12, [3.0]), (13, [0.5, 0.5]), (13, [0.5, 0.5]), (14, [-1.0, 0.0]), (15, [2.0, 1.0]), (15, [-2.0, 1.0])]
    points = vectors(spark, bad + good, "double")
    for k in (3, 20):
        assert results(neighbours.nearest(points, points, k=k)) == closest(good, good, k)
    assert results(neighbours.nearest(points, vectors(spark, [(99, [1.0, 1.0])]), k=2)) == closest(good, [(99, [1.0, 1.0])], 2)
    none = vectors(spark, [])
    assert neighbours.nearest(none, points).collect() == [] and neighbours.nearest(points, none).collect() == []
    assert neighbours.nearest(vectors(spark, good[:1]), vectors(spark, good[:1])).collect() == []

"""Quality scores by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks
from .common import saved, small_batches

#: Positives drawn for the fit, and as many rows drawn as unlabelled text; their features fit on the driver whatever the
#: input's size.
SAMPLE_ROWS = 24_000
CHUNK_BYTES = 1_000_000
SYMBOLS = b"%&*$#@^~<>={}[]\\_+"
STOPS, DIGITS, BARS, SHOUTS, QUOTES = b".,;:?-", b"0123456789", b"|/", b"!", b"\"'()`"
UPPER = bytes(range(65, 91))
#: Buckets of words, a bit each in a document's bitmap, whatever its length; and a task's bitmaps unpacked at a time.
WORD_BUCKETS = 2**13
BITMAPS = 1024
FEATURES = "struct<v: array<double>, w: binary>"


def features(text: bytes) -> np.ndarray:
    """Shares and ratios of one whole text; nothing but the text goes in. An empty text gives zeros."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size = max(len(text), 1)
    share = [counts[list(group)].sum() / size for group in (SYMBOLS, STOPS, DIGITS, BARS, SHOUTS, QUOTES, UPPER, b" ", b"\n")]
    words = text.split()
    n = max(len(words), 1)
    follow = sum(map(bytes.__eq__, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    lined = max(len(lines), 1)
    distinct = len(set(words))
    shape = [follow, pairs, distinct / n, distinct / n**0.75, len(set(lines)) / lined, np.log1p(n / lined), np.log1p(n), sum(map(len, words)) / n / 10]
    capital = sum(w[0] in UPPER for w in words) / n
    full = sum(w.isupper() for w in words) / n
    beyond = counts[128:].sum() / size
    share = [min(x * 20, 3.0) for x in share]
    return np.array([*share, *shape, capital, full, beyond, min(follow * 10, 1.0), float(n > 1)])


def word_bits(text: bytes) -> bytes:
    """A bitmap of the buckets of the distinct words of one whole text, letters A-Z in either case."""
    words = set(text.lower().split())
    bits = np.zeros(WORD_BUCKETS, dtype=np.uint8)
    bits[np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % WORD_BUCKETS] = 1
    return np.packbits(bits).tobytes()


def word_ratio(bitmaps: list[bytes], ratios: np.ndarray) -> np.ndarray:
    """The mean of ``ratios`` over the word buckets of each document; without words zero."""
    found = [np.zeros(0)]
    for at in range(0, len(bitmaps), BITMAPS):
        bits = np.unpackbits(np.frombuffer(b"".join(bitmaps[at : at + BITMAPS]), dtype=np.uint8)).reshape(-1, WORD_BUCKETS)
        found.append(bits @ ratios / np.maximum(bits.sum(axis=1, dtype=np.int64), 1))
    return np.concatenate(found)


def word_ratios(positive: list[bytes], unlabelled: list[bytes]) -> np.ndarray:
    """For each bucket the logarithm of the share of positives that have it over the share of unlabelled documents."""
    shares = []
    for bitmaps in (positive, unlabelled):
        n = np.zeros(WORD_BUCKETS)
        for at in range(0, len(bitmaps), BITMAPS):
            n += np.unpackbits(np.frombuffer(b"".join(bitmaps[at : at + BITMAPS]), dtype=np.uint8)).reshape(-1, WORD_BUCKETS).sum(axis=0, dtype=np.int64)
        shares.append((n + 2) / (len(bitmaps) + 4))
    return np.log(shares[0]) - np.log(shares[1])


def crossed(positive: list[bytes], unlabelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word ratios of either sample's documents, each from the other half of both samples, so that no document is
    weighed by itself, and the mean of both halves' ratios for all other documents. Equal texts are in one half."""
    half = [np.array([crc32(w) & 1 for w in bitmaps]) for bitmaps in (positive, unlabelled)]
    of = lambda h: [[w for w, g in zip(bitmaps, at, strict=True) if g == h] for bitmaps, at in zip((positive, unlabelled), half, strict=True)]
    ratios = [word_ratios(*of(h)) for h in (0, 1)]
    ours = [np.where(at == 0, word_ratio(bitmaps, ratios[1]), word_ratio(bitmaps, ratios[0])) for bitmaps, at in zip((positive, unlabelled), half, strict=True)]
    return ours[0], ours[1], (ratios[0] + ratios[1]) / 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text", CHUNK_BYTES):
        v = pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))
        x = pa.StructArray.from_arrays([v, pa.array([word_bits(t) for t in texts], pa.binary())], ["v", "w"])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])


def featured(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the features of every whole text, its shares and ratios ``v`` and its word bitmap ``w``, written once for
    all that reads them; such a table as it is."""
    if docs.columns == ["doc_id", "x"]:
        return docs
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        return saved(texts.mapInArrow(_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x {FEATURES}"), "quality-features")


#: Features are summed as whole numbers of this fraction, so that the sums do not depend on the order of the tasks.
UNIT = 2**20


def moments(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of the shares and ratios of all ``docs``."""
    width = len(features(b""))
    whole = lambda i, k: F.sum(F.rint(F.pow(F.col("x.v")[i], k) * UNIT).cast("decimal(28,0)"))
    row = featured(docs).agg(F.count(F.lit(1)), *[whole(i, k) for k in (1, 2) for i in range(width)]).first()
    n, values = max(row[0], 1), np.array([float(v or 0) / UNIT for v in row[1:]])
    mean, square = values[:width] / n, values[width:] / n
    return mean, np.sqrt(np.maximum(square - mean**2, 0))


class Model:
    """One hidden layer on standardised features; ``score`` is the probability of the positive class. With the ``ratios`` of word
    buckets their mean over a document is the last feature."""

    def __init__(self, mean, scale, hidden, bias, out, out_bias, ratios=None) -> None:
        self.mean, self.scale, self.hidden, self.bias, self.out, self.out_bias, self.ratios = mean, scale, hidden, bias, out, out_bias, ratios

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ self.hidden + self.bias) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


def nnpu_risk(weights: list[np.ndarray], x: np.ndarray, n: int, prior: float) -> tuple[float, list[np.ndarray]]:
    """prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]) for the logistic loss l; the first ``n`` rows are
    positives, the others unlabelled. With it the direction of descent: the gradient, but of minus the second part where
    that is below zero, which stops the model from fitting the positives among the unlabelled."""
    h = np.tanh(x @ weights[0] + weights[1])
    z = h @ weights[2] + weights[3]
    p = 1 / (1 + np.exp(-z.clip(-40, 40)))
    loss_negative = np.logaddexp(0, z)
    rest = loss_negative[n:].mean() - prior * loss_negative[:n].mean()
    g = np.empty_like(z)
    g[:n], g[n:] = -prior * p[:n] / n, p[n:] / (len(x) - n)  # of the second part
    if rest < 0:
        g = -g
    else:
        g[:n] += prior * (p[:n] - 1) / n
    back = np.outer(g, weights[2]) * (1 - h**2)
    risk = prior * np.logaddexp(0, -z[:n]).mean() + max(0.0, rest)
    return float(risk), [x.T @ back, back.sum(axis=0), h.T @ g, g.sum()]


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, units: int = 12, steps: int = 500, rate: float = 0.02, decay: float = 1e-4, of: tuple | None = None) -> Model:
    """Minimises ``nnpu_risk`` by Adam. ``of`` has the features' means and deviations, else those of the unlabelled rows
    are taken."""
    rng = np.random.default_rng(7)
    mean, scale = of or (unlabelled.mean(axis=0), unlabelled.std(axis=0))
    scale = scale + 1e-6
    x = ((np.concatenate([positive, unlabelled]) - mean) / scale).clip(-8, 8)
    weights = [rng.normal(0, 0.3, (x.shape[1], units)), np.zeros(units), rng.normal(0, 0.3, units), np.array(np.log(prior / (1 - prior)))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        for i, d in enumerate(nnpu_risk(weights, x, len(positive), prior)[1]):
            d = d + decay * weights[i] * (i in (0, 2))
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d**2
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *weights)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, of: tuple | None = None, least: float = 0.7) -> float:
    """The share of positives in the unlabelled text, from positives and unlabelled text alone.

    Above any score the unlabelled share is at least the prior times the positive share; where only positives score
    as high the two are equal. Scores are fitted on one half and compared on the other, both ways round; of the thresholds
    that ``least`` of the positives pass, the one with the least ratio of the shares counts, less one standard error of the
    ratio there, as the least of many noisy ratios that all lie above the prior.
    """
    found = []
    half = lambda x, a: x[a::2] if len(x) > 1 else x
    for a in (0, 1):
        model = fit_nnpu(half(positive, a), half(unlabelled, a), 0.5, of=of)
        p, u = (np.sort(model.score(half(x, 1 - a))) for x in (positive, unlabelled))
        at = p[: max(1, int(len(p) * (1 - least)))]
        above, among = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
        ratio = among / above
        best = int(np.argmin(ratio))
        error = np.sqrt(among[best] * (1 - among[best]) / len(u) / above[best] ** 2 + ratio[best] ** 2 * (1 - above[best]) / above[best] / len(p))
        found.append(ratio[best] - error)
    return float(np.clip(np.mean(found), 0.05, 0.98))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, prior: float | None = None) -> Model:
    """Fits on at most about ``rows`` positives and ``rows`` unlabelled documents, all outside the held-out third; ``docs``
    may be ``featured`` already.

    Positives are drawn by a hash of doc_id among the documents labelled 1 (a doc_id with differing labels is not
    trusted), however many others there are; the unlabelled text is drawn by another hash among all. Means and scales
    of the shares and ratios are those of all documents; the word ratios are those of the samples. The class prior is ``prior``, else ``class_prior`` of the two samples: no
    label but 1 is ever used. With no positive labels every text scores one half; labels with positives of which no
    document was drawn are an error.
    """
    learn = labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n_positive = learn.agg(F.count_if(F.col("quality") == 1)).first()[0]
    described = featured(docs)
    ours = described.where(~held_out())
    n_ours = ours.select("doc_id").count()
    if not n_positive or not n_ours:
        n = len(features(b""))
        return Model(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), 0.0)
    trusted = ours.groupBy("doc_id").agg(F.count("*").alias("n")).join(learn.where("quality = 1"), "doc_id")
    trusted = saved(trusted.select("doc_id", "n"), "quality-positives")

    def drawn(salt: str, of: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(2**30)) < int(min(1.0, rows / max(of, 1)) * 2**30)

    chosen = trusted.where(drawn("positive", trusted.agg(F.sum("n")).first()[0] or 0)).select("doc_id", F.lit(True).alias("positive"))
    joined = ours.join(F.broadcast(chosen), "doc_id", "left")  # about ``rows`` ids
    sample = joined.select(F.col("x.v").alias("x"), F.col("x.w").alias("w"), F.coalesce("positive", F.lit(False)).alias("positive"), drawn("fit", n_ours).alias("unlabelled"))
    got = sample.where("positive or unlabelled").toPandas()  # at most about twice ``rows``
    got = got.assign(x=got["x"].map(tuple), w=got["w"].map(bytes)).sort_values(["x", "w", "positive", "unlabelled"], ignore_index=True)  # in whatever order tasks end
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(features(b"")))
    at = [got[name].to_numpy(dtype=bool) for name in ("positive", "unlabelled")]
    positive, unlabelled = (x[a] for a in at)
    if not len(positive) or not len(unlabelled):
        raise ValueError(f"{n_positive} positive labels, but {len(positive)} positive and {len(unlabelled)} unlabelled documents drawn")
    by_words = crossed(*[got["w"][a].tolist() for a in at])
    positive, unlabelled = np.c_[positive, by_words[0]], np.c_[unlabelled, by_words[1]]
    mean, deviation = moments(described)
    of = np.r_[mean, by_words[1].mean()], np.r_[deviation, by_words[1].std()]
    if prior is None:
        prior = class_prior(positive, unlabelled, of)
    model = fit_nnpu(positive, unlabelled, prior, of=of)
    model.ratios = by_words[2]
    return model


def described(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the features of the whole text in a new column ``name``, written once: the text goes to Python, only
    numbers come back. Null counts as empty."""

    @F.pandas_udf(FEATURES)
    def of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"v": text.map(lambda t: features(t or b"")), "w": text.map(lambda t: word_bits(t or b""))})

    with small_batches(docs.sparkSession):
        return saved(docs.withColumn(name, of(F.col("text").cast("string").cast("binary"))), "quality-described")


def score(model: Model, name: str):
    """The score from the features in the column ``name``."""

    @F.pandas_udf("double")
    def of(v: pd.Series, w: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.stack(v.to_numpy())
        return pd.Series(model.score(x if model.ratios is None else np.c_[x, word_ratio(w.tolist(), model.ratios)]), dtype=float)

    return of(F.col(name)["v"], F.col(name)["w"])


def quality_report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``. Labels, lang, source and doc_id never reach the score;
    rows with equal texts score alike, of any length; a null doc_id hashes as an empty one."""
    rows = featured(docs)
    model = train(rows, labels, **how)

    scored = rows.select("doc_id", score(model, "x").alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Numpy helpers on UTF-8 bytes that run inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: A-Z lower-cased, the six ASCII blanks as space.
BLANKS = bytes.maketrans(_UPPER + b"\t\n\v\f\r", _LOWER + b"     ")
#: A-Z lower-cased, every ASCII byte but 0-9 and a-z as space; bytes of other characters stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


_powers = np.ones((2, 1), dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        out = np.ones((2, n), dtype=np.uint64)
        for row, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            out[row, 1:] = base
            np.multiply.accumulate(out[row], out=out[row])
        _powers = out
    return _powers[:, :n]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the maximal runs of bytes other than space."""
    word = np.empty(len(buf) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.not_equal(buf, 32, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_table(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[buf] * up[: len(buf)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles; of fewer words, but not none, the whole sequence."""
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, words = word_hashes(np.frombuffer(b" ".join(texts).translate(BLANKS), dtype=np.uint8))
    first = np.searchsorted(starts, bounds)
    joined = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        joined = joined * U(0x100000001B3 * 2 + 1) + mix(words[j : j + len(joined)] + U(j))
    joined = mix(joined)
    out = []
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= k:
            out.append(np.unique(joined[low : high - k + 1]))
        elif high > low:
            h = np.array([high - low], dtype=np.uint64)
            for w in range(low, high):
                h = mix(h * U(_BASE) + words[w : w + 1] + U(77))
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k``-byte window, built from windows of doubled length."""
    n, out, have = len(buf), None, 0
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    current, size, factor, rest = _BYTE_CODES[buf], 1, _BASE, k
    while True:
        if rest & 1:
            m = n - (have + size) + 1
            out = current[:m].copy() if out is None else out[:m] * U(factor) + current[have : have + m]
            have += size
        rest >>= 1
        if not rest:
            return mix(out)
        m = n - 2 * size + 1
        current = current[:m] * U(factor) + current[size : size + m]
        factor, size = factor * factor % 2**64, 2 * size


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of the column ``text``, at least one row each, and their UTF-8.
    Only a slice's texts become Python objects at a time."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        low = size = 0
        for i, n in enumerate([*sizes.tolist(), None]):
            if n is None or (i > low and size + n > limit):
                if i > low:
                    yield batch.slice(low, i - low), [t or b"" for t in column.slice(low, i - low).to_pylist()]
                low, size = i, 0
            size += n or 0


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype()), type=kind))

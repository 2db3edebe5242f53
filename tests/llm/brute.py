"""Plain Python versions of the operators, for small tables."""

import hashlib
import itertools
import re
import zlib

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").encode().translate(LOWER).decode()


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def near(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = blank_words(t)
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets[i] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def decontaminate(docs, items, size=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = []
    for item, t in items:
        w = re.findall(pattern, lower(t))
        windows += [(str(item), w[i : i + size]) for i in range(max(len(w) - size + 1, 1))] if w else []
    out = {}
    for i, t in docs:
        w, hit, found = re.findall(pattern, lower(t)), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def suffix(docs, size=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            p = b[s : s + size]
            first[p] = min(first.get(p, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < i:
                gone[s : s + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def secrets(text):
    text, spans, counts = text or "", [], []
    rules = [
        (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "assign"),
        (r"AKIA[A-Z0-9]+", 0, 16, "access"),
        (r"[0-9a-f]+", 0, 32, "hex"),
    ]
    for rank, (p, g, least, kind) in enumerate(rules):
        found = [m for m in re.finditer(p, text) if len(m[g]) >= least]
        counts.append(len(found))
        spans += [(m.start(), rank, kind, m.end()) for m in found]
    return (*counts, ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)))


def crc(text):
    return zlib.crc32((text or "").encode())

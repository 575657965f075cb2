"""Plain Python versions of the operators' results."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(rows, k=3, percent=85):
    """rows: (id, text); ids may repeat or be null."""
    sets = []
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}))
    comp = {i: i for i, _ in sets if i is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if a is not None and b is not None and x and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                comp[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def substring(rows, k):
    words = [SPACED.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if count[tuple(w[a : a + k])] > 1:
                gone[a : a + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def tokens(rows, tokenizer, end=1):
    at, out = 0, []
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def contaminated(rows, items, k):
    windows = {}
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for j in range(max(len(w) - k + 1, 1) if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(item))
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[a : a + n]))) is not None:
                    hit[a : a + n] = [True] * n
                    found |= ids
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def phrases(text, listed):
    w = ALNUM.findall((text or "").translate(LOWER))
    found = [(label, a) for label, p in listed for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
    at = [a for _, a in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in found}))

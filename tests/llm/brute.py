"""Plain versions of the operators."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows, k, percent):
    """[(doc_id, size, component)] by comparing all pairs of sets."""
    sets = [shingles(t, k) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows)), key=str)


def scores(rows, modulus=7):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % modulus == 2 for r in rows]
    tokens = [[*words(t), None] for _, t, *_ in rows]
    c = collections.Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return sorted(((r[0], h, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for r, t, h in zip(rows, tokens, held)), key=str)


def removed(rows, window=20):
    def key(r):
        return r[0] if r[0] is not None else 1 << 63

    tokens = [words(t, lower=False) for _, t, *_ in rows]
    first = {}
    for r, w in sorted(zip(rows, tokens), key=lambda x: key(x[0])):
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, (key(r), p)), (key(r), p))
    out = []
    for r, w in zip(rows, tokens):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (key(r), p):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((r[0], len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out

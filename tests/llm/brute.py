"""Plain versions of the operators."""

from __future__ import annotations

import hashlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").translate(LOWER)


def exact(rows):
    """doc_id, keep_id, group_size, kept, sha256 of (doc_id, text) rows."""
    keep, size = {}, Counter()
    for i, t in rows:
        size[lowered(t)] += 1
        if i is not None:
            keep[lowered(t)] = max(keep.get(lowered(t), i), i)
    return [(i, keep.get(lowered(t)), size[lowered(t)], i == keep.get(lowered(t)), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows]


def shingles(text, k=5):
    w = lowered(text).encode().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows, k=5, percent=75):
    """doc_id, n_shingles, component_id."""
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for n, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(n)
    for n, s in enumerate(sets):
        if rows[n][0] is None:
            continue
        for m, both in Counter(m for g in s for m in where[g] if m < n).items():
            if rows[m][0] is not None and 100 * both >= percent * (len(s) + len(sets[m]) - both):
                a, b = find(rows[n][0]), find(rows[m][0])
                root[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def repeats(rows, k=13):
    """doc_id, n_words, n_removed, kept words."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if i is not None:
            for j in range(len(w) - k + 1):
                if first[tuple(w[j : j + k])] < i:
                    gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


def check_packing(pieces, rows, capacity, encode):
    """Asserts that pieces are those of the texts, and that sequences have no gap and no overflow; the number of sequences."""
    import zlib

    import numpy as np

    want = Counter()
    for i, t in rows:
        ids = np.array([*encode(t or ""), 1], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            want[i, p, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)

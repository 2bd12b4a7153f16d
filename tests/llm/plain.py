"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

ASCII = {c: c + 32 for c in range(0x41, 0x5B)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+").findall
BARE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def shingles(text, k):
    w = SPACED((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k, similarity):
    """id -> (size, component) of documents given as id -> text."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    above = {i: i for i in sets}

    def root(i):
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                above[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(texts, length):
    """(bytes, removed, spans, digest of the rest) of every text."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def decontaminated(docs, items, size=10):
    """id -> (words, hit words, item ids) of documents given as id -> text."""
    windows = defaultdict(set)
    for item, text in items.items():
        w = BARE((text or "").translate(ASCII))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = {}
    for d, text in docs.items():
        w, hit, found = BARE((text or "").translate(ASCII)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), found)
    return out

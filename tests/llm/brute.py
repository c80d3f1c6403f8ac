"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from itertools import combinations


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_components(texts):
    """Smallest id reachable over links, from {id: text}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in texts}


def bench_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def contamination(text, items, size=10):
    """Hit word positions and items of a text, from {item: text}."""
    words, hit, found = bench_words(text), set(), set()
    for item, other in items.items():
        w = bench_words(other)
        n = min(size, len(w))
        if not n:
            continue
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    return hit, found

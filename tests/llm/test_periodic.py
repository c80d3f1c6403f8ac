"""Periodic runs against a search over all distances; block convolution against plain comparison."""

import random
import time
import zlib
from hashlib import sha256

import numpy as np
import pytest

from poolwise.llm import block_ntt
from poolwise.llm.periodic import judge_slice, periodic_runs, runs_of


def plain_runs(words):
    """(start, length, period) of all maximal runs, by every distance."""
    n, found = len(words), {}
    for d in range(1, n // 4 + 1):
        i = 0
        while i < n - d:
            if words[i] != words[i + d]:
                i += 1
                continue
            j = i
            while j < n - d and words[j] == words[j + d]:
                j += 1
            if j - i + d >= max(6, 4 * d):
                found.setdefault((i, j - i + d), d)
            i = j
    return sorted((s, n, d) for (s, n), d in found.items())


def plain_row(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    cells = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc, len(runs), *cells, sha256(listed.encode()).hexdigest(), sha256(left).hexdigest()


def texts():
    rng = random.Random(5)
    yield from ["", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b " * 4 + "a", "x " * 1000, "a a a a a a b " * 9]
    yield "a b c d e f g h " * 3
    for k in range(120):
        alphabet = [f"w{i}" for i in range(rng.choice([1, 2, 3, 30]))]
        words = []
        while len(words) < rng.choice([5, 40, 300]):
            part = [rng.choice(alphabet) for _ in range(rng.randint(1, 40))]
            words += part * rng.choice([1, 1, 2, 4, 5, 9])
            if rng.random() < 0.5:
                words = words[: -rng.randint(1, 5)]
        yield " ".join(words)
    yield " ".join(["fib"] * 3)
    a, b = ["0"], ["0", "1"]
    while len(b) < 900:
        a, b = b, b + a
    yield " ".join(b)


def test_runs_equal_a_search_over_all_distances():
    docs = list(texts())
    ids = [None if k % 17 == 3 else k for k in range(len(docs))]
    want = [plain_row(i, t) for i, t in zip(ids, docs, strict=True)]
    assert [r[:8] for r in judge_slice(ids, [t.encode() for t in docs])] == want
    for i, t, w in zip(ids, docs, want, strict=True):
        assert judge_slice([i], [t.encode()])[0][:8] == w
    assert sum(w[1] for w in want) > 150


@pytest.mark.parametrize("length", [1, 2, 4, 64, 512])
@pytest.mark.parametrize("most", [2, 40_000, 1 << 25])
def test_agreements_equal_plain_comparison(length, most):
    rng = np.random.default_rng(length)
    blocks = rng.integers(0, most, (7, length))
    windows = rng.integers(0, most, (7, 2 * length - 1))
    for k in range(6):
        at = rng.integers(0, length)
        windows[k, at : at + length] = blocks[k]
    windows[5, rng.integers(0, len(windows[5]))] ^= 1
    want = np.array([[np.array_equal(x, y[t : t + length]) for t in range(length)] for x, y in zip(blocks, windows, strict=True)])
    assert np.array_equal(block_ntt.agreements(blocks, windows), want)


def test_sums_that_vanish_modulo_one_prime_are_told_apart():
    prime = block_ntt.PRIMES[0]
    parts = []
    left = prime
    while left:
        step = int(left**0.5)
        parts.append(step)
        left -= step * step
    blocks = np.zeros((1, 8), np.int64)
    blocks[0, : len(parts)] = parts
    assert int((blocks**2).sum()) == prime
    assert not block_ntt.agreements(blocks, np.zeros((1, 15), np.int64)).any()


def test_long_documents_take_near_linear_time():
    rng = np.random.default_rng(1)
    n = 400_000
    for codes in (np.zeros(n, np.int64), np.tile(rng.integers(0, 50, 7), n // 7 + 1)[:n], np.tile(rng.integers(0, 9_000, 60_000), 7)[:n]):
        began = time.time()
        ((start, length, _),) = [r for r in runs_of(codes, np.array([0, n])) if r[1] > n // 2]
        assert (start, length) == (0, n)
        assert time.time() - began < 30


def test_query_on_odd_rows(spark, make_docs):
    pairs = [(i, t) for i, t in enumerate(texts())][:60] + [(7, None), (7, "a " * 9), (None, "b c " * 9), (None, None), (90, "z " * 60_000)]
    pairs += [(k, "same line here " * 12) for k in range(100, 160)]
    docs = make_docs(pairs).repartition(5)
    got = sorted((tuple(r)[:8] for r in periodic_runs(docs).collect()), key=repr)
    assert got == sorted((plain_row(*p) if p[0] != 90 else judge_slice([90], [p[1].encode()])[0][:8] for p in pairs), key=repr)
    assert periodic_runs(make_docs([])).count() == 0

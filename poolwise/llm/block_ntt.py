"""Exact integer correlations of blocks by number-theoretic transforms, many blocks at once.

A sum of squared differences is computed modulo as many primes as its bound needs, so it is known
exactly, and it is zero only where every pair agrees.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Primes c * 2**k + 1 below 2**31 with k >= 25, so that products of residues fit into 64 bits.
PRIMES = (2013265921, 1811939329, 2113929217)
LONGEST = 1 << 25
#: Numbers of a batch of transforms.
BATCH = 1 << 19


@cache
def root(prime: int, size: int) -> int:
    """An element of order ``size``, a power of two: the matching power of a quadratic non-residue."""
    base = next(g for g in range(2, prime) if pow(g, (prime - 1) // 2, prime) == prime - 1)
    return pow(base, (prime - 1) // size, prime)


@cache
def twiddles(prime: int, size: int, inverse: bool) -> np.ndarray:
    w = root(prime, size)
    w = pow(w, prime - 2, prime) if inverse else w
    powers = np.ones(max(1, size // 2), np.uint64)
    done = 1
    while done < size // 2:
        powers[done : 2 * done] = powers[:done] * np.uint64(pow(w, done, prime)) % np.uint64(prime)
        done *= 2
    return powers


def transform(rows: np.ndarray, prime: int) -> np.ndarray:
    """Transforms of the rows, in bit-reversed order; the rows are used up."""
    p, (m, size) = np.uint64(prime), rows.shape
    width = size
    while width > 1:
        half = width // 2
        parts = rows.reshape(m, size // width, width)
        low, high = parts[:, :, :half], parts[:, :, half:]
        total = (low + high) % p
        parts[:, :, half:] = (low + p - high) % p * twiddles(prime, width, False) % p
        parts[:, :, :half] = total
        width = half
    return rows


def restore(rows: np.ndarray, prime: int) -> np.ndarray:
    """Back from bit-reversed order; the rows are used up."""
    p, (m, size) = np.uint64(prime), rows.shape
    width = 2
    while width <= size:
        half = width // 2
        parts = rows.reshape(m, size // width, width)
        low, high = parts[:, :, :half], parts[:, :, half:] * twiddles(prime, width, True) % p
        total = (low + high) % p
        parts[:, :, half:] = (low + p - high) % p
        parts[:, :, :half] = total
        width *= 2
    return rows * np.uint64(pow(size, prime - 2, prime)) % p


def primes_for(bound: int) -> tuple[int, ...]:
    """Enough primes to tell zero from every other value up to ``bound``."""
    product, n = 1, 0
    while product <= bound:
        if n == len(PRIMES):
            raise ValueError("the sums exceed the product of the primes")
        product, n = product * PRIMES[n], n + 1
    return PRIMES[:n]


def agreements(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block occurs in its window: a boolean row over the shifts from 0 to the block's length - 1.

    ``blocks`` is (m, B) and ``windows`` (m, 2 B - 1); both hold numbers from 0. Shift t compares the block
    with window[t : t + B] by the sum of squared differences, which is x.x + y.y - 2 x.y.
    """
    m, length = blocks.shape
    size = 2 * length
    if size > LONGEST:
        raise ValueError("a block exceeds the longest transform")
    most = int(max(blocks.max(initial=0), windows.max(initial=0)))
    found = np.ones((m, length), bool)
    for prime in primes_for(length * most * most):
        p = np.uint64(prime)
        x, y = blocks.astype(np.uint64) % p, windows.astype(np.uint64) % p
        left = np.zeros((m, size), np.uint64)
        right = np.zeros((m, size), np.uint64)
        left[:, :length] = x[:, ::-1]
        right[:, : 2 * length - 1] = y
        # Cyclic wrap-around reaches only the first length - 2 places, which are not read.
        cross = restore(transform(left, prime) * transform(right, prime) % p, prime)[:, length - 1 : 2 * length - 1]
        own = (x * x % p).sum(axis=1, dtype=np.uint64) % p
        sums = np.zeros((m, 2 * length), np.uint64)
        np.cumsum(y * y % p, axis=1, dtype=np.uint64, out=sums[:, 1:])
        there = (sums[:, length : 2 * length] - sums[:, :length]) % p
        found &= (own[:, None] + there) % p == cross * np.uint64(2) % p
    return found

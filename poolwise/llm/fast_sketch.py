"""Fast similarity sketching: rounds of hashed bin placement (Dahlgaard, Knudsen and Thorup, 2017).

In round ``i`` of the first ``t`` rounds, every element of a set goes to a hashed bin with a hashed value
in ``[i, i + 1)``; in round ``t + j`` every element goes to bin ``j``. A bin keeps the smallest value that
it ever gets. A set takes part in rounds until its bins are full, so a large set needs one round or two,
and the last ``t`` rounds fill every bin of the smallest. Two sets agree in a bin with probability equal to their
Jaccard similarity, and the number of agreeing bins is concentrated as for independent hashing.
"""

from __future__ import annotations

import numpy as np

from .shingles import GOLD, mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` for each set; a set without elements keeps ``EMPTY`` everywhere."""
    n = len(bounds) - 1
    table = np.full((n, bins), EMPTY, np.uint64)
    flat = table.reshape(-1)
    sizes = np.diff(bounds)
    open_sets = np.flatnonzero(sizes > 0)
    owner = np.repeat(np.arange(n), sizes)
    for turn in range(2 * bins):
        if not len(open_sets):
            break
        seed = np.uint64((turn + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        hashed = mix(values * GOLD + seed)
        low = hashed & np.uint64(0xFFFFFFFF)
        place = (hashed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32) if turn < bins else np.uint64(turn - bins)
        np.minimum.at(flat, owner * bins + place.astype(np.int64), (np.uint64(turn) << np.uint64(32)) | low)
        still = (table[open_sets] == EMPTY).any(axis=1)
        if not still.all():
            open_sets = open_sets[still]
            keep = np.zeros(n, bool)
            keep[open_sets] = True
            chosen = keep[owner]
            values, owner = values[chosen], owner[chosen]
    return table


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` bins."""
    n, bins = table.shape
    parts = table.reshape(n, bins // rows, rows)
    keys = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * GOLD + parts[:, :, k])
    return keys


def signatures(table: np.ndarray) -> np.ndarray:
    """One byte of each bin, enough to estimate the similarity from below by 1/256 at most."""
    return (mix(table) & np.uint64(0xFF)).astype(np.uint8)

"""Periodic runs of words by block convolution.

A run is a maximal stretch of words with smallest period q and at least ``REPEATS`` periods. For the
dyadic scale B with B <= q < 2 B, a run holds an aligned block of B words within its first 2 B - 1
words, and that block and the next one occur again q words later. So, at every scale:

1. Each aligned block of B words meets the window of the following 2 B - 1 words in an exact integer
   convolution (``block_ntt``): squared differences that sum to zero give the distances d in [B, 2 B)
   at which the block occurs again.
2. Neighbouring blocks that share a distance form a chain. A chain of two or more seeds an extension,
   word by word, by less than a block on either side; the stretch that results is maximal.
3. A stretch of at least max(``LEAST``, ``REPEATS`` * d) words is a run, unless a smaller scale or
   distance has given the same stretch: its period is then a divisor of d.

Two exact arguments keep the work near-linear; neither changes a result. A block can occur again within
2 B words only if each of its words does, so blocks with a word whose next occurrence is farther away
are not transformed. And a block whose whole window lies in a run of a smaller period q occurs there
only at multiples of q, since two periods within one stretch have a common divisor as period.

Documents are independent: Spark splits them, a task takes slices of some megabytes of text and works
on all their blocks at once; nothing is shuffled. A task holds about 150 bytes for each word of a slice, or
of a single document if that is longer.

Defined results: a null text has no words; the words of a row with a null doc_id are never rearranged;
rows that repeat a doc_id or a text are judged each for itself; a text is judged as a whole, whatever its
length; further columns are ignored; an empty table gives no rows. Where several runs have the greatest
length, the smallest start is reported, then the smallest period.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, slices, text_bytes

REPEATS = 4
LEAST = 6
PLANT = 10

RUNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed binary"
)


def next_places(codes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """How far each word's next occurrence in its document is; a huge number if there is none."""
    n = len(codes)
    far = np.full(n, n + 1, np.int64)
    order = np.lexsort((codes, owners))
    same = (codes[order[1:]] == codes[order[:-1]]) & (owners[order[1:]] == owners[order[:-1]])
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


class Found:
    """The runs so far, by document, as sorted intervals."""

    def __init__(self, n: int):
        self.runs: list[tuple[int, int, int]] = []
        self.known: set[tuple[int, int]] = set()
        #: Per word, the greatest end of a run that begins there or before.
        self.reach = np.zeros(n + 1, np.int64)

    def add(self, start: int, end: int, period: int) -> None:
        self.runs.append((start, end, period))
        self.known.add((start, end))

    def settle(self) -> None:
        """Make the runs count for ``inside``."""
        ends = np.zeros_like(self.reach)
        for start, end, _ in self.runs:
            ends[start] = max(ends[start], end)
        self.reach = np.maximum.accumulate(ends)

    def inside(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each stretch lies within one run."""
        return self.reach[starts] >= ends


def stretch_from(codes: np.ndarray, low: int, high: int, d: int, first: int, end: int, step: int) -> tuple[int, int]:
    """Extend [low, high), where each word equals the one ``d`` later, within the document [first, end)."""
    while low > first:
        part = max(first, low - step)
        differ = np.flatnonzero(codes[part:low] != codes[part + d : low + d])
        if len(differ):
            low = part + int(differ[-1]) + 1
            break
        low = part
    while high + d < end:
        part = min(end - d, high + step)
        differ = np.flatnonzero(codes[high:part] != codes[high + d : part + d])
        if len(differ):
            high += int(differ[0])
            break
        high = part
    return low, high


def scale_seeds(codes: np.ndarray, blocks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of every occurrence of the given blocks of ``length`` in the window after each."""
    from .block_ntt import BATCH, agreements

    found_blocks, found_distances = [], []
    each = max(1, BATCH // (2 * length))
    here, ahead = np.arange(length), np.arange(2 * length - 1) + length
    for start in range(0, len(blocks), each):
        part = blocks[start : start + each]
        places = part * length
        # Words beyond a batch never occur in it, so the last windows may be filled up with a new code.
        row, shift = np.nonzero(agreements(codes[places[:, None] + here], codes[places[:, None] + ahead]))
        found_blocks.append(part[row])
        found_distances.append(shift + length)
    if not found_blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_blocks), np.concatenate(found_distances)


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; ``codes`` holds documents one after the other, cut at ``bounds``.

    Codes are numbers from 0, equal for equal words; a run never crosses a bound.
    """
    n = len(codes)
    if not n:
        return []
    lengths = np.diff(bounds)
    owners = np.repeat(np.arange(len(lengths)), lengths)
    far = next_places(codes, owners)
    longest = int(lengths.max())
    found, length, farthest = Found(n), 1, far
    ends = bounds[1:][owners]
    padded = np.concatenate([codes, np.full(3 * max(1, longest // REPEATS) + 2, codes.max() + 1, codes.dtype)])
    while REPEATS * length <= longest:
        # Every word of a block must come again soon enough, and no smaller period may explain the window.
        places = np.arange(len(farthest)) * length
        fit = (farthest < 2 * length) & (places + 2 * length <= ends[places])
        fit &= ~found.inside(places, np.minimum(places + 3 * length, n))
        blocks, distances = scale_seeds(padded, np.flatnonzero(fit), length)
        within = blocks * length + length + distances <= ends[blocks * length]
        blocks, distances = blocks[within], distances[within]
        order = np.lexsort((blocks, distances))
        blocks, distances = blocks[order], distances[order]
        breaks = np.flatnonzero((np.diff(blocks) != 1) | (np.diff(distances) != 0)) + 1
        heads = np.concatenate([[0], breaks]).astype(np.int64) if len(blocks) else np.zeros(0, np.int64)
        tails = np.concatenate([breaks, [len(blocks)]]).astype(np.int64)[: len(heads)]
        heads, tails = heads[tails - heads > 1], tails[tails - heads > 1]
        lows, highs, spans = blocks[heads] * length, (blocks[tails - 1] + 1) * length, distances[heads]
        fresh = ~found.inside(lows, highs + spans)
        for low, high, d in zip(lows[fresh].tolist(), highs[fresh].tolist(), spans[fresh].tolist(), strict=True):
            owner = owners[low]
            first, end = int(bounds[owner]), int(bounds[owner + 1])
            low, high = stretch_from(codes, low, high, d, first, end, max(64, length))
            if high + d - low >= max(LEAST, REPEATS * d) and (low, high + d) not in found.known:
                found.add(low, high + d, d)
        found.settle()
        length *= 2
        if len(farthest) % 2:
            farthest = np.append(farthest, n + 1)
        farthest = np.maximum(farthest[::2], farthest[1::2])
    return sorted((start, end - start, period) for start, end, period in found.runs)


def planted(codes: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words' order after the contract's rewriting: every tenth document repeats from some word on."""
    n, places = len(codes), np.arange(len(codes))
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % PLANT or not n:
        return places
    g = h // PLANT
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % p
    return places


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays when every run is collapsed to its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def judge_slice(docs: list[int | None], bodies: list[bytes]) -> list[tuple]:
    """A row of ``RUNS`` for each document."""
    known: dict[bytes, int] = {}
    parts = []
    for doc, body in zip(docs, bodies, strict=True):
        split = body.split()
        codes = np.fromiter((known.setdefault(w, len(known)) for w in split), np.int64, len(split))
        parts.append(codes[planted(codes, doc)])
    words = list(known)
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in parts])]).astype(np.int64)
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    by_doc: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    runs = runs_of(codes, bounds)
    if runs:
        owner = np.searchsorted(bounds, [r[0] for r in runs], side="right") - 1
        for k, (start, length, period) in zip(owner.tolist(), runs, strict=True):
            by_doc[k].append((start - int(bounds[k]), length, period))
    out = []
    for doc, part, here in zip(docs, parts, by_doc, strict=True):
        text = b" ".join([words[c] for c in part[kept_words(len(part), here)].tolist()])
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in here)
        best = min(here, key=lambda r: (-r[1], r[0], r[2]), default=None)
        cells = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        shown = [{"start": s, "length": n, "period": p} for s, n, p in here]
        out.append((doc, len(here), *cells, sha256(listed.encode()).hexdigest(), sha256(text).hexdigest(), shown, text))
    return out


def periodic_runs(docs: DataFrame, texts: bool = True) -> DataFrame:
    """A row for each document: its runs and, with ``texts``, the text with each run collapsed to one period."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
        types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(run), pa.binary()]
        for batch in slices(batches, "body"):
            rows = judge_slice(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist())
            columns = [list(c) for c in zip(*rows, strict=True)]
            if not texts:
                columns[-2:] = [[None] * len(rows)] * 2
            yield arrow_batch(names, types, columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(judge, RUNS)

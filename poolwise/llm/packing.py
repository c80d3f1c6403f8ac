"""Packing token sequences by dot-product vector bin packing.

A bin is a sequence with three limits: tokens, segments and loss-bearing tokens. Items are what is left
of documents after whole sequences are cut off. A bin repeatedly takes, of the waiting items that fit,
the one whose demand has the largest dot product with what is left in the bin, each dimension as a share
of its limit. When nothing fits, the item with the largest dot product is cut so that it fills the bin;
its rest waits on. A bin whose segments or loss tokens run out early is cut back to a power of two, the
lengths that need no padding, and so are the last items of a split. Nothing is padded.

Every input split packs its own rows, so no row is shuffled and no group is gathered: a task holds at
most ``WINDOW`` waiting items, each shorter than a sequence. sequence_id is the task's number times 2^32 plus a
count. A retried task reads the same split in the same order and makes the same sequences.

Defined results: a null text is empty and packs as its end id alone; a text is packed as a whole, whatever its
length, in time that grows with it; repeated rows are packed each; a
null doc_id stays null; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, slices, text_bytes

END_ID = 2
WINDOW = 512

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass
class Item:
    """Part of a document from ``start``; of the document's ids, those before ``masked`` bear no loss."""

    doc: int | None
    start: int
    ids: bytes | memoryview
    total: int
    masked: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def loss(self, length: int | None = None) -> int:
        end = self.start + (self.length if length is None else length)
        return max(0, end - max(self.start, self.masked))

    def cut(self, length: int) -> tuple[Item, Item]:
        head = Item(self.doc, self.start, self.ids[: 4 * length], self.total, self.masked)
        return head, Item(self.doc, self.start + length, self.ids[4 * length :], self.total, self.masked)

    def cut_for(self, tokens: int, loss: int) -> int:
        """The longest head with at most ``tokens`` ids and ``loss`` loss-bearing ones."""
        free = max(0, min(self.masked - self.start, self.length))
        return min(self.length, tokens, free + loss)


class Packer:
    def __init__(self, limits: Limits, task: int, window: int = WINDOW):
        self.limits, self.window = limits, window
        self.sequence = task << 32
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.items: list[Item | None] = [None] * (2 * window)
        self.demand = np.full((2 * window, 3), np.inf)
        self.free = list(range(2 * window))
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: bytes, masked: int = 0) -> None:
        view, size, start, total = memoryview(ids), self.limits.tokens, 0, len(ids) // 4
        # Whole sequences are views of one buffer; what waits is a copy shorter than them, unless loss tokens run out first.
        while total - start >= size and min(size, max(0, masked - start)) + self.limits.loss_tokens >= size:
            self._close([Item(doc, start, view[4 * start : 4 * (start + size)], total, masked)])
            start += size
        if start < total:
            self._wait(Item(doc, start, bytes(view[4 * start :]), total, masked))
        while len(self.items) - len(self.free) >= self.window:
            self._fill()

    def finish(self) -> None:
        while len(self.free) < len(self.items):
            self._fill()

    def _wait(self, item: Item) -> None:
        if not self.free:
            self.free = list(range(len(self.items), 2 * len(self.items)))
            self.demand = np.vstack([self.demand, np.full_like(self.demand, np.inf)])
            self.items += [None] * len(self.items)
        slot = self.free.pop()
        self.items[slot] = item
        self.demand[slot] = item.length / self.caps[0], 1 / self.caps[1], item.loss() / self.caps[2]

    def _take(self, slot: int) -> Item:
        item, self.items[slot] = self.items[slot], None
        self.demand[slot] = np.inf
        self.free.append(slot)
        return item

    def _fill(self) -> None:
        left, taken = np.ones(3), []
        used = [0, 0, 0]
        while used[0] < self.limits.tokens and used[1] < self.limits.segments:
            fits = (self.demand <= left + 1e-9).all(axis=1)
            here = np.isfinite(self.demand[:, 0])
            if not here.any():
                break
            pool = fits if fits.any() else here
            score = np.where(pool, np.where(here[:, None], self.demand, 0) @ left, -1.0)
            item = self._take(int(score.argmax()))
            n = item.cut_for(self.limits.tokens - used[0], self.limits.loss_tokens - used[2])
            if n == 0:
                self._wait(item)
                break
            if n < item.length:
                item, rest = item.cut(n)
                self._wait(rest)
            taken.append(item)
            used = [used[0] + n, used[1] + 1, used[2] + item.loss()]
            left = 1 - np.array(used) / self.caps
        total = used[0]
        aim = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        while total > aim:
            item = taken.pop()
            total -= item.length
            if total < aim:
                item, rest = item.cut(aim - total)
                taken.append(item)
                total = aim
                self._wait(rest)
            else:
                self._wait(item)
        self._close(taken)

    def _close(self, taken: list[Item]) -> None:
        at = 0
        for x in taken:
            self.rows.append((x.doc, x.start, x.length, zlib.crc32(x.ids), x.total, self.sequence, at, x.loss()))
            at += x.length
        self.sequence += 1


def pack(
    docs: DataFrame,
    vocabulary: str,
    limits: Limits = Limits(),
    masked_tokens: Column | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece; ``masked_tokens`` says how many leading ids of a row bear no loss (a prompt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import WordEncoder, encoder

        end = end_id.to_bytes(4, "little")
        encode = encoder(WordEncoder, vocabulary).encode
        packer = Packer(limits, TaskContext.get().partitionId())
        names = [f.split()[0] for f in PIECES.split(", ")]

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return arrow_batch(names, [pa.int64()] * 8, list(zip(*rows, strict=True)) if rows else [[]] * 8)

        for batch in slices(batches, "body"):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "body", "masked")]
            for doc, body, masked in zip(*columns, strict=True):
                packer.add(doc, encode(body) + end, masked)
            yield out()
        packer.finish()
        yield out()

    masked = F.lit(0) if masked_tokens is None else F.coalesce(masked_tokens, F.lit(0))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"), masked.cast("long").alias("masked"))
    return read.mapInArrow(run, PIECES)

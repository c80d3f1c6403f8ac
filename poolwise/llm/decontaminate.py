"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Items and documents are cut into normalised words. A window is ``size`` consecutive words of an item; a
shorter item is one window. Each task codes a document's words by the items' vocabulary, hashes every
window of every length that items have, looks the hashes up in the sorted set and verifies the hits word
by word. Documents are never shuffled.

The set is broadcast, so its size is bounded: items are taken in blocks of about ``BLOCK_CHARS``
bytes by a running sum, and a block's arrays hold at most about 14 bytes for each of them. Where a benchmark needs several blocks, each adds its hits to what the blocks before it
have found, and the rows are staged in between.

Defined results: null or wordless texts and items have no windows; an item without an item_id hits words like any
other but is not among the items found; an item whose text repeats counts under each item_id; a null doc_id is
judged and stays null; a text is judged as a whole, whatever its length; repeated (doc_id) rows are judged each by their own text; further columns are
ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, staged, text_bytes

WINDOW_WORDS = 10
BLOCK_CHARS = 8 << 20

#: ASCII letters and digits stay, letters in lower case; bytes of other scripts stay; all else parts words.
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(KEEP).split()


class NgramSet:
    """Windows by length, as arrays: sorted hashes, where each window stands in the items' words, and its items.

    A window takes about 24 bytes besides the words' codes, whatever its length.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], size: int):
        self.codes: dict[bytes, int] = {}
        self.ids = [item for item, _ in items]
        coded = [np.fromiter((self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(data)), np.uint32) for _, data in items]
        n_words = np.array([len(c) for c in coded], np.int64)
        first = np.cumsum(n_words) - n_words
        self.flat = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
        self.sets = {}
        lengths = np.minimum(n_words, size)
        for n in sorted(set(lengths.tolist()) - {0}):
            chosen = np.flatnonzero(lengths == n)
            counts = n_words[chosen] - n + 1
            owner = np.repeat(chosen, counts)
            starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
            self.sets[n] = self._sorted(starts, owner, n)

    def _sorted(self, starts: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Hash and place of each different window, and bounds of its items in one array."""
        hashes = self.rolling([self.flat[starts + k] for k in range(n)])
        order = np.lexsort((owner, *(self.flat[starts + k] for k in range(n)), hashes))
        hashes, starts, owner = hashes[order], starts[order], owner[order]
        new = np.ones(len(starts), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for k in range(n):
            part = self.flat[starts + k]
            new[1:] |= part[1:] != part[:-1]
        heads = np.flatnonzero(new)
        return hashes[heads], starts[heads].astype(np.int64), np.append(heads, len(starts)), owner.astype(np.int32)

    @staticmethod
    def rolling(columns: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            total = (total ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return total

    def _verified(self, coded: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places ``at`` begin a window of the set, and the window's number."""
        hashes, starts, _, _ = self.sets[n]
        rolled = self.rolling([coded[at + k] for k in range(n)])
        place = np.searchsorted(hashes, rolled)
        found = np.full(len(at), -1)
        open_ = np.flatnonzero(place < len(hashes))
        while len(open_):
            open_ = open_[hashes[place[open_]] == rolled[open_]]
            same = np.ones(len(open_), bool)
            for k in range(n):
                same &= self.flat[starts[place[open_]] + k] == coded[at[open_] + k]
            found[open_[same]] = place[open_[same]]
            # Different windows with one hash stand side by side.
            open_ = open_[~same]
            place[open_] += 1
            open_ = open_[place[open_] < len(hashes)]
        hit = found >= 0
        return at[hit], found[hit]

    def find(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Hit word positions and the named items found in ``words``."""
        get = self.codes.get
        coded = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        known = np.concatenate([[0], np.cumsum(coded != 0)])
        marks, found = np.zeros(len(words) + 1, np.int64), set()
        for n, (_, _, bounds, owner) in self.sets.items():
            if len(words) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            at, windows = self._verified(coded, at, n) if len(at) else (at, at)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + n, -1)
            for w in np.unique(windows).tolist():
                found.update(self.ids[k] for k in owner[bounds[w] : bounds[w + 1]].tolist())
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0), sorted(found - {None})


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items with words, in blocks whose size is bounded; only one block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("body")).where(F.octet_length("body") > 0)
    total = items.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    if total <= block_chars:
        yield [(r.item_id, bytes(r.body)) for r in items.collect()]
        return
    keyed = items.withColumn("key", F.struct(F.xxhash64("body").alias("h"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i")))
    sizes = keyed.select("key", F.octet_length("body").cast("long").alias("n"))
    running = staged(sizes.select("key", F.floor(F.sum("n").over(Window.orderBy("key")) / block_chars).alias("b")), "blocks")
    bounds = running.groupBy("b").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # Rows that agree in key may be in two blocks, which finds nothing twice.
    for b in [r.b for r in bounds.select("b").orderBy("b").collect()]:
        chosen = keyed.join(F.broadcast(bounds.where(F.col("b") == b)), F.col("key").between(F.col("low"), F.col("high")))
        yield [(r.item_id, bytes(r.body)) for r in chosen.select("item_id", "body").collect()]


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row of ``docs`` as struct ``doc``, with n_words, hit_words (positions) and items (ids of occurring items)."""
    spark = docs.sparkSession
    empty = F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<long>").alias("items")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.lit(0).cast("long").alias("n_words"), *empty)
    schema = found.schema

    def scan(rows: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(NgramSet(items, size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = shared.value
            for batch in batches:
                texts = batch.column("doc").field("text")
                before = zip(batch.column("hit_words").to_pylist(), batch.column("items").to_pylist(), strict=True)
                n_words, hit, held = [], [], []
                for row, (old_places, old_items) in enumerate(before):
                    words = words_of((texts[row].as_py() or "").encode())
                    places, items = grams.find(words)
                    n_words.append(len(words))
                    hit.append(np.union1d(old_places, places).astype(np.int32))
                    held.append(sorted({*old_items, *items}))
                cells = [batch.column("doc"), n_words, hit, held]
                types = [None, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield arrow_batch(["doc", "n_words", "hit_words", "items"], types, cells)

        return rows.mapInArrow(run, schema)

    blocks = item_blocks(benchmark, block_chars)
    found = scan(found, next(blocks, []))
    for items in blocks:
        found = scan(staged(found, "hits"), items)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits(docs.select("doc_id", "text"), benchmark, size).select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    return hits(docs, benchmark, size).where(F.size("hit_words") == 0).select("doc.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with every hit word cut out of its text, along with what parts it from the next word."""
    out = hits(docs, benchmark, size)
    # A word and the marks after it, as positions of the text are counted; the class is that of KEEP.
    tokens = F.regexp_extract_all(F.col("doc.text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(F.col("doc.text"), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    left = F.filter(tokens, lambda x, i: ~F.array_contains("hit_words", i))
    text = F.when(F.size("hit_words") > 0, F.concat(lead, F.array_join(left, ""))).otherwise(F.col("doc.text"))
    return out.withColumn("doc", F.col("doc").withField("text", text)).select("doc.*")

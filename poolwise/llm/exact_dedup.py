"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after replacing each white-space run by one space.

1. Every input split inserts its texts into a trie of its own. The first row of each distinct text
   carries the text on; the others only name that row. A group of copies that holds a third of all
   rows thereby shrinks to one row per split before anything is shuffled. The trie is emptied when it
   holds ``LOCAL_BYTES``; a text may then have two carriers, which the owners join again.
2. Carriers go to the partition that owns their (length, content hash) and arrive in byte order, so
   Spark sorts and spills them. The owner inserts full byte strings; when the next string has left a
   subtree, that subtree is complete, is emitted and freed. A terminal holds its smallest carrier and the
   list of them, at most one for each flush of a split. Only the open path stays in memory.
3. Counts and smallest doc_ids are summed per carrier, then per owner, on narrow rows. Rows find their
   answer by the number of their carrier; a carrier stands for rows of one split at most, so no join
   key is hot.

Defined results: a null text equals the empty text; a null doc_id sorts after all others; among equal
texts with equal doc_id the row read first stays, so exactly one row of a group is kept; further
columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, slices, staged, text_key

LOCAL_BYTES = 48 << 20
WHITE_SPACE = r"[\x20\x09-\x0D]+"

LOCAL_SCHEMA = "row_id long, doc_id long, text_key long, text_sha256 string, carrier long, n_bytes int, body binary"


def local_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .trie import PatriciaTrie

    trie = PatriciaTrie()
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int32(), pa.binary()]
    names = ["row_id", "doc_id", "text_key", "text_sha256", "carrier", "n_bytes", "body"]
    for batch in slices(batches, "body"):
        rows, bodies = batch.column("row_id").to_pylist(), batch.column("body").to_pylist()
        carriers, carried = [], []
        for row, body in zip(rows, bodies, strict=True):
            node = trie.terminal(body)
            first = node.entry is None
            if first:
                node.entry = row
            carriers.append(node.entry)
            carried.append(body if first else None)
        read = [batch.column(c) for c in ("row_id", "doc_id", "text_key", "text_sha256")]
        yield arrow_batch(names, types, [*read, carriers, [len(b) for b in bodies], carried])
        if trie.held > LOCAL_BYTES:
            trie = PatriciaTrie()


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .trie import PatriciaTrie

    trie = PatriciaTrie()
    names, types = ["carrier", "owner"], [pa.int64()] * 2

    def out(done: list[list]) -> pa.RecordBatch:
        cells = [(carrier, least) for least, held in done for carrier in held]
        return arrow_batch(names, types, list(zip(*cells, strict=True)) if cells else [[], []])

    for batch in slices(batches, "body"):
        done: list[list] = []
        for body, carrier in zip(batch.column("body").to_pylist(), batch.column("carrier").to_pylist(), strict=True):
            node = trie.terminal(body)
            if node.entry is None:
                node.entry = [carrier, [carrier]]
                done.extend(trie.finished(body))
            else:
                node.entry[0] = min(node.entry[0], carrier)
                node.entry[1].append(carrier)
        yield out(done)
    yield out(list(trie.drain()))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key."""
    body = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITE_SPACE, " ")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), body.alias("body")).select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "text_key",
        F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
        F.col("body").cast("binary").alias("body"),
    )
    local = staged(
        read.mapInArrow(local_pass, LOCAL_SCHEMA),
        "exact",
    )
    owners = (
        local.where(F.col("body").isNotNull())
        .select("carrier", "n_bytes", "body")
        .repartition("n_bytes", F.xxhash64("body"))
        .sortWithinPartitions("body", "carrier")
        .mapInArrow(own, "carrier long, owner long")
    )
    rows = local.select("row_id", "doc_id", "text_key", "text_sha256", "carrier")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id"))
    per_carrier = rows.groupBy("carrier").agg(F.count("*").alias("n"), least.alias("least")).join(owners, "carrier")
    groups = per_carrier.groupBy("owner").agg(F.sum("n").alias("group_size"), F.min("least").alias("least"))
    answers = per_carrier.select("carrier", "owner").join(groups, "owner")
    return rows.join(answers, "carrier").select(
        "doc_id",
        F.col("least.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("least.row_id")).alias("kept"),
        "text_sha256",
        "text_key",
    )

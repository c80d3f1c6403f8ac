"""Token-id output: documents in doc_id order, written as plane files (``planes.py``) and read back.

Documents are range-partitioned and sorted by (doc_id, first bytes of the text, place in the input), so not even rows
that repeat a doc_id and a text have to meet in one task. Each task encodes and streams one shard
file into shared storage, and a manifest row names what it wrote. A file's name holds the task attempt,
so a retried or speculative task never touches the file of another; only the attempt that succeeded is
in the manifest. Where a shard begins is a running sum over the manifest, which has a row per shard.

Defined results: a null text is encoded as empty; a row with a null doc_id comes first, is marked as such
and read back as null; equal doc_ids follow in the order of the first ``HEAD_BYTES`` bytes
of their texts, then of their places; a text is written as a whole; further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batch, shared_path, slices, staged, text_bytes

END_ID = 0
HEAD_BYTES = 64
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def open_shared(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write_shards(docs: DataFrame, folder: str, vocabulary: str, planes: str = "byte", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents below ``folder``; returns the manifest, already materialised."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import ByteLevelEncoder, encoder
        from .planes import PlaneWriter

        end = end_id.to_bytes(4, "little")
        encode = encoder(ByteLevelEncoder, vocabulary).encode
        task, writer = TaskContext.get(), None
        for batch in slices(batches, "body"):
            if writer is None:
                files, at = open_shared(folder)
                files.create_dir(at, recursive=True)
                name = f"{task.partitionId():06d}-{task.taskAttemptId()}.planes"
                sink = files.open_output_stream(f"{at}/{name}")
                writer = PlaneWriter(sink, planes)
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                writer.add(doc, encode(body) + end)
        if writer is not None:
            writer.close()
            sink.close()
            cells = [[task.partitionId()], [f"{folder}/{name}"], [len(writer.docs)], [writer.n_ids], [writer.at]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield arrow_batch(["shard", "path", "n_docs", "n_ids", "n_bytes"], types, cells)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"), F.substring(text_bytes(), 1, HEAD_BYTES).alias("head"), F.monotonically_increasing_id().alias("place")
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("head"), F.col("place")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "body")
    return staged(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .planes import PlaneReader

        names, types = ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                files, at = open_shared(path)
                with files.open_input_file(at) as source:
                    rows = []
                    for doc, length, parts in PlaneReader(source).documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part, crc)
                        rows.append((doc, start, length, crc))
                        start += length
                        if len(rows) == 4096:
                            yield arrow_batch(names, types, list(zip(*rows, strict=True)))
                            rows = []
                    if rows:
                        yield arrow_batch(names, types, list(zip(*rows, strict=True)))

    # One task for each file: an explicit number, since Spark would join such small rows into one task.
    spread = placed.repartitionByRange(max(1, manifest.count()), "shard").select("path", "first")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(spark: SparkSession, docs: DataFrame, vocabulary: str, planes: str = "byte") -> DataFrame:
    return read_shards(write_shards(docs, shared_path(spark, "planes"), vocabulary, planes))

"""Helpers that every operator of this subpackage shares: reading, staging, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.session import ensure_checkpoint_dir, ship_package

#: Bytes of text that a task turns into Python objects at once.
SLICE_BYTES = 4 << 20

_STAGED: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


@contextmanager
def own_files(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the paths that are staged inside, for whoever knows when their readers are done."""
    outer = _STAGED.pop(spark.sparkContext.applicationId, None)
    paths: list[str] = []
    _STAGED[spark.sparkContext.applicationId] = paths
    try:
        yield paths
    finally:
        _STAGED[spark.sparkContext.applicationId] = [*(outer or []), *paths]


def release_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged; results not yet written are lost with it."""
    delete_paths(spark, _STAGED.pop(spark.sparkContext.applicationId, []))


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_remainder(modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % F.lit(modulus)


def text_key() -> Column:
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.xxhash64("text")


def kept_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, text_key, kept; a row per row of ``docs``) keeps.

    Rows that repeat both doc_id and text are one candidate; of these a single row stays.
    """
    keys = staged(
        decisions.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept").drop("kept"),
        "kept",
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    found = rows.join(keys, rows.id.eqNullSafe(keys.doc_id) & (rows.key == keys.text_key)).select("doc", "id", "key", "n")
    if keys.where("n > 1").isEmpty():
        return found.select("doc.*")
    once = found.where("n > 1").dropDuplicates(["id", "key"])
    return found.where("n = 1").unionByName(once).select("doc.*")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes in each, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start = total = 0
        for row, size in enumerate(sizes):
            size = 0 if size != size else int(size)
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        yield batch.slice(start)


def arrow_batch(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)

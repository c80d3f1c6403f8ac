"""Files that tasks open themselves, where Spark's own readers would take a file whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every file at or below ``path``; contents are not read, files without bytes not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def open_file(uri: str):
    """A seekable file on any file system that the executors reach by address."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    if "://" not in uri:
        return fs.LocalFileSystem().open_input_file(uri)
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)

"""The canonical trace on storage: data files, a table of their digests, a manifest that binds the table.

A task hashes a file in blocks, so a file may have any size. The digests stay in a table; the manifest holds
only their Merkle root.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import (
    JOB_SCHEMA_V1,
    JOB_SCHEMA_V2,
    NODE_SCHEMA,
    Trace,
    canonical_sha256,
)
from ..operators.slicing import require_valid
from ..session import ship_package
from .files import listed, open_file

MANIFEST = "trace.json"
SCHEMA_V1, SCHEMA_V2 = "trace/v1", "trace/v2"
# The fields of a manifest.
MANIFEST_KEYS = {
    "schema_version",
    "trace_id",
    "time_origin",
    "source",
    "format",
    "files",
    "trace_fingerprint",
}
ROWS_PER_FILE = 5_000_000
BLOCK_BYTES = 1 << 20
BUCKET_DIGITS = 3
NAMED_FILES = 5
DIGEST_TABLE = "digests"
DIGESTS = "name string, size long, sha256 string"


def safe_child(root: str, name: str) -> str:
    """A path inside ``root``; absolute names and climbs are refused."""
    part = PurePosixPath(str(name))
    if not part.parts or part.is_absolute() or ".." in part.parts or "\\" in str(name):
        raise ValueError(f"Unsafe path: {name!r}")
    return f"{root.rstrip('/')}/{part}"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, size and SHA-256 of every data file below ``path``; a task streams a file in blocks."""
    ship_package(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                seen = sha256()
                with open_file(uri) as source:
                    while block := source.read(BLOCK_BYTES):
                        seen.update(block)
                found.append(seen.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("length"), pa.array(found, pa.string())], ["name", "size", "sha256"])

    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    files = listed(spark, path).withColumn("name", name).where(F.col("name").rlike(r"/part-"))
    # A number of tasks of its own, since Spark would join such small rows into one.
    return files.repartitionByRange(max(1, files.count()), "name").mapInArrow(digest, DIGESTS)


def digest_root(digests: DataFrame) -> tuple[int, int, str]:
    """Number, bytes and Merkle root of digest rows: files below buckets of their name's hash, buckets below the root."""
    leaf = F.concat_ws(" ", "name", "size", "sha256")
    buckets = digests.groupBy(F.substring(F.sha2("name", 256), 1, BUCKET_DIGITS).alias("bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("digest"),
        F.count("*").alias("n"),
        F.sum("size").alias("bytes"),
    )
    row = buckets.agg(
        F.sum("n").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "bucket", "digest"))), "\n"), 256).alias("root"),
    ).head()
    return row["n"] or 0, row["bytes"] or 0, row["root"]


def described(table: str, digests: DataFrame) -> dict:
    """What the manifest says of the files; its size does not depend on their number."""
    n, size, root = digest_root(digests)
    return {"table": table, "count": n, "bytes": size, "root": root}


def require_same_files(recorded: DataFrame, found: DataFrame) -> None:
    """Raise with the names of files that are missing, new or changed."""
    a, b = recorded.alias("a"), found.alias("b")
    same = F.col("a.sha256").eqNullSafe(F.col("b.sha256")) & F.col("a.size").eqNullSafe(F.col("b.size"))
    wrong = a.join(b, "name", "full").where(~same).select("name").orderBy("name").limit(NAMED_FILES)
    names = [row["name"] for row in wrong.collect()]
    if names:
        raise ValueError(f"Trace files do not match the manifest, first of all {', '.join(names)}")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a report beside its final name, then rename it over the old one in a single step."""
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    target, system = _hadoop_path(spark, path)
    staged, _ = _hadoop_path(spark, path + ".staged")
    stream = system.create(staged, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(system.makeQualified(staged), system.makeQualified(target), options)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _columns(trace: Trace, tenant: bool) -> tuple[DataFrame, DataFrame]:
    schema = JOB_SCHEMA_V2 if tenant else JOB_SCHEMA_V1
    jobs = trace.jobs.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    nodes = trace.nodes.select(*[F.col(f.name).cast(f.dataType) for f in NODE_SCHEMA.fields])
    return nodes, jobs


def write_trace(
    spark: SparkSession,
    root: str,
    trace: Trace,
    source: dict,
    *,
    data_format: str = "parquet",
    verify: bool = True,
) -> dict:
    """Write nodes and jobs range-sorted in parallel, then the manifest that binds them.

    Jobs with tenants make a v2 trace and must all have one; without any it is v1. The written trace is
    loaded again and checked unless ``verify`` is off.
    """
    if data_format not in ("parquet", "csv"):
        raise ValueError("data_format must be parquet or csv")
    if not trace.trace_id or (trace.evaluation_start_seconds is None) != (trace.evaluation_end_seconds is None):
        raise ValueError("A trace needs an id, and both ends of an evaluation window or none")
    tenant = "tenant_id" in trace.jobs.columns
    if tenant:
        blank = F.col("tenant_id").isNull() | (F.col("tenant_id") == "")
        row = trace.jobs.agg(F.count_if(blank).alias("without"), F.count_if(~blank).alias("with")).first()
        if row["without"] and row["with"]:
            raise ValueError(f"{row['without']} jobs of a trace with tenants have none")
        tenant = row["with"] > 0
    nodes, jobs = _columns(trace, tenant)
    ordered = {"nodes": nodes.sort("node_id"), "jobs": jobs.sort("submit_time_seconds", "job_id")}
    for name, df in ordered.items():
        writer = df.write.mode("errorifexists").option("maxRecordsPerFile", ROWS_PER_FILE)
        if data_format == "csv":
            writer = writer.option("header", True)
        writer.format(data_format).save(f"{root}/{name}")
    both = file_digests(spark, f"{root}/nodes").unionByName(file_digests(spark, f"{root}/jobs"))
    both.write.mode("errorifexists").parquet(f"{root}/{DIGEST_TABLE}")
    digests = spark.read.schema(DIGESTS).parquet(f"{root}/{DIGEST_TABLE}")
    manifest = {
        "schema_version": SCHEMA_V2 if tenant else SCHEMA_V1,
        "trace_id": trace.trace_id,
        "time_origin": trace.time_origin,
        "source": source,
        "format": data_format,
        "files": described(DIGEST_TABLE, digests),
    }
    if trace.evaluation_start_seconds is not None:
        manifest["evaluation_window_seconds"] = {
            "start": trace.evaluation_start_seconds,
            "end": trace.evaluation_end_seconds,
        }
    manifest["trace_fingerprint"] = canonical_sha256(manifest)
    write_json(spark, f"{root}/{MANIFEST}", manifest)
    if verify:
        read_trace(spark, root)
    return manifest


def read_trace(spark: SparkSession, root: str) -> Trace:
    """Load a written trace after checking its manifest, its files and its contract."""
    manifest = read_json(spark, safe_child(root, MANIFEST))
    window = manifest.get("evaluation_window_seconds")
    if set(manifest) - {"evaluation_window_seconds"} != MANIFEST_KEYS:
        raise ValueError("Manifest fields differ from the contract")
    payload = {k: v for k, v in manifest.items() if k != "trace_fingerprint"}
    if canonical_sha256(payload) != manifest["trace_fingerprint"]:
        raise ValueError("Manifest fingerprint is invalid")
    recorded = spark.read.schema(DIGESTS).parquet(safe_child(root, manifest["files"]["table"]))
    if described(manifest["files"]["table"], recorded) != manifest["files"]:
        raise ValueError("The digest table does not match the manifest")
    found = file_digests(spark, safe_child(root, "nodes")).unionByName(file_digests(spark, safe_child(root, "jobs")))
    require_same_files(recorded, found)
    tenant = manifest["schema_version"] == SCHEMA_V2
    schemas = {"nodes": NODE_SCHEMA, "jobs": JOB_SCHEMA_V2 if tenant else JOB_SCHEMA_V1}
    frames = {}
    for name, schema in schemas.items():
        reader = spark.read.schema(schema)
        path = safe_child(root, name)
        frames[name] = (
            reader.csv(path, header=True, enforceSchema=False, mode="FAILFAST")
            if manifest["format"] == "csv"
            else reader.parquet(path)
        )
    if window is not None and not window["end"] > window["start"] >= 0:
        raise ValueError("Evaluation window must end after it starts")
    trace = Trace(
        frames["nodes"],
        frames["jobs"],
        manifest["trace_id"],
        manifest["time_origin"],
        window["start"] if window else None,
        window["end"] if window else None,
    )
    return require_valid(trace, tenant_required=tenant)

"""Published trace layouts mapped onto the job and node contract.

Each importer takes raw DataFrames (see the ``read_*`` helpers) so that its filters reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import SERVICE_CLASSES
from ..operators.slicing import one_value
from .json_array import read_json_array


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Columns of the published raw tables.
SPOT_GPU_NODES = _strings("node_name", "gpu_model", "gpu_capacity_num")
SPOT_GPU_JOBS = _strings(
    "job_name",
    "organization",
    "gpu_model",
    "gpu_request",
    "worker_num",
    "submit_time",
    "duration",
    "job_type",
)
QOS_NODES = _strings("sn", "cpu_milli", "memory_mib", "gpu", "model")
QOS_PODS = _strings(
    "name",
    "cpu_milli",
    "memory_mib",
    "num_gpu",
    "gpu_milli",
    "gpu_spec",
    "qos",
    "pod_phase",
    "creation_time",
    "deletion_time",
    "scheduled_time",
)
ATTEMPT_LOG = T.StructType(
    [
        T.StructField("jobid", T.StringType()),
        T.StructField("submitted_time", T.StringType()),
        T.StructField(
            "attempts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start_time", T.StringType()),
                        T.StructField("end_time", T.StringType()),
                        T.StructField(
                            "detail",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("ip", T.StringType()),
                                        T.StructField("gpus", T.ArrayType(T.StringType())),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
# Why a pod is skipped, and the phases that are kept.
SKIP_REASONS = ("unsupported_qos", "excluded_phase", "no_gpu", "missing_or_invalid_interval")
PHASES = ("Running", "Failed", "Succeeded")


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header-checked CSV; a column the layout does not declare is an error, not a guess."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def read_attempt_log(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """The attempt log as a JSON array or as JSON lines; both are split. Broken JSON is an error."""
    if lines:
        return spark.read.schema(ATTEMPT_LOG).json(path, mode="FAILFAST")
    return read_json_array(spark, path, ATTEMPT_LOG)


def read_machine_list(spark: SparkSession, path: str) -> DataFrame:
    """Positional machine list with an optional header and blank rows."""
    raw = spark.read.csv(path, schema=_strings("machine", "gpus", "memory"), header=False)
    name = F.trim("machine")
    return raw.where(
        name.isNotNull() & (name != "") & ~F.lower(name).isin("machineid", "machine_id")
    ).select(
        name.alias("node_id"),
        F.lit("philly-gpu").alias("gpu_model"),
        F.col("gpus").cast("int").alias("gpu_count"),
    )


def spot_gpu_nodes(raw: DataFrame, gpu_models: Iterable[str] | None = None) -> DataFrame:
    if gpu_models is not None:
        raw = raw.where(F.col("gpu_model").isin(*sorted(gpu_models)))
    return raw.select(
        F.trim("node_name").alias("node_id"),
        F.trim("gpu_model").alias("gpu_model"),
        F.col("gpu_capacity_num").cast("int").alias("gpu_count"),
    )


def spot_gpu_jobs(
    raw: DataFrame,
    *,
    gpu_models: Iterable[str] | None = None,
    max_submit: float | None = None,
    warmup_start: float | None = None,
    evaluation_start: float | None = None,
    include_warmup_spot: bool = True,
) -> DataFrame:
    """Spot-GPU job table; total demand is the request of one worker times the workers."""
    submit = F.col("submit_time").cast("double")
    kind = F.trim("job_type")
    kept = raw
    if gpu_models is not None:
        kept = kept.where(F.col("gpu_model").isin(*sorted(gpu_models)))
    if max_submit is not None:
        kept = kept.where(submit <= float(max_submit))
    if warmup_start is not None:
        kept = kept.where(submit >= float(warmup_start))
    if not include_warmup_spot and evaluation_start is not None:
        kept = kept.where(~((kind == "Spot") & (submit < float(evaluation_start))))
    return kept.select(
        F.trim("job_name").alias("job_id"),
        submit.alias("submit_time_seconds"),
        F.col("duration").cast("double").alias("duration_seconds"),
        (F.col("gpu_request").cast("double") * F.col("worker_num").cast("int")).alias("gpu_count"),
        kind.alias("service_class"),
        F.trim("gpu_model").alias("gpu_model"),
        F.trim("organization").alias("tenant_id"),
    )


def qos_nodes(raw: DataFrame) -> DataFrame:
    gpus = F.col("gpu").cast("int")
    return raw.where(gpus > 0).select(
        F.trim("sn").alias("node_id"), F.trim("model").alias("gpu_model"), gpus.alias("gpu_count")
    )


def classify_pods(raw: DataFrame, phases: Iterable[str] = PHASES) -> DataFrame:
    """Tag every pod with the first reason to skip it; null means it is kept."""
    phases = sorted(phases)
    if not phases or not set(phases) <= set(PHASES):
        raise ValueError(f"phases must come from {PHASES}")
    number = F.col("num_gpu").cast("int")
    milli = F.col("gpu_milli").cast("double")
    requested = F.when(number == 1, milli / 1000.0).otherwise(number.cast("double"))
    scheduled_text = F.trim("scheduled_time")
    creation = F.col("creation_time").cast("double")
    scheduled = F.expr("try_cast(trim(scheduled_time) AS DOUBLE)")
    deletion = F.col("deletion_time").cast("double")
    bad_interval = (
        scheduled.isNull() | (creation < 0) | (scheduled < creation) | (deletion <= scheduled)
    )
    reason = (
        F.when(~F.trim("qos").isin("LS", "BE"), "unsupported_qos")
        .when(~F.trim("pod_phase").isin(*phases), "excluded_phase")
        .when(number <= 0, "no_gpu")
        .when((scheduled_text == "") | bad_interval, "missing_or_invalid_interval")
        .when(requested <= 0, "no_gpu")
    )
    return raw.select(
        F.trim("name").alias("job_id"),
        creation.alias("creation"),
        (deletion - scheduled).alias("duration_seconds"),
        requested.alias("gpu_count"),
        F.when(F.trim("qos") == "LS", "HP").otherwise("Spot").alias("service_class"),
        reason.alias("skip_reason"),
    )


def skipped_pods(classified: DataFrame) -> DataFrame:
    """How many pods each reason removed; reasons that removed none are listed with zero."""
    counted = classified.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = classified.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in SKIP_REASONS])).alias("skip_reason")
    )
    return reasons.join(counted, "skip_reason", "left").select(
        "skip_reason", F.coalesce("n", F.lit(0)).cast("long").alias("pod_count")
    )


def qos_jobs(classified: DataFrame) -> DataFrame:
    """Kept pods as jobs any pool can host, on a clock that starts at the first kept arrival."""
    kept = classified.where(F.col("skip_reason").isNull())
    origin = one_value(kept, F.min("creation"))
    return kept.select(
        "job_id",
        (F.col("creation") - origin).alias("submit_time_seconds"),
        "duration_seconds",
        "gpu_count",
        "service_class",
        F.lit("*").alias("gpu_model"),
    )


def _moment(value: Column) -> Column:
    text = F.trim(value)
    return F.when((text != "") & (text != "None"), text.try_cast("timestamp_ntz"))


def _seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def attempt_jobs(log: DataFrame, service_class: str) -> tuple[DataFrame, DataFrame]:
    """Jobs of an attempt log, and how many records were unusable.

    A job's duration is the sum of its valid attempts and its size the largest attempt's GPUs,
    counted inside the record by array functions.
    """
    if service_class not in SERVICE_CLASSES:
        raise ValueError(f"service_class must be one of {SERVICE_CLASSES}")

    def measure(attempt: Column) -> Column:
        start, end = _moment(attempt["start_time"]), _moment(attempt["end_time"])
        gpus = F.aggregate(
            F.coalesce(attempt["detail"], F.array()),
            F.lit(0),
            lambda total, item: total + F.coalesce(F.size(item["gpus"]), F.lit(0)),
        )
        return F.struct(_seconds_between(start, end).alias("seconds"), gpus.alias("gpus"))

    valid = F.filter(F.transform("attempts", measure), lambda a: a["seconds"] > 0)
    parsed = log.select(
        "jobid",
        _moment(F.col("submitted_time")).alias("submitted"),
        F.aggregate(valid, F.lit(0.0), lambda t, a: t + a["seconds"]).alias("duration_seconds"),
        F.array_max(F.transform(valid, lambda a: a["gpus"])).alias("gpus"),
    )
    origin = one_value(parsed, F.min("submitted"))
    usable = F.coalesce(
        F.col("submitted").isNotNull() & (F.col("duration_seconds") > 0) & (F.col("gpus") > 0),
        F.lit(False),
    )
    jobs = parsed.where(usable).select(
        F.col("jobid").alias("job_id"),
        _seconds_between(origin, F.col("submitted")).alias("submit_time_seconds"),
        "duration_seconds",
        F.col("gpus").cast("double").alias("gpu_count"),
        F.lit(service_class).alias("service_class"),
        F.lit("philly-gpu").alias("gpu_model"),
    )
    return jobs, parsed.agg(F.count_if(~usable).alias("skipped_job_count"))

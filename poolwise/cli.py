"""Command line over the library: traces and reports live in folders any Spark source can read."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import HOUR, MULTIWINDOW_ACTIONS, Trace
from .operators import audit, compare, forecast, observation, profile, ranking, slicing
from .operators.metrics import metrics_report
from .operators.slicing import total_capacity
from .session import build_session
from .sources import configs, importers
from .sources.store import read_json, read_trace, write_trace

W = ["window_id"]


def _show(df: DataFrame, limit: int | None = None) -> None:
    """Print all rows as one JSON list, a partition at a time; with a limit, say how many there are."""
    rows = df.select(F.to_json(F.struct("*")).alias("row"))
    shown = rows if limit is None else rows.limit(limit)
    print("[", end="")
    for i, row in enumerate(shown.toLocalIterator()):
        body = json.dumps(json.loads(row["row"]), indent=2, sort_keys=True, ensure_ascii=False)
        print(",\n" if i else "\n", body, sep="", end="")
    print("\n]")
    if limit is not None:
        print(f"at most {limit} of {rows.count()} rows shown", file=sys.stderr)


def _verdict(df: DataFrame, passed: str) -> int:
    """0 if there are rows and all of them pass; judged over every row, whatever is printed."""
    row = df.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(passed, F.lit(False))).alias("ok")).first()
    return 0 if row.n and row.ok else 1


def _report(df: DataFrame, a, passed: str | None = None) -> int:
    """Write the full report if a folder is named, print it, and judge it."""
    if a.out:
        df.write.mode("errorifexists").parquet(a.out)
        df = df.sparkSession.read.parquet(a.out)
    _show(df, a.limit)
    return _verdict(df, passed) if passed else 0


def _metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    frames = [spark.read.parquet(f"{p}/metrics") for p in paths]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def _slo(spark: SparkSession, path: str | None) -> tuple[tuple[audit.Constraint, ...], float]:
    return configs.slo_from(read_json(spark, path)) if path else (audit.DEMO_SLO, audit.ALLOCATION_TIE_BAND)


def _audited(metrics: DataFrame, constraints) -> DataFrame:
    rows = audit.audit_constraints(metrics, W, constraints=constraints, carry=audit.EVIDENCE)
    return audit.audit_summary(rows, ["window_id", "action_id"], constraints)


def validate_trace(spark, a):
    _show(slicing.validate_trace(read_trace(spark, a.trace)))


def import_philly(spark, a):
    log = importers.read_attempt_log(spark, a.job_log, lines=a.lines)
    jobs, skipped = importers.attempt_jobs(log, a.service_class)
    trace = Trace(importers.read_machine_list(spark, a.machines), jobs, a.trace_id)
    source = {"service_class": a.service_class, **skipped.first().asDict()}
    write_trace(spark, a.out, trace, source, data_format=a.format)


def import_alibaba(spark, a):
    models = set(a.gpu_model) if a.gpu_model else None
    nodes = importers.read_raw_csv(spark, a.nodes, importers.SPOT_GPU_NODES)
    jobs = importers.read_raw_csv(spark, a.jobs, importers.SPOT_GPU_JOBS)
    trace = Trace(
        importers.spot_gpu_nodes(nodes, models),
        importers.spot_gpu_jobs(
            jobs,
            gpu_models=models,
            max_submit=a.max_submit if a.evaluation_end is None else a.evaluation_end,
            warmup_start=a.warmup_start,
            evaluation_start=a.evaluation_start,
            include_warmup_spot=not a.drop_warmup_spot,
        ),
        a.trace_id,
        a.time_origin,
        a.evaluation_start,
        a.evaluation_end,
    )
    write_trace(spark, a.out, trace, {"gpu_models": sorted(models or [])}, data_format=a.format)


def import_alibaba_v2023(spark, a):
    pods = importers.classify_pods(importers.read_raw_csv(spark, a.pods, importers.QOS_PODS))
    skips = {r.skip_reason: r.pod_count for r in importers.skipped_pods(pods).collect()}
    nodes = importers.qos_nodes(importers.read_raw_csv(spark, a.nodes, importers.QOS_NODES))
    trace = Trace(nodes, importers.qos_jobs(pods), a.trace_id, "1970-01-01 00:00:00")
    write_trace(spark, a.out, trace, {"skipped_rows": skips}, data_format=a.format)


def analyze_trace(spark, a):
    trace = read_trace(spark, a.trace)
    _show(profile.population_by_class(trace.jobs))
    _show(profile.workload_stats(trace.jobs, a.interval))
    _show(profile.regime_signals(trace, a.interval))


def slice_trace(spark, a):
    trace = read_trace(spark, a.trace)
    part = (
        slicing.slice_window(trace, a.warmup_start, a.evaluation_start, a.evaluation_end)
        if a.evaluation_start is not None
        else slicing.slice_prefix(trace, a.max_submit, a.gpu_model)
    )
    write_trace(spark, a.out, part, {"parent_trace_id": trace.trace_id}, data_format=a.format)


def measure_ledger(spark, a):
    """Metrics of a given run ledger (parquet) over given evaluation windows, one folder per report."""
    runs, windows = spark.read.parquet(a.ledger), spark.read.parquet(a.windows)
    report = metrics_report(runs, windows, F.lit(a.capacity)).withColumnRenamed("run_id", "window_id")
    ledger = runs.groupBy(F.col("run_id").alias("window_id"), "action_id").agg(F.bool_and(F.col("end_time_seconds") >= F.col("start_time_seconds")).alias("evidence_valid"))
    marked = report.join(ledger, ["window_id", "action_id"]).withColumns(
        {"source": F.lit(a.ledger), "trace_id": F.lit(a.trace_id)}
    )
    marked.write.mode("errorifexists").parquet(f"{a.out}/metrics")
    _show(spark.read.parquet(f"{a.out}/metrics"), a.limit)


def forecast_demand(spark, a):
    trace = read_trace(spark, a.trace)
    config = configs.controller_from(read_json(spark, a.controller)) if a.controller else forecast.SeasonalConfig()
    step = float(config.observation_interval_seconds)
    seen = observation.observe_classes(trace.jobs, a.cutoff, step, config.lookback_hours)
    start = observation.observation_start(trace.jobs, a.cutoff, step, config.lookback_hours)
    capacity = total_capacity(trace.nodes)
    points = forecast.seasonal_forecast(
        seen.where(F.col("service_class") == "HP"), "active_gpus", start, a.cutoff, capacity, config
    )
    _show(points)
    _show(forecast.quota_plan(points, capacity, [config.initial_eta], config))


def compare_policies(spark, a):
    return _report(compare.compare_two(_metrics(spark, [a.left, a.right]), a.left_action, a.right_action), a, "comparable")


def compare_portfolio(spark, a):
    return _report(compare.pairwise_deltas(_metrics(spark, a.results), a.action or MULTIWINDOW_ACTIONS), a, "comparable")


def audit_slo(spark, a):
    return _report(_audited(_metrics(spark, a.results), _slo(spark, a.slo)[0]), a, "audit_passed")


def rank_policies(spark, a):
    metrics = _metrics(spark, a.results)
    constraints, band = _slo(spark, a.slo)
    audited = ranking.join_audits(metrics, _audited(metrics, constraints), ["window_id", "action_id"])
    return _report(ranking.rank_policies(audited, W, band=band), a)


def show_policy(spark, a):
    """A policy file after its strict checks, with its fingerprint."""
    policy = configs.policy_from(read_json(spark, a.policy_file))
    print(json.dumps({**policy.payload(), "policy_fingerprint": policy.fingerprint}, indent=2, sort_keys=True))


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="poolwise")
    root.add_argument("--master", default=None)
    commands = root.add_subparsers(dest="command", required=True)

    def command(name, handler, *options):
        sub = commands.add_parser(name)
        for flag, settings in options:
            sub.add_argument(flag, **settings)
        sub.set_defaults(handler=handler)

    need = lambda flag, **more: (flag, {"required": True, **more})
    may = lambda flag, default=None, **more: (flag, {"default": default, **more})
    out = (need("--out"), may("--format", "parquet", choices=["parquet", "csv"]))
    number = {"type": float}
    many = {"action": "append"}
    limit, report, slo = may("--limit", type=int), may("--out"), may("--slo")
    window = (may("--warmup-start", **number), may("--evaluation-start", **number), may("--evaluation-end", **number))
    command("validate-trace", validate_trace, need("--trace"))
    command(
        "import-philly", import_philly, need("--job-log"), need("--machines"),
        need("--service-class", choices=["HP", "Spot"]), may("--trace-id", "attempt-log"),
        ("--lines", {"action": "store_true"}), *out,
    )
    command(
        "import-alibaba", import_alibaba, need("--nodes"), need("--jobs"), may("--trace-id", "spot-gpu"),
        may("--time-origin", "2024-03-01 00:00:00"), may("--gpu-model", **many),
        may("--max-submit", **number), ("--drop-warmup-spot", {"action": "store_true"}), *window, *out,
    )
    command("import-alibaba-v2023", import_alibaba_v2023, need("--nodes"), need("--pods"), may("--trace-id", "qos-pods"), *out)
    command("analyze-trace", analyze_trace, need("--trace"), may("--interval", float(HOUR), **number))
    command(
        "slice-trace", slice_trace, need("--trace"), may("--max-submit", **number),
        may("--gpu-model", **many), *window, *out,
    )
    command("forecast-demand", forecast_demand, need("--trace"), need("--cutoff", **number), may("--controller"))
    command(
        "measure-ledger", measure_ledger, need("--ledger"), need("--windows"), need("--capacity", **number),
        may("--trace-id", "ledger"), need("--out"), limit,
    )
    command("check-policy", show_policy, need("--policy-file"))
    command(
        "compare-policies", compare_policies, need("--left"), need("--right"),
        need("--left-action"), need("--right-action"), limit, report,
    )
    command("compare-portfolio", compare_portfolio, need("--results", nargs="+"), may("--action", **many), limit, report)
    command("audit-slo", audit_slo, need("--results", nargs="+"), slo, limit, report)
    command("rank-policies", rank_policies, need("--results", nargs="+"), slo, limit, report)
    return root


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    arguments = parser().parse_args(argv)
    session = spark or build_session("poolwise-cli", arguments.master)
    try:
        return int(arguments.handler(session, arguments) or 0)
    finally:
        if spark is None:
            session.stop()


if __name__ == "__main__":
    sys.exit(main())

"""Commands end to end on a small imported trace."""

import json
import tempfile
from pathlib import Path

import pytest

from poolwise.cli import main, parser


def rows_of(text):
    decoder, at, lists = json.JSONDecoder(), 0, []
    while at < len(text):
        value, at = decoder.raw_decode(text, at)
        lists.append(value)
        while at < len(text) and text[at].isspace():
            at += 1
    return lists


@pytest.fixture(scope="module")
def root():
    base = Path(tempfile.mkdtemp(prefix="poolwise-cli-"))
    (base / "nodes.csv").write_text("node_name,gpu_model,gpu_capacity_num\nn1,A,4\nn2,A,2\n")
    lines = ["job_name,organization,gpu_model,gpu_request,worker_num,submit_time,duration,job_type"]
    for i in range(30):
        kind = "HP" if i % 3 else "Spot"
        lines.append(f"job{i:02d},org{i % 2},A,{1 + i % 2},{1 + i % 3 % 2},{i * 40},{100 + i % 7 * 60},{kind}")
    (base / "jobs.csv").write_text("\n".join(lines) + "\n")
    return base


def test_every_subcommand_is_declared():
    actions = next(a for a in parser()._actions if a.dest == "command")
    assert len(actions.choices) == 13


ACTIONS = ("native-fifo", "native-preemptive-3600", "native-preemptive-g3600-b09-d0000")


@pytest.fixture(scope="module")
def results(spark, root):
    """A small ledger of two windows and three actions, measured by the command."""
    rows = []
    for window in ("w0", "w1"):
        for k, action in enumerate(ACTIONS):
            for j in range(24):
                kind = "HP" if j % 3 else "Spot"
                start = 100.0 * j + 10.0 * k
                hit = kind == "Spot" and k and j % 9 == 0
                rows.append((window, action, f"j{j}", kind, "A", 1.0, 1, 100.0 * j, 60.0, 1, 100.0 * j, start, start + 90, "preempted" if hit else "completed", "t" if hit else None, 5.0 if hit else None, 8.0 if hit else None))
                if hit:
                    rows.append((window, action, f"j{j}", kind, "A", 1.0, 1, 100.0 * j, 60.0, 2, start + 90, start + 120, start + 300, "completed", None, None, None))
    spark.createDataFrame(
        rows,
        "run_id string, action_id string, job_id string, service_class string, gpu_model string, gpu_count double, node_count int, submit_time_seconds double, "
        "guarantee_seconds double, run_ordinal int, queued_since double, start_time_seconds double, end_time_seconds double, end_reason string, trigger_id string, "
        "rollback_seconds double, overhead_seconds double",
    ).write.parquet(str(root / "ledger"))
    windows = [(w, 0.0, 2400.0) for w in ("w0", "w1")]
    spark.createDataFrame(windows, "run_id string, evaluation_start double, evaluation_end double").write.parquet(str(root / "windows"))
    main(["measure-ledger", "--ledger", str(root / "ledger"), "--windows", str(root / "windows"), "--capacity", "8", "--out", str(root / "r")], spark)
    return str(root / "r")


def test_import_and_validate(spark, root, capsys):
    trace = str(root / "trace")
    assert main(["import-alibaba", "--nodes", str(root / "nodes.csv"), "--jobs", str(root / "jobs.csv"), "--out", trace], spark) == 0
    main(["validate-trace", "--trace", trace], spark)
    assert all(r["violation_count"] == 0 for r in rows_of(capsys.readouterr().out)[0])


def test_measure_compare_audit_rank(spark, root, results, capsys):
    capsys.readouterr()
    pair = ["--left-action", ACTIONS[0], "--right-action", ACTIONS[1]]
    assert main(["compare-policies", "--left", results, "--right", results, *pair], spark) == 1  # each report twice
    metrics = spark.read.parquet(f"{results}/metrics")
    for action in ACTIONS:
        metrics.where(metrics.action_id == action).write.mode("overwrite").parquet(str(root / action / "metrics"))
    capsys.readouterr()
    code = main(["compare-policies", "--left", str(root / ACTIONS[0]), "--right", str(root / ACTIONS[1]), *pair], spark)
    deltas = rows_of(capsys.readouterr().out)[0]
    assert code == 0 and len(deltas) == 38
    assert main(["compare-portfolio", "--results", results], spark) == 0
    assert main(["audit-slo", "--results", results, "--limit", "1"], spark) == 1
    capsys.readouterr()
    assert main(["rank-policies", "--results", results, "--out", str(root / "ranking")], spark) == 0
    assert rows_of(capsys.readouterr().out)[-1][0]["selection_status"]
    assert spark.read.parquet(str(root / "ranking")).count() == 2


def test_slo_file_decides_the_audit(spark, root, results, capsys):
    item = {"id": "done", "metric": "hp_completion_rate", "operator": ">=", "severity": "hard", "threshold": 1.0}
    slo = {"constraints": [item], "ranking": {"allocation_tie_band": 0.01}}
    (root / "slo.json").write_text(json.dumps(slo))
    assert main(["audit-slo", "--results", results, "--slo", str(root / "slo.json")], spark) == 0
    item["threshold"] = 1.5
    (root / "slo2.json").write_text(json.dumps(slo))
    assert main(["audit-slo", "--results", results, "--slo", str(root / "slo2.json")], spark) == 1
    capsys.readouterr()


def test_a_failure_beyond_what_is_printed_exits_with_one(spark, root, results, capsys):
    """201 windows of which only the last fails."""
    from pyspark.sql import functions as F

    item = {"id": "done", "metric": "hp_completion_rate", "operator": ">=", "severity": "hard", "threshold": 1.0}
    (root / "slo3.json").write_text(json.dumps({"constraints": [item], "ranking": {"allocation_tie_band": 0.01}}))
    one = spark.read.parquet(f"{results}/metrics").limit(1).drop("window_id").crossJoin(spark.range(201))
    failing = F.when(F.col("id") == 200, 0.5).otherwise(F.col("hp_completion_rate"))
    many = one.withColumn("window_id", F.format_string("w%03d", "id")).withColumn("hp_completion_rate", failing).drop("id")
    many.write.parquet(str(root / "many" / "metrics"))
    for more in ([], ["--limit", "3"]):
        assert main(["audit-slo", "--results", str(root / "many"), "--slo", str(root / "slo3.json"), *more], spark) == 1
    many.where("window_id < 'w200'").write.parquet(str(root / "good" / "metrics"))
    assert main(["audit-slo", "--results", str(root / "good"), "--slo", str(root / "slo3.json")], spark) == 0
    capsys.readouterr()


def test_policy_file_is_checked(spark, root, capsys):
    policy = {"action_id": "a", "scheduler": "fifo", "spot_guarantee_seconds": 0, "checkpoint_interval_seconds": 60, "preemption_overhead_seconds": 0, "placement_strategy": "deterministic_best_fit"}
    (root / "policy.json").write_text(json.dumps(policy))
    assert main(["check-policy", "--policy-file", str(root / "policy.json")], spark) == 0
    assert json.loads(capsys.readouterr().out)["action_id"] == "a"
    (root / "bad.json").write_text(json.dumps({**policy, "node": 1}))
    with pytest.raises(ValueError):
        main(["check-policy", "--policy-file", str(root / "bad.json")], spark)

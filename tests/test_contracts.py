"""Contract checks, storage round trips and refusals."""

import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from poolwise.contracts import JOB_SCHEMA_V2, NODE_SCHEMA, POLICIES, Policy, Trace, canonical_sha256
from poolwise.operators import audit, observation, slicing
from poolwise.operators.ranking import rank_policies
from poolwise.operators.rolling import rule_candidate_sets
from poolwise.sources.store import MANIFEST, read_json, read_trace, safe_child, write_json, write_trace

NODES = [("n1", "A", 4), ("n2", "B", 2)]
JOBS = [
    ("j1", 0.0, 10.0, 1.5, "HP", "A", "t1"),
    ("j2", 3.25, 20.0, 2.0, "Spot", "B", "t2"),
    ("j3", 5.0, 7.0, 4.0, "Spot", "*", "t1"),
]


def make(spark, nodes=NODES, jobs=JOBS):
    return Trace(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(jobs, JOB_SCHEMA_V2))


@pytest.mark.parametrize("data_format", ["parquet", "csv"])
def test_written_trace_reads_back(spark, data_format):
    root = tempfile.mkdtemp(prefix="poolwise-store-") + "/t"
    write_trace(spark, root, make(spark), {"dataset": "x"}, data_format=data_format)
    back = read_trace(spark, root)
    assert sorted(map(tuple, back.jobs.collect())) == sorted(JOBS)
    assert sorted(map(tuple, back.nodes.collect())) == sorted(NODES)


def test_changed_manifest_is_refused(spark):
    root = tempfile.mkdtemp(prefix="poolwise-store-") + "/t"
    write_trace(spark, root, make(spark), {})
    manifest = read_json(spark, f"{root}/{MANIFEST}")
    write_json(spark, f"{root}/{MANIFEST}", {**manifest, "trace_id": "other"})
    with pytest.raises(ValueError):
        read_trace(spark, root)


@pytest.mark.parametrize("name", ["/etc/x", "../x", "a/../../x", ""])
def test_unsafe_paths_are_refused(name):
    with pytest.raises(ValueError):
        safe_child("/data", name)


@pytest.mark.parametrize(
    "bad",
    [
        ("j1", 0.0, 10.0, 9.0, "HP", "A", "t"),
        ("jx", -1.0, 10.0, 1.0, "HP", "A", "t"),
        ("jx", 0.0, 0.0, 1.0, "HP", "A", "t"),
        ("jx", 0.0, 1.0, 1.0, "Batch", "A", "t"),
        ("j1", 0.0, 1.0, 1.0, "HP", "A", "t"),
        ("jx", 0.0, 1.0, 1.0, "HP", "A", " "),
    ],
)
def test_broken_traces_are_refused(spark, bad):
    with pytest.raises(ValueError):
        slicing.require_valid(make(spark, jobs=[*JOBS, bad]))


@pytest.mark.parametrize(
    "window,rule",
    [((1.0, 9.0), None), ((1.0, 4.0), "arrivals_after_window"), ((0.0, 9.0), None), ((3.5, 4.9), "window_without_arrivals")],
)
def test_evaluation_windows_fit_the_arrivals(spark, window, rule):
    trace = replace(make(spark), evaluation_start_seconds=window[0], evaluation_end_seconds=window[1])
    assert rule is None or slicing.extent_rules(trace)[rule]
    if rule is None:
        assert not any(slicing.extent_rules(trace).values())


def test_empty_traces_and_mixed_tenants_are_refused(spark):
    with pytest.raises(ValueError, match="jobs_empty"):
        slicing.require_valid(make(spark, jobs=[]))
    with pytest.raises(ValueError, match="nodes_empty"):
        slicing.require_valid(make(spark, nodes=[]))
    mixed = make(spark, jobs=[JOBS[0], (*JOBS[1][:6], None)])
    with pytest.raises(ValueError, match="have none"):
        write_trace(spark, tempfile.mkdtemp(prefix="poolwise-store-") + "/t", mixed, {})
    bare = make(spark, jobs=[(*j[:6], None) for j in JOBS])
    root = tempfile.mkdtemp(prefix="poolwise-store-") + "/t"
    assert write_trace(spark, root, bare, {})["schema_version"] == "trace/v1"
    assert "tenant_id" not in read_trace(spark, root).jobs.columns


def test_reports_replace_the_old_one(spark):
    path = tempfile.mkdtemp(prefix="poolwise-report-") + "/r.json"
    for value in ({"a": 1}, {"a": 2}):
        write_json(spark, path, value)
    assert read_json(spark, path) == {"a": 2}


def test_policies_reject_unknown_controls():
    for change in ({"scheduler": "lifo"}, {"spot_eviction_budget_rate": 2.0}, {"checkpoint_interval_seconds": 0}):
        with pytest.raises(ValueError):
            Policy("x", **change)
    assert "predictive_admission_mode" not in POLICIES["native-fifo"].payload()
    assert POLICIES["native-fifo"].fingerprint == canonical_sha256(POLICIES["native-fifo"].payload())


def test_duplicate_constraints_are_refused():
    with pytest.raises(ValueError):
        audit.check_slo([audit.DEMO_SLO[0], audit.DEMO_SLO[0]])


RANKED = (
    "window_id string, action_id string, allocation_rate_mean double, spot_jct_p95_seconds double, "
    "spot_eviction_rate_per_run double, hard_slo_passed boolean"
)


def test_rule_keeps_its_baseline(spark):
    sets = rule_candidate_sets(spark, ("native-fifo", "rolling-fifo-open", "rolling-preemptive-open-d0000"), "rolling-fifo-open")
    rows = sets.collect()
    assert len(rows) == 3
    for row in rows:
        assert row.candidate_action_ids[0] == "rolling-fifo-open" and len(set(row.candidate_action_ids)) == 3
    with pytest.raises(ValueError):
        rule_candidate_sets(spark, ("native-fifo", "rolling-fifo-open"), "rolling-fifo-open")


def test_tie_inside_the_strict_band_needs_approval(spark):
    rows = [("w", "x", 0.31, 7.0, 0.02, True), ("w", "y", 0.622, 7.0, 0.02, True), ("w", "z", 0.6301, 7.0, 0.02, True)]
    row = rank_policies(spark.createDataFrame(rows, RANKED), ["window_id"]).first()
    assert row.selected_action_ids == ["y", "z"]
    assert row.selection_status == "tie_requires_human_approval"


@pytest.mark.parametrize("passed", [True, False])
def test_missing_ranking_metric_is_an_error_for_any_candidate(spark, passed):
    rows = [("w", "a", None, 1.0, 0.0, passed), ("w", "b", 0.5, 1.0, 0.0, True), ("w", "c", 0.5, 1.0, 0.0, True)]
    with pytest.raises(Exception, match="unavailable"):
        rank_policies(spark.createDataFrame(rows, RANKED), ["window_id"]).collect()


@pytest.mark.parametrize("size", [1, 2, 6])
def test_ranking_needs_three_to_five_candidates(spark, size):
    rows = [("w", f"a{i}", 0.5, 1.0, 0.0, True) for i in range(size)]
    with pytest.raises(Exception, match="between 3 and 5"):
        rank_policies(spark.createDataFrame(rows, RANKED), ["window_id"]).collect()


def test_invalid_evidence_is_not_eligible_and_missing_metrics_are_an_error(spark):
    from poolwise.operators.ranking import join_audits

    rows = [("w", a, 0.5, 1.0 + i, 0.0, True) for i, a in enumerate("abc")]
    df = spark.createDataFrame(rows, RANKED).withColumn("evidence_valid", F.col("action_id") != "a")
    assert rank_policies(df, ["window_id"]).first().selected_action_ids == ["b"]
    audits = spark.createDataFrame([("w", "a", True), ("w", "q", True)], "window_id string, action_id string, audit_passed boolean")
    with pytest.raises(Exception, match="no matching metrics"):
        join_audits(df, audits, ["window_id", "action_id"]).collect()


def report(spark, actions, **changes):
    from poolwise.operators.metrics import METRICS_SCHEMA

    base = {
        "window_id": "w", "schema_version": METRICS_SCHEMA, "evidence_valid": True, "source": "s", "trace_id": "t", "evaluation_start": 0.0, "evaluation_end": 9.0,
        "hp_job_count": 2, "spot_job_count": 3, "hp_completed_count": 2, "spot_completed_count": 3, "preemption_event_count": 0, "spot_run_count": 3,
        "guarantee_failed_count": 0, "preemption_ledger_consistent": True, "run_ledger_consistent": True, "guarantee_ledger_consistent": True,
        "allocation_rate_mean": 0.5, "spot_jct_p95_seconds": 3.0,
    }
    rows = [{**base, "action_id": a, **(changes if i == 1 else {})} for i, a in enumerate(actions)]
    return spark.createDataFrame(rows)


THREE = ("native-fifo", "native-preemptive-0000", "native-preemptive-1800")


def test_every_comparability_criterion_can_fail(spark):
    from poolwise.operators.compare import group_criteria

    assert group_criteria(report(spark, THREE), ["window_id"], "unique").first().comparable
    broken = {
        "metrics_schema_supported": {"schema_version": "x"}, "metrics_fingerprints_valid": {"evidence_valid": False}, "source_match": {"source": "z"},
        "trace_id_match": {"trace_id": "z"}, "window_match": {"evaluation_end": 8.0}, "population_match": {"spot_job_count": 4, "spot_completed_count": 4},
        "populations_complete": {"spot_completed_count": 2}, "event_ledgers_consistent": {"preemption_ledger_consistent": False},
        "run_ledgers_consistent": {"run_ledger_consistent": False}, "guarantee_ledgers_consistent": {"guarantee_ledger_consistent": False},
        "unique": {"action_id": "native-fifo"},
    }
    for name, change in broken.items():
        row = group_criteria(report(spark, THREE, **change), ["window_id"], "unique").first()
        assert not row.comparable and [n for n in broken if not row[n]] == [name]


def test_a_portfolio_of_another_size_is_an_error(spark):
    from poolwise.operators.compare import pairwise_deltas

    six = (*THREE, "native-preemptive-3600", "native-preemptive-7200", "native-preemptive-budget09-d0000")
    assert pairwise_deltas(report(spark, THREE), THREE).count() == 3 * 19
    for actions in (six, THREE[:2]):
        with pytest.raises(Exception, match="between 3 and 5"):
            pairwise_deltas(report(spark, actions), six).collect()
    with pytest.raises(Exception, match="undeclared action"):
        pairwise_deltas(report(spark, THREE), THREE[:2]).collect()


def test_closeout_recommends_an_arm_that_beats_the_second(spark):
    from poolwise.operators.ranking import closeout

    columns = "arm_id string, window_count long, hard_slo_pass_count long, allocation_rate_mean double, spot_jct_p95_seconds double, spot_eviction_rate_per_run double"
    arms = [("a", 3, 3, 0.60, 5.0, 0.0), ("b", 3, 3, 0.55, 4.0, 0.0), ("c", 3, 3, 0.55, 4.0, 0.0), ("d", 3, 2, 0.9, 1.0, 0.0)]
    rows = {r.arm_id: r for r in closeout(spark.createDataFrame(arms, columns)).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"].recommended and rows["b"].ties == 1
    tied = [("a", 3, 3, 0.6, 5.0, 0.0), ("b", 3, 3, 0.6, 5.0, 0.0)]
    assert not any(r.recommended for r in closeout(spark.createDataFrame(tied, columns)).collect())
    circle = [("x", 3, 3, 0.600, 1.0, 0.0), ("y", 3, 3, 0.606, 2.0, 0.0), ("z", 3, 3, 0.612, 3.0, 0.0)]
    rows = {r.arm_id: r for r in closeout(spark.createDataFrame(circle, columns)).collect()}
    assert {(r.wins, r.losses, r.ties) for r in rows.values()} == {(1, 1, 0)}
    assert [a for a, r in rows.items() if r.recommended] == ["x"] and rows["z"].position == 3


def test_arms_take_what_their_candidates_reports_allow(spark):
    from poolwise.contracts import MULTIWINDOW_ACTIONS as A
    from poolwise.sources.ledger import arm_records

    columns = "window_id string, action_id string, hard_slo_passed boolean, allocation_rate_mean double, spot_jct_p95_seconds double, spot_eviction_rate_per_run double"
    passes = {"d1": (0, 3), "d2": (0, 4), "d3": ()}
    reports = [(w, a, k in passes[w], 0.5 + k / 10 if k != 1 else None, 1.0, 0.0) for w in passes for k, a in enumerate(A)]
    found = {(r.arm_id, r.window_id): r for r in arm_records(spark.createDataFrame(reports, columns)).collect()}
    taken = {key: A.index(r.action_id) for key, r in found.items()}
    assert len(found) == 21
    assert [taken["rolling-multi-agent", w] for w in passes] == [3, 4, 4]
    assert [taken["rolling-multi-agent-masked", w] for w in passes] == [0, 3, 4]
    assert [taken["rolling-workload-rule", w] for w in passes] == [0, 0, 2]
    assert not found["rolling-multi-agent-masked", "d2"].hard_slo_passed
    assert {w for (_, w), r in found.items() if r.feasible} == {"d1", "d2"}


def test_the_future_does_not_reach_an_observation(spark):
    later = [("z9", 5000.0, 900.0, 2.0, "HP", "A", "t1")]
    cut = 900.0
    seen = [
        sorted(map(tuple, observation.observe_classes(make(spark, jobs=jobs).jobs, cut, 300.0).collect()))
        for jobs in (JOBS, JOBS + later)
    ]
    assert seen[0] == seen[1]


def test_wildcards_keep_every_node(spark):
    only = make(spark, jobs=[JOBS[2]])
    assert slicing.slice_prefix(only, 100.0).nodes.count() == 2
    named = slicing.slice_prefix(make(spark), 100.0, {"A"})
    assert {r.gpu_model for r in named.nodes.collect()} == {"A"}
    assert named.jobs.where(F.col("gpu_model") == "B").count() == 0


def test_configs_are_strict(spark):
    from poolwise.sources.configs import policy_from, slo_from

    policy = {
        "schema_version": "x", "action_id": "a", "scheduler": "fifo", "spot_guarantee_seconds": 0,
        "checkpoint_interval_seconds": 60, "preemption_overhead_seconds": 0,
        "placement_strategy": "deterministic_best_fit",
    }
    assert policy_from(policy).action_id == "a"
    with pytest.raises(ValueError):
        policy_from({**policy, "node_id": "n1"})
    relative = {"kind": "baseline_relative", "baseline_metric": "hp_jct_p95_seconds", "multiplier": 1.01}
    item = {"id": "x", "metric": "hp_jct_p95_seconds", "operator": "<=", "severity": "hard", "threshold": relative}
    constraints, band = slo_from({"constraints": [item], "ranking": {"allocation_tie_band": 0.01}})
    assert constraints[0].multiplier == 1.01 and band == 0.01


def test_a_lock_is_bound_to_its_calibration_summary(spark):
    from poolwise.operators.ranking import calibration_selection
    from poolwise.sources.configs import calibration_document, lock_selection, verify_lock

    columns = (
        "window_id string, action_id string, hard_slo_passed boolean, deterministic_repetitions boolean, "
        "allocation_rate_mean double, spot_jct_p95_seconds double, spot_eviction_rate_per_run double"
    )
    rows = [(w, a, a != "c", True, x, 5.0, 0.0) for w in ("w1", "w2") for a, x in (("a", 0.6), ("b", 0.5), ("c", 0.9))]
    summary = calibration_document("d", calibration_selection(spark.createDataFrame(rows, columns)))
    assert summary["calibration_selection"]["selected_arm_ids"] == ["a"] and set(summary["arms"]) == {"a", "b", "c"}
    path = tempfile.mkdtemp(prefix="poolwise-lock-") + "/lock.json"
    lock = lock_selection(spark, path, "d", summary, 0)
    assert verify_lock(spark, path, "d", summary) == lock and lock["selection_status"] == "selected"
    assert not lock["human_approval_required"]
    for fingerprint, given, results, message in (
        ("other", summary, 0, "another study"),
        ("d", summary, 1, "already exist"),
        ("d", {**summary, "arms": {}}, 0, "valid calibration summary"),
        ("d", {**summary, "partition": "holdout"}, 0, "valid calibration summary"),
    ):
        with pytest.raises(ValueError, match=message):
            lock_selection(spark, path, fingerprint, given, results)
    with pytest.raises(ValueError, match="another study"):
        verify_lock(spark, path, "other")
    tied = [(w, a, True, True, 0.5, 5.0, 0.0) for w in ("w1", "w2") for a in ("a", "b")]
    second = calibration_document("d", calibration_selection(spark.createDataFrame(tied, columns)))
    with pytest.raises(ValueError, match="another calibration summary"):
        verify_lock(spark, path, "d", second)
    assert lock_selection(spark, path + "2", "d", second, 0)["human_approval_required"]
    nobody = calibration_document("d", calibration_selection(spark.createDataFrame([], columns)))
    assert nobody["calibration_selection"] == {**nobody["calibration_selection"], "status": "no_eligible_arm", "selected_arm_ids": []}
